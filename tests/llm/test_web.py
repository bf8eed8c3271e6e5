"""Archives and main text: round trips, planted magic, broken markup, held-out pages."""

import base64
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from noteflow import staging
from noteflow.llm import html_text, warc
from noteflow.llm.labelled_pages import labelled_pages

PAGES = "page_id long, url string, html string"
FAKE = ("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n")


def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    return before


def rows_of_pages():
    payloads = ["<p>one</p>", "", None, "é😀\r\n\r\nline", FAKE, "x" + FAKE + FAKE + "tail", "WARC/1.0\r\n", "WARC/1.0\r\n" * 40,
                FAKE[:-30], "y" * 5000, "\r\n\r\n", "Content-Length: 3\r\n\r\n", "ends with WARC/1.0\r\n"]
    rows = [(i, f"http://h/{i}\r\nX: 1", p) for i, p in enumerate(payloads)]
    rows += [(100 + i, None, p) for i, p in enumerate(payloads[:6])]
    return rows + [(200, "u", "<p>one</p>"), (200, "u", "<p>one</p>"), (None, "u", "alone"), (None, "u", FAKE)]


def expected(rows):
    largest = {}
    for i, _, p in rows:
        p = (p or "").encode()
        largest[p] = max([x for x in (largest.get(p), i) if x is not None], default=None)
    out = []
    for i, _, p in rows:
        p = (p or "").encode()
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        first = largest[p]
        out.append((i, len(p), digest, "response" if i == first else "revisit", None if i == first else first))
    return sorted(map(str, out))


def test_round_trip_with_magic_in_payloads(spark, tmp_path):
    rows = rows_of_pages()
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1)).withColumn("id", F.lit(2)).repartition(2)
    before = small_splits(spark)
    try:
        got = [tuple(r) for r in warc.page_records(pages, str(tmp_path / "w")).collect()]
        assert sorted(map(str, got)) == expected(rows)
        read = warc.read_warc(spark, str(tmp_path / "w")).where("type = 'response'").collect()
        want = {hashlib.sha1((p or "").encode()).hexdigest() for _, _, p in rows}
        assert {hashlib.sha1(r.payload).hexdigest() for r in read} == want
        assert all("\n" not in r.target_uri for r in read)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_long_payloads_and_rows_without_ids(spark, tmp_path):
    long = "é<p>" * 700_000
    rows = [(1, "u", long), (2, "u", long[:-7] + FAKE + "z" * 3_000_000), (3, "u", long), (None, None, long + "!"), (None, "u", None)]
    got = warc.page_records(spark.createDataFrame(rows, PAGES), str(tmp_path / "w")).collect()
    assert sorted(str(tuple(r)) for r in got) == expected(rows)


def test_chains_of_many_records_keep_two_rounds(spark, tmp_path):
    rows = [(i, "u", f"page {i}") for i in range(300)]
    pages = spark.createDataFrame(rows, PAGES).coalesce(1)
    with staging.scope(spark):
        got = warc.page_records(pages, str(tmp_path / "w"))
        assert sorted(str(tuple(r)) for r in got.collect()) == expected(rows)
        kept = [path for path in staging._scopes.stack[-1] if "warc-jumps" in path]
        assert 1 <= len(kept) <= 3


def test_least_bytes_and_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], PAGES)
    warc.write_warc(pages, str(tmp_path / "w"), least_bytes=3)
    kinds = {r.record_id: r.type for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert kinds == {"urn:page:1": "response", "urn:page:2": "response", "urn:page:3": "revisit", "urn:page:4": "response"}
    assert warc.page_records(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_broken_chain_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "z" * i) for i in range(5)], PAGES).coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"))
    for name in os.listdir(tmp_path / "w"):
        if name.startswith("part-"):
            data = (tmp_path / "w" / name).read_bytes()
            os.makedirs(tmp_path / "cut", exist_ok=True)
            (tmp_path / "cut" / name).write_bytes(data[:-3])
    with pytest.raises(ValueError, match="breaks off"):
        warc.read_warc(spark, str(tmp_path / "cut")).count()


@pytest.fixture(scope="module")
def model():
    return html_text.train(labelled_pages())


def test_held_out_pages(model):
    right = wrong = 0
    for source in labelled_pages(200, 99):
        page = html_text.parse(source)
        content = html_text.marginals(page, model)
        for node, text in page.blocks:
            hit = (content[node] > 0.5) == bool(page.label[node])
            right, wrong = right + hit * len(text), wrong + (not hit) * len(text)
    assert right / (right + wrong) > 0.97


def brute_marginals(page, model):
    count = len(page.kind)
    seen = html_text.features(page)
    import itertools
    import math

    total = [[0.0, 0.0] for _ in range(count)]
    for labels in itertools.product((0, 1), repeat=count):
        score = model.root[labels[0]]
        for node in range(count):
            score += sum(model.own[f][labels[node]] for f in seen[node] if f in model.own)
            if node:
                above = page.parent[node]
                pair = model.pair.get((page.kind[above], page.kind[node])) or model.pair[page.kind[node]]
                score += pair[labels[above]][labels[node]]
        for node in range(count):
            total[node][labels[node]] += math.exp(score)
    return [t[1] / sum(t) for t in total]


@pytest.mark.parametrize("source", [
    "", "<p>a", "<div><p>some words here</p><ul><li><a href=x>l</a></li></ul></div><footer>f</footer>",
    "<article><h1>T</h1><p>words</p><aside>x</aside></article><div class=comments><p>c</p></div>",
])
def test_messages_give_exact_marginals(model, source):
    page = html_text.parse(source)
    assert html_text.marginals(page, model) == pytest.approx(brute_marginals(page, model), abs=1e-9)


def test_texts_and_blocks(model):
    inside = ("<h1>A &amp; B</h1><p>one\n two<b> three</b><br>four &lt;p&gt;</p><script>if (a<b) '</p>'</script>"
              "<p><b>never closed<br><p>next <!-- c --> one<style>p{}</style></p><ul><li>x<li>y</ul>")
    source = f"<nav><a href=1>m</a></nav><div class='ad'>buy</div><article>{inside}</article><footer>&copy; f</footer>"
    assert html_text.main_text(source, model) == "A & B\none two three four <p>\nnever closed\nnext one\nx\ny"


def test_extract_edge_cases(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>" + "long text " * 50_000 + "</p></article>"),
            (4, "u", "<" * 3000), (5, "u", "<div>" * 5000 + "deep"), (6, "u", "<a \"x\" " * 5000), (7, "u", "<script>" * 3000),
            (None, "u", "<article><p>x y z</p></article>"), (4, "u", "<" * 3000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("t")).withColumn("n_chars", F.lit(1))
    got = html_text.extract(pages, model).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    by = {r.page_id: r for r in got}
    assert by[1].text == "" == by[2].text and by[None].text == "x y z"
    assert by[3].n_chars == len("long text " * 50_000) - 1
    assert html_text.extract(pages.limit(0), model).count() == 0


@pytest.mark.parametrize("before", [
    "<select><option>A<option>B", "<svg><path d=1><g>", "<math><mi>x", "<object data=x>", "<canvas>", "<template>", "<iframe src=x>",
    "<noscript>", "<select><option>A<select><option>B", "<label>c <select><option>A</label>", "<svg><a href=x><text>t",
])
def test_elements_without_end_tag_lose_nothing(model, before):
    article = "<article><h1>Title</h1><p>First words of it.</p><p>Second words of it.</p></article>"
    for after in ("", "<form><select><option>z</select></form>", "<div><svg><path/></svg><iframe></iframe><template>q</template></div>"):
        got = html_text.main_text(f"<body><header>{before}</header>{article}{after}", model)
        assert got == "Title\nFirst words of it.\nSecond words of it.", (before, after)
        got = html_text.main_text(f"<body>{before}{article}{after}", model)
        assert got.endswith("Title\nFirst words of it.\nSecond words of it."), (before, after)
        assert "B" not in got and "z" not in got and "q" not in got, (before, after)


def test_what_is_shown_in_an_article_is_kept(model):
    inside = ("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <object data=a>a film</object> or <canvas>a plot</canvas></p>"
              "<noscript><p>plain words</p></noscript><p>see<svg><title>i</title><desc>d</desc><text>label</text><path/></svg>here"
              "<select><option>A</select> and <iframe>no</iframe><template><p>t</p></template>on</p>")
    source = f"<nav><a href=1>m</a></nav><article><h1>T</h1>{inside}</article><footer>f</footer>"
    assert html_text.main_text(source, model) == "T\nlet x=1 be a film or a plot\nplain words\nsee label here and on"


@pytest.mark.parametrize("piece", ["<select>", "<svg>", "<svg><p>", "<iframe>", "<template", "<select><b>", "<svg><desc>", "<math><a>", "<title",
                                   "<h3>x", "<div><i>", "<p title=\"abc>x", "<ul><li>x", "<a b='"])
def test_hostile_pages_take_linear_time(model, piece):
    import time

    start = time.process_time()
    html_text.parse(piece * 20_000)
    assert time.process_time() - start < 5


@pytest.mark.parametrize("pieces", [("<i>", "<h2>y</h2>"), ("<i>", "</u>"), ("<div><i>", "</p>"), ("<i>", "</i>"), ("<li>", "<td>")])
def test_deep_pages_take_linear_time(pieces):
    import time

    start = time.process_time()
    html_text.parse("".join(p * 20_000 for p in pieces))
    assert time.process_time() - start < 5


def test_references_and_quotes_end_at_tags():
    def text(source):
        return " ".join(t for _, t in html_text.parse(source).blocks)

    assert text("A &<b>amp;</b> B") == "A &amp; B"
    assert text("&lt;<i>p</i>&gt; &amp;amp;") == "<p> &amp;"
    assert text('<p title="abc>Broken <b>on</b>') == "Broken on"
    assert text('<p title="a>b" class=\'c>d\'>T') == "T"
    assert text("<a title=it's>x</a>y") == "xy"
