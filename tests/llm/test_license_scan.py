"""License scan against a brute-force search, and notices with changed words."""

import random
import re

from pyspark.sql import functions as F

from noteflow.llm import license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, ws int, q int"


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        wanted = phrase.split()
        for at in range(len(words) - len(wanted) + 1):
            if words[at:at + len(wanted)] == wanted:
                places.append(at)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(spark):
    rng = random.Random(7)
    parts = "gnu general public license apache mit cc by the Cc-By MIT-License é İ K".split() + [
        "GNU General\nPublic License", "apache_license", "(MIT) license", "licenŝe", "1"]
    texts = [None, "", "--", "MIT", "cc by", "cc  BY!", "mit license " * 5000, "by cc by cc by", "x" * 100_000, "mit lıcense", "K K"]
    texts += [" ".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_changed_notices(spark):
    notice = next(n for n, label in license_scan.NOTICES.items() if label == "mit-text").split()
    less, more = notice[:9] + notice[10:], notice[:9] + ["really"] + notice[9:]
    wrong = [w if i % 2 else "other" for i, w in enumerate(notice)]
    apart = notice[:12] + ["filler"] * 200 + notice[12:]
    texts = [" ".join(w) for w in (notice, less, more, wrong, apart, ["pre"] * 50 + more + ["post"])]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], DOCS)
    found = {r.doc_id: "mit-text" in r.labels for r in license_scan.scan(docs).collect()}
    assert found == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True}
    spans = license_scan.license_spans(docs).where("label = 'mit-text' AND id = 5").collect()
    assert [(s["first"], s["last"]) for s in spans] == [(50, 50 + len(more) - 1)]


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    rows = [(1, "mit license", 1, 1), (1, "mit license", 1, 1), (1, "cc by", 1, 1), (None, "cc by x", 1, 1), (None, None, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("th", F.lit(1))
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.labels) for r in license_scan.scan(docs).collect())
    assert got == [("1", 2, 1, "cc-by"), ("1", 2, 1, "mit"), ("1", 2, 1, "mit"), ("None", 0, 0, ""), ("None", 3, 1, "cc-by")]
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_long_templates(spark):
    rng = random.Random(3)
    common = "of the in to and or software this any copy".split()
    words = [rng.choice(common) if rng.random() < 0.6 else f"w{rng.randrange(300)}" for _ in range(700)]
    template = license_scan.Template(tuple(words), "long", False)
    short = license_scan.Template(tuple(words[:64]), "short", True)
    chance = [rng.choice(common) if rng.random() < 0.6 else f"v{rng.randrange(300)}" for _ in range(4000)]
    put_in = words[:200] + ["copyright", "holder", "name", "here"] + words[200:450] + words[453:]
    texts = [words, chance + put_in + chance, chance, words[:300], words[:100] + chance + words[100:],
             chance + words[:64] + chance, words + words]
    docs = spark.createDataFrame([(i, " ".join(w), 1, 2) for i, w in enumerate(texts)], DOCS)
    spans = license_scan.license_spans(docs, (template, short)).where("template >= 0").collect()
    found = sorted((s["id"], s["label"], s["first"], s["last"]) for s in spans)
    assert [f[:2] for f in found] == [(0, "long"), (0, "short"), (1, "long"), (1, "short"), (3, "short"), (4, "long"),
                                      (4, "short"), (5, "short"), (6, "long"), (6, "long"), (6, "short"), (6, "short")]
    ends = {f[:2]: f[2:] for f in found if f[1] == "long"}
    assert ends[0, "long"] == (0, 699)
    first, last = ends[1, "long"]
    assert abs(first - 4000) <= 20 and abs(last - (4000 + len(put_in) - 1)) <= 20
