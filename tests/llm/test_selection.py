"""Quality rules, exact repeats, mixing: edge cases and brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from noteflow.llm import exact_dedup, mixing, quality
from noteflow.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string"


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], schema)


def brute_repeats(words):
    found = {}
    for at in range(len(words) - 7):
        found.setdefault(tuple(words[at:at + 8]), []).append(at)
    return len({p for places in found.values() if len(places) > 1 for at in places for p in range(at, at + 8)})


def test_measures_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a", "x" * 50_000, "a b c d e f g h", "a " * 9, "l\nl\n \nl\r\nl", "# $ é% 😀 |"]
    texts += [" ".join(rng.choices("ab", k=rng.randint(1, 60))) for _ in range(60)]
    texts += ["\n".join(rng.choices(["a b", "c", "", " ", "a  b"], k=rng.randint(1, 9))) for _ in range(30)]
    rows = {r.doc_id: r for r in quality.judge(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        text, r = text or "", rows[i]
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert r.n_words == len(words)
        assert r.word_chars == sum(map(len, words))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == brute_repeats(words), text
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words))


def test_order_of_rules_changes_no_verdict(spark):
    prose = " ".join(f"word{i} other" for i in range(40))
    docs = frame(spark, [prose, "few", prose.upper(), prose.replace(" ", " # "), "a " * 90, None])
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {0}
    for order in (quality.RULES, quality.RULES[::-1]):
        name = quality.rejected_by(F.col("text"), order)
        assert {r.doc_id for r in docs.where(name.isNull()).collect()} == kept
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_of_empty_and_clashing_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert quality.keep_good(empty).count() == 0 and quality.judge(empty).count() == 0
    docs = frame(spark, ["a b"]).withColumn("n_words", F.lit(9)).withColumn("words_", F.lit(1)).withColumn("text_", F.lit(1))
    assert [(r.n_words, r.words_) for r in quality.judge(docs).collect()] == [(2, 1)]


def test_repeats_with_a_weak_hash(spark):
    texts = ["a  b", "a b", "b a", "a\tb", None, "", "c" * 200_000, "c" * 200_000, "ab"]
    docs = spark.createDataFrame([(9 - i, t, "s") for i, t in enumerate(texts)], DOCS)
    for hash_of in (exact_dedup.content_hash, lambda norm: F.lit(b"same"), F.char_length):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept)
               for r in exact_dedup.find_repeats(docs, hash_of=hash_of).collect()}
        assert got == {9: (6, 3, False), 8: (6, 3, False), 7: (7, 1, True), 6: (6, 3, True), 5: (4, 2, False),
                       4: (4, 2, True), 3: (2, 2, False), 2: (2, 2, True), 1: (1, 1, True)}


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a", "s"), (1, "a", "t"), (None, "a", "s"), (None, "b", "s"), (None, "b", "s"), (2, "c", None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("h", F.lit(1)).withColumn("id", F.lit(2)).withColumn("sha_", F.lit(3))
    kept = exact_dedup.drop_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "a"), ("2", "c"), ("None", "b")]
    empty = docs.limit(0)
    assert exact_dedup.drop_repeats(empty).count() == 0 and exact_dedup.find_repeats(empty).count() == 0


def water_level(sizes, weights, share, epochs):
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        used = sum(min(epochs * n, w * mid) for n, w in zip(sizes, weights, strict=True))
        low, high = (mid, high) if used < share * sum(sizes) else (low, mid)
    return [min(epochs * n, w * high) for n, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_bisection(spark, seed):
    rng = random.Random(seed)
    names = [*(f"s{n:02}" for n in range(rng.randint(1, 9))), None]
    sizes = [rng.choice([0, rng.randint(1, 50), rng.randint(100, 5000)]) for _ in names]
    frame = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    want = water_level(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    assert [got[n] for n in names] == pytest.approx(want, abs=1e-6)


def test_mix_meets_targets_and_repeats_itself(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(400, None, "b"), (7, "w w", "a"), (7, "w w", "a"), (None, "w", "c"), (401, "w " * 30_000, "é")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("x")).withColumn("epoch", F.lit(0))
    entries = mixing.mix(docs)
    got = entries.collect()
    assert len(got) == 2 * len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= r["size"]
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    for taken, target in by.values():
        assert taken == int(target)
    # Positions are the running sum of sizes in the order of virtual finish times.
    assert [r.position for r in sorted(got, key=lambda r: (r.position, r["size"] > 0))] == sorted(r.position for r in got)
    assert max(r.position + r["size"] for r in got) == sum(r["size"] for r in got)
    ordered = sorted(got, key=lambda r: r.finish)
    assert all(a.position <= b.position for a, b in zip(ordered, ordered[1:], strict=False) if a.finish < b.finish)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_hot_ids_are_counted_and_listed_again(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(120)]
    rows += [(None, "w " * (i % 3), "a") for i in range(100)] + [(5, "w w w", "b")] * 40 + [(None, None, None)] * 15
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 2 * len(rows)
    for source in ("a", "b", None):
        ids = [(i, len((t or "").split())) for i, t, s in rows if s == source]
        queue = sorted(ids, key=lambda x: (hashlib.md5(f"mix{'?' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))
        served, want = 0, []
        for epoch in range(2):
            for row, (i, size) in enumerate(queue, 1):
                served += size
                want.append((i, size, epoch, row, served))
        have = [(r.doc_id, r["size"], r.epoch, r.row, r.served) for r in got if r.source == source]
        assert sorted(have, key=lambda x: x[2:]) == want


def test_mixed_documents_are_those_taken_whole(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("s_", F.lit(1)).withColumn("k0_", F.lit(2))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = sorted(str(r.doc_id) for r in mixing.mix(docs).where("taken = size").collect())
    assert sorted(str(r.doc_id) for r in mixed.collect()) == want
    assert mixing.mixed_documents(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_texts_without_words_move_no_cut(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 9), "a") for i in range(20)] + [(i, "w " * rng.randint(1, 9), "b") for i in range(20, 200)]
    rows += [(i, rng.choice([None, "", " "]), "b") for i in range(200, 260)]
    target = {r.source: int(r.target) for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()}
    want = []
    for source in "ab":
        queue = sorted((hashlib.md5(f"mix{i}".encode()).hexdigest(), i, len((t or "").split())) for i, t, s in rows if s == source)
        served = 0
        for _, i, size in queue * 2:
            served += size
            want += [i] * (served <= target[source])
    assert served > target["b"] > served / 2
    got = mixing.mixed_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)


def test_repeated_rows_are_rows_of_the_query(spark, tmp_path):
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(40)] + [(3, "w w w w", "b")] * 3 + [(None, "w", None)] * 2
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op1_weighted_mix"](spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(i), len(t.split())) for i, t, _ in rows)
    assert got[0].__fields__ == ["doc_id", "source", "size", "source_size", "target", "taken"]
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(taken == int(target) for taken, target in by.values())


def test_order_of_finish_times_cuts_the_mix(spark, monkeypatch):
    """The running sum over all sources decides what is whole: with other positions the mix misses its targets."""
    monkeypatch.setattr(mixing, "ORDER_ROWS", 37)
    rng = random.Random(11)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "a", "b", "c", None])) for i in range(300)]
    rows += [(i, "w", "d") for i in range(300, 900)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    end = min(r.position for r in got if r.served > int(r.target))
    left = {}
    for r in sorted(got, key=lambda r: (r.position, r["size"] > 0)):
        if r.position + r["size"] <= end:
            assert r.taken == r["size"]
        elif r.taken:
            left.setdefault(r.source, []).append(r)
    assert sum(r["size"] for r in got if r.position + r["size"] <= end) == end
    assert len(left) > 1 and all(len(parts) == 1 for parts in left.values())
    assert end + sum(r.taken for parts in left.values() for r in parts) == sum({r.source: int(r.target) for r in got}.values())

    right = mixing.in_order
    monkeypatch.setattr(mixing, "in_order", lambda entries: right(entries).withColumn("position", F.lit(0)))
    with pytest.raises(RuntimeError, match="target"):
        mixing.mix(docs)
