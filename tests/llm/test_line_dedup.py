"""Lines that many documents share, against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from noteflow.llm import line_dedup
from noteflow.llm.line_dedup import SLICE, common_lines, drop_common_lines, lines

SCHEMA = "doc_id long, text string, n_lines string, by string"
SPACES = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows, min_docs, min_chars, keep_first=False):
    places = {}
    for i, text, *_ in rows:
        for n, line in enumerate((text or "").split("\n")):
            key = key_of(line)
            if len(key) >= min_chars:
                places.setdefault(key, []).append((i is None, i or 0, n))
    docs = Counter()
    for i, text, *_ in rows:
        docs.update({key_of(x) for x in (text or "").split("\n")})
    out = []
    for i, text, *_ in rows:
        own = (text or "").split("\n")
        keep = []
        for n, line in enumerate(own):
            key = key_of(line)
            first = keep_first and key in places and min(places[key]) == (i is None, i or 0, n)
            if len(key) < min_chars or docs[key] < min_docs or first:
                keep.append(line)
        out.append((str(i), "\n".join(keep), len(own), len(own) - len(keep)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    shared = [f"Shared line {n} é{n}" for n in range(20)] + ["ÀB c", "x", "  Subscribe now \t", "subscribe NOW", "\x1cedge\x85"]
    texts = [None, "", "\n", " \n\t", "x\nx\nx", "\r\nx\r\n", "y" * 300, "\n".join(["long " * 20] * 40)]
    for n in range(200):
        body = [rng.choice(shared) if rng.random() < 0.4 else f"own {n} {rng.random()}" for _ in range(rng.randint(1, 8))]
        texts.append("\n".join(rng.choice(["", " ", "\t"]) + x + rng.choice(["", " ", "\r"]) for x in body))
    texts += ["one copy\nof many\nown"] * 30
    return [(n, t, "a", "b") for n, t in enumerate(texts)] + [(None, "x\nnull id", "a", "b"), (3, "x\nagain", "a", "b")]


@pytest.mark.parametrize("min_docs, min_chars, keep_first", [(10, 1, False), (2, 1, False), (3, 2, True), (12, 10, True)])
def test_against_brute_force(spark, min_docs, min_chars, keep_first):
    rows = corpus(min_docs)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = drop_common_lines(docs, min_docs, min_chars, keep_first)
    assert got.columns == [*docs.columns, "n_lines_", "n_dropped"]
    found = sorted((str(r.doc_id), r.text, r.n_lines_, r.n_dropped) for r in got.collect())
    assert found == brute(rows, min_docs, min_chars, keep_first)


def test_full_filters_lose_nothing(spark, monkeypatch):
    """With far too few cells every line is a suspect; the result is the same."""
    monkeypatch.setattr(line_dedup, "_wanted_cells", lambda count: 1 << 20)
    monkeypatch.setattr(line_dedup, "HASHES", 1)
    rows = corpus(1)
    got = drop_common_lines(spark.createDataFrame(rows, SCHEMA), 10)
    assert sorted((str(r.doc_id), r.text, r.n_lines_, r.n_dropped) for r in got.collect()) == brute(rows, 10, 1)


def test_few_lines_are_shuffled_that_are_not_repeated(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('line ', id, '\\nother ', id) AS text")
    cells = line_dedup._wanted_cells(40_000)
    bits = spark.sparkContext.broadcast(line_dedup.bloom_filter(docs, "text", cells, "twice"))
    suspects = line_dedup._suspects(docs.selectExpr("doc_id AS by", "text"), bits, cells, 1, False).count()
    assert suspects < 0.05 * 40_000


def test_pieces_of_long_texts():
    texts = ["a\nb", "x" * (SLICE + 9) + "\nshort\n" + "y z\n" * (SLICE // 3) + "end", None, "", "last\n",
             "p\n" + "q" * (3 * SLICE)]
    found = {}
    for data, rows, numbers, first, last, _ in lines(pa.array(texts)):
        for row, number, low, high in zip(rows, numbers, first, last):
            assert (row, number) not in found
            found[row, number] = data[low:high].tobytes().decode()
    want = {(row, n): x.strip(SPACES) for row, t in enumerate(texts) for n, x in enumerate((t or "").split("\n"))}
    assert found == want


def test_equal_keys_hash_alike_wherever_they_stand():
    long = "Wide " * 20_000
    texts = [f" {long}\nA b ", f"a B\n{'z' * 50}\n{long.lower()}", "q" * 2 * SLICE + "\na b"]
    seen = {}
    for data, rows, numbers, first, last, hashes in lines(pa.array(texts)):
        for low, high, h in zip(first, last, hashes):
            seen.setdefault(key_of(data[low:high].tobytes().decode()), set()).add(np.uint64(h))
    assert len(seen) == 4 and all(len(v) == 1 for v in seen.values())


def test_empty_tables_and_bad_arguments(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert drop_common_lines(none).count() == 0 and common_lines(none).count() == 0
    with pytest.raises(ValueError, match="min_docs"):
        drop_common_lines(none, min_docs=1)
    with pytest.raises(ValueError, match="missing"):
        drop_common_lines(none, text="words")
