"""The manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from noteflow.llm import merkle
from noteflow.llm.merkle import build, numbered, verified_leaves

SCHEMA = "doc_id long, text string, lang string, n_chars long, source string, leaf string, row int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute(rows):
    def leaf(r, text):
        return h(*(field(x) for x in (r[0], r[4], r[2], r[3], text)))

    def levels(digests):
        out = [digests]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    def climb(tree, at, fold):
        proof = []
        for level in tree[:-1]:
            low = at // 16 * 16
            left, right = level[low:at], level[at + 1:low + 16]
            proof += [*left, *right]
            fold, at = h(*left, fold, *right), at // 16
        return proof, fold

    groups = {}
    for r in rows:
        groups.setdefault(r[4], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = levels([leaf(r, r[1]) for r in groups[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for at, r in enumerate(groups[s]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            got = r[1].translate(LOWER) if hit and r[1] is not None else r[1]
            near, fold = climb(trees[s], at, leaf(r, got))
            far, fold = climb(top, n, fold)
            out.append((str(r[0]), leaf(r, r[1]), trees[s][-1][0], top[-1][0], h(*near, *far), fold, fold == top[-1][0]))
    return sorted(out)


def run(spark, rows, parts=5):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(tuple([str(r.doc_id), *r[1:]]) for r in verified_leaves(docs).collect())


@pytest.mark.parametrize("seed, sources", [(0, 1), (1, 3), (2, 40), (3, 300)])
def test_against_brute_force(spark, monkeypatch, seed, sources):
    if seed:  # rows of nodes in several copies
        monkeypatch.setattr(merkle, "SALT_LEAVES", 3)
    rng = random.Random(seed)
    names = [None, "", "É", "z", "Z", *[f"s{n}" for n in range(sources)]][:sources + 5 if sources > 1 else 1]
    rows = []
    for n in range(700):
        source = names[-1] if rng.random() < 0.5 else rng.choice(names)
        text = rng.choice([None, "", "Ab É", f"text {n}", "X" * rng.randint(0, 3000)])
        rows.append((n * 7, text, rng.choice([None, "en"]), rng.choice([None, n]), source, "other", 1))
    rows += [(None, "A", None, None, names[-1], "x", 1)] * 2 + [(7, "again B", None, 1, names[-1], "x", 1)] * 2
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("count", [0, 1, 2, 16, 17, 256, 257])
def test_sizes_around_runs(spark, count):
    rows = [(n, f"T{n}", "en", n, "s", "x", 1) for n in range(count)]
    assert run(spark, rows) == brute(rows)
    rows = [(n, f"T{n}", "en", n, f"s{n}", "x", 1) for n in range(count)]
    assert run(spark, rows) == brute(rows)


def test_very_long_text_and_own_tampering(spark):
    rows = [(n, "Word " * 200_000 if n == 3 else f"T{n}", "en", n, "s", "x", 1) for n in range(40)]
    assert run(spark, rows) == brute(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = verified_leaves(docs, tampered=F.when(F.col("doc_id") == 11, "other")).collect()
    assert [r.doc_id for r in got if not r.verified] == [11]


def test_numbers_within_groups(spark):
    rows = [(n % 7 or None, n * 31 % 1000) for n in range(1000)]
    got = numbered(spark.createDataFrame(rows, "g int, x int").repartition(6), "g", "x").collect()
    groups = {}
    for g, x in rows:
        groups.setdefault(g, []).append(x)
    for r in got:
        assert sorted(groups[r.g])[r.idx] == r.x and r.width == len(groups[r.g])


def test_nodes_are_linked(spark):
    rows = [(n, f"T{n}", "en", n, f"s{n % 3}", "x", 1) for n in range(300)]
    made = build(spark.createDataFrame(rows, SCHEMA), F.lit(None).cast("string"))
    ids = {r.id for r in made.nodes.collect()}
    parents = {r.parent for r in made.nodes.collect()} | {r.parent for r in made.leaves.collect()}
    assert parents - {None} == ids and made.root
    assert {r.leaves for r in made.subroots.collect()} == {100}
