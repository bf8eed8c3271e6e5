"""The shingle join and components against brute force."""

import itertools
import random
import re

import pytest

from noteflow.llm import ngram_join
from noteflow.llm.components import components
from noteflow.llm.ngram_join import drop_similar, similar_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id string, token int"


def shingles(text, k):
    words = WORD.findall("".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        at = rng.randrange(len(words))
        words[at:at + 1] = rng.choice([[], ["new" + str(rng.random())], [words[at], "more"]])
    return words


@pytest.mark.parametrize("seed, small, block", [(0, 64, 100), (1, 3, 7)])
def test_against_brute_force(spark, monkeypatch, seed, small, block):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(300)]
    passage = rng.choices(vocabulary, k=40)
    texts = [None, "", "  ", "One", "one", "ONE two", "a b c", "A  b\tc", "É é", "é é", "x" * 100_000]
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(3, 120))
        texts += [" ".join(changed(rng, base, rng.randint(0, 6))) for _ in range(rng.randint(1, 4))]
    # A chain whose ends differ, a large group of near copies, and a passage in many texts.
    words = rng.choices(vocabulary, k=100)
    for _ in range(12):
        texts.append(" ".join(words))
        words = changed(rng, words, 2)
    base = rng.choices(vocabulary, k=150)
    texts += [" ".join(changed(rng, base, rng.randint(0, 5))) for _ in range(60)]
    texts += [" ".join(passage + rng.choices(vocabulary, k=rng.randint(1, 90))) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    for k, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(docs, k, percent).collect()}
        assert got == brute(rows, k, percent)


def test_missing_ids_repeated_rows_and_empty_tables(spark):
    text = "one two three four five six"
    rows = [(3, text, "x", 1), (3, text, "x", 1), (5, text, "x", 1), (None, text, "x", 1), (8, None, "x", 1), (9, "", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in similar_components(docs).collect())
    assert got == [("3", 2, 3), ("3", 2, 3), ("5", 2, 3), ("8", 0, 8), ("9", 0, 9), ("None", 2, None)]
    kept = drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "8", "9", "None"]
    assert similar_components(docs.limit(0)).count() == 0 and drop_similar(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(n, n + 1) for n in range(100, 160)] + [(500, n) for n in range(501, 560)] + [(7, 7), (None, 3)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}


def test_ids_with_several_texts(spark):
    def text(name, changed=0):
        return " ".join(f"{name}{n}" if n >= changed else f"other{n}" for n in range(60))

    # Id 5 joins the families of x and y; its third text is like no other.
    rows = [(1, text("x")), (5, text("x", 2)), (5, text("y")), (5, text("z")), (7, text("y", 2)), (8, text("y", 3)),
            (9, text("q")), (9, text("q")), (None, text("x")), (5, None), (6, text("p")), (6, text("p", 1))]
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "s", 0) for i, t in some], SCHEMA)
        got = {(r.doc_id, r.component_id) for r in similar_components(docs).collect()}
        assert got == {(1, 1), (5, 1), (7, 1), (8, 1), (9, 9), (None, None), (6, 6)}
        left = sorted((str(r.doc_id), str(r.text)) for r in drop_similar(docs).collect())
        kept = [rows[0], *rows[2:4], *rows[6:10]]
        one = [x for x in left if x[0] == "6"]
        assert len(one) == 1 and sorted(x for x in left if x[0] != "6") == sorted((str(i), str(t)) for i, t in kept)


def test_forests_join_what_links_join():
    import numpy as np

    rng = np.random.default_rng(5)
    for count, links in ((1, 0), (40, 30), (200, 4000), (300, 150)):
        a, b = rng.integers(0, count, links), rng.integers(0, count, links)
        node, root = ngram_join._forest(a, b, count)
        assert len(node) < max(count, 1) and (root < node).all()
        least = list(range(count))
        for _ in range(count):
            for x, y in zip(a, b):
                least[x] = least[y] = min(least[x], least[y])
        assert dict(zip(node.tolist(), root.tolist())) == {n: r for n, r in enumerate(least) if n != r}


def test_a_large_family_of_near_copies(spark):
    """Near copies of one text, many of them not similar enough to its smallest."""
    rng = random.Random(9)
    base = [f"w{n}" for n in range(80)]
    texts = []
    for n in range(1_500):
        words = list(base)
        for at in rng.sample(range(0, 80), n % 2 + 1):
            words[at] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(n, t, "s", 0) for n, t in enumerate(texts)], SCHEMA).repartition(8)
    got = similar_components(docs, 4, 85).collect()
    assert len(got) == 1_500
    sizes = {}
    for r in got:
        sizes[r.component_id] = sizes.get(r.component_id, 0) + 1
    sample = rng.sample(range(1_500), 150)
    known = {r.doc_id: r.component_id for r in got}
    sets = {n: shingles(texts[n], 4) for n in sample}
    for a, b in itertools.combinations(sample, 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
            assert known[a] == known[b]
    assert max(sizes.values()) > 600
