"""The trie of conversation prefixes against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from noteflow.llm.prefix_trie import ordered_turns, prefix_nodes, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, conv string, depth int"


def tid(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    talks = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            key = (turn is not None, turn or 0, tid(role or "", text or ""))
            talks.setdefault(conv, []).append((key, (role or "", text or "")))
    talks = {c: [t for _, t in sorted(turns)] for c, turns in talks.items()}
    nodes = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        turns = talks.get(c - c % 100, [])[:h] + own[h:]
        for d in range(len(turns) + 1):
            node = nodes.setdefault(tuple(turns[:d]), {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(turns):
                node["ends"].append(c)
    for node in nodes.values():
        node |= {"children": 0, "leaves": 0, "saved": 0}
    for path in sorted(nodes, key=len, reverse=True):
        node = nodes[path]
        node["leaves"] = node["leaves"] or 1
        if path:
            node["saved"] += (len(node["members"]) - 1) * len(path[-1][1])
            up = nodes[path[:-1]]
            up["children"] += 1
            up["leaves"] += node["leaves"]
            up["saved"] += node["saved"]
    return sorted(
        (min(n["members"]), len(p), str(min(nodes[p[:-1]]["members"]) if p else None), len(n["members"]), n["children"],
         n["leaves"], n["saved"], hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest())
        for p, n in nodes.items())


def run(spark, rows, container, parts=4):
    turns = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    found = prefix_nodes(rebuilt(ordered_turns(turns)), container)
    return sorted((r.conv_id, r.depth, str(r.parent_conv_id), r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in found.collect())


def talks(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 260), 400, 499, 777, 10_000]:
        for t in range(rng.randint(1, 9)):
            text = "Hello" if t == 0 and rng.random() < 0.7 else rng.choice(["yes", "no", "é😀", f"own {c} {t}", None, ""])
            rows.append((c, t, rng.choice(["user", "bot"]) if t else "user", text, "x", 1))
    same = [("user", "Hello"), ("bot", "Same"), ("user", "Same again"), ("bot", "bye")]
    for c in range(1000, 1400):  # a large group of equal conversations
        rows += [(c, t, *x, "x", 1) for t, x in enumerate(same * 3)]
    rows += [(5, None, "user", "first", "x", 1), (5, 2, "user", "tie", "x", 1), (5, 2, "user", "tie", "x", 1),
             (5, 2, "bot", "tie", "x", 1), (None, 1, "user", "nobody", "x", 1), (888, 0, None, None, "x", 1)]
    rows += [(20_000 + n, t, "user", f"long {t}", "x", 1) for n in range(3) for t in range(120 + n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("container", [30, 400, 10 ** 9])
def test_against_brute_force(spark, container):
    rows = talks(container)
    assert run(spark, rows, container) == brute(rows)


def test_long_texts_one_conversation_and_none(spark):
    one = [(3, 0, "user", "long " * 200_000, "x", 1), (3, 1, "bot", None, "x", 1)]
    assert run(spark, one, 1) == brute(one)
    assert run(spark, [], 10) == []


def test_ids_of_a_large_group_are_joined_in_order(spark, monkeypatch):
    from noteflow.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "CHUNK_CHARS", 50)
    turns = spark.range(3_000).select((F.col("id") * 101).alias("conv_id"), F.lit(0).alias("turn"), F.lit("u").alias("role"),
                                      F.lit("all alike").alias("text"))
    talks = ordered_turns(turns)
    got = prefix_nodes(talks).where("depth = 1").collect()
    want = hashlib.sha256(",".join(str(101 * n) for n in range(3_000)).encode()).hexdigest()
    assert [(r.n_convs, r.ends_sha256) for r in got] == [(3_000, want)]
