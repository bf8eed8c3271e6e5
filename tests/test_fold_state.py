"""Repeat removal on streams by the batch fold: order, replays, hand-over, late arrivals, freed state."""

import random

import pytest
from pyspark.sql import functions as F

from noteflow import staging
from noteflow.operators import dedup
from noteflow.streaming import fold_state
from noteflow.streaming.fold_state import FoldStore, fold_batch, fold_changes, hand_over
from tests.test_ingest_dedup import events, outcome, walk


def some(seed, count=150, names=5, until=4000):
    rng = random.Random(seed)
    keys = {(f"n{rng.randrange(names)}", rng.randrange(until), f"r{rng.randrange(3)}") for _ in range(count)}
    return [(*k, rng.choice(["good", "good", "bad", "forged"])) for k in sorted(keys)]


def plain(df):
    return sorted((r["name"], r["second"], r["relay"]) for r in df.collect())


def test_micro_batches_in_order_equal_the_batch(spark, tmp_path):
    rows = some(1)
    rows.sort(key=lambda r: r[1])
    store, good, bad = FoldStore(spark, str(tmp_path)), [], []
    first, last = rows[:60], rows[60:]
    good += plain((a := hand_over(events(spark, first), store))[0])
    bad += plain(a[1])
    for n, part in enumerate((last[:50], last[50:])):
        for _replay in range(2 - n):  # a micro-batch that is run again reads only earlier ones
            a = [plain(x) for x in fold_batch(events(spark, part), n, store)]
        good += a[0]
        bad += a[1]
    assert (sorted(good), sorted(bad)) == walk(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_changes_in_any_order_sum_up_to_the_batch(spark, tmp_path, seed):
    rows = some(seed, 120, 4, 2500)
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    store, total, taken_back = FoldStore(spark, str(tmp_path)), {}, 0
    cuts = [0, 40, 80, len(rows)]
    for n, (low, high) in enumerate(zip(cuts, cuts[1:])):
        for r in fold_changes(events(spark, shuffled[low:high]), n, store).collect():
            key = (r.outcome, r.name, r.second, r.relay)
            total[key] = total.get(key, 0) + r.op
            taken_back += r.op < 0
    assert set(total.values()) <= {0, 1} and taken_back
    left = sorted(k for k, n in total.items() if n)
    passed, quarantined = walk(rows)
    assert left == sorted([("pass", *r) for r in passed] + [("quarantine", *r) for r in quarantined])


def test_a_forged_id_with_very_many_copies(spark, tmp_path):
    """No Python worker sees the rows of an id: the fold of a micro-batch has no grouped Python."""
    one = events(spark, [("hot", 0, "r", "forged"), ("a", 1, "r", "good")])
    copies = one.withColumn("n", F.explode(F.sequence(F.lit(1), F.when(F.col("name") == "hot", 30_000).otherwise(2)))).drop("n")
    store = FoldStore(spark, str(tmp_path))
    good, bad = fold_batch(copies, 0, store)
    assert (good.count(), bad.count()) == (1, 30_000)
    plan = bad._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    good, bad = fold_batch(copies, 1, store)
    assert (good.count(), bad.count()) == (0, 30_000)


def test_times_are_freed_when_every_relay_has_passed_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fold_state, "REWRITE", 2)
    store = FoldStore(spark, str(tmp_path))
    batches = [
        [("a", 0, "r", "good"), ("a", 5, "s", "good")],
        [("b", 9000, "r", "good")],  # s has not come so far
        [("c", 9500, "s", "good")],
        [("d", 9600, "s", "good"), ("d", 9601, "r", "good")],
    ]
    known = []
    for n, rows in enumerate(batches):
        fold_batch(events(spark, rows), n, store, lag_s=1000)
        known.append(store.read("accepted", n + 1).count())
    assert known == [1, 2, 3, 3]  # a is freed
    left = [r.t for r in store.read("accepted", 4).selectExpr("ts div 1000 % 100000 AS t").collect()]
    assert len(left) == 3
    good, _ = fold_batch(events(spark, [("a", 10, "s", "good"), ("b", 9100, "s", "good")]), 4, store, lag_s=1000)
    assert plain(good) == [("a", 10, "s")]  # later than the lag: passes as new


def test_empty_micro_batches(spark, tmp_path):
    none = events(spark, [("a", 0, "r", "good")]).limit(0)
    store = FoldStore(spark, str(tmp_path / "a"))
    assert [x.count() for x in fold_batch(none, 0, store)] == [0, 0]
    assert outcome(*fold_batch(events(spark, [("a", 0, "r", "good")]), 1, store)) == ([("a", 0, "r")], [])
    store = FoldStore(spark, str(tmp_path / "b"))
    assert fold_changes(none, 0, store).count() == 0
    assert fold_changes(events(spark, [("a", 0, "r", "good")]), 1, store).count() == 1
    assert fold_changes(none, 2, store).count() == 0


def test_equal_copies_and_ties_in_a_changelog(spark, tmp_path):
    rows = [("a", 10, "s", "good"), ("a", 10, "s", "good"), ("a", 10, "r", "forged")]
    store = FoldStore(spark, str(tmp_path))
    fold_changes(events(spark, rows[:1]), 0, store)
    got = fold_changes(events(spark, rows[1:]), 1, store).select("outcome", "op", "relay").collect()
    good, bad = dedup.ingress_fold(events(spark, rows))
    assert (good.count(), bad.count()) == (1, 1)
    assert [(r.outcome, r.op, r.relay) for r in got if r.outcome == "quarantine"] == [("quarantine", 1, "r")]
    assert sum(r.op for r in got if r.outcome == "pass") == 0
    staging.release(spark)
