import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteflow.functions.jsonio import event_id
from noteflow.operators import dedup, ingest
from noteflow.schema import ENVELOPE
from noteflow.sources.events import file_row_id

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def greedy(times, ttl, last=None):
    kept = []
    for t in sorted(times):
        if last is None or t - last > ttl:
            kept.append(t)
            last = t
    return kept


def arrivals(spark, rows):
    """(id, second, relay) -> events that only differ in those."""
    data = [(i, T0 + timedelta(seconds=s), r) for i, s, r in rows]
    return spark.createDataFrame(data, "id string, arrival_ts timestamp, relay string")


def test_step_table_against_walking():
    rng = random.Random(7)
    for _ in range(300):
        ttl, start = rng.randint(1, 12), 100
        times = np.array(sorted(rng.sample(range(start, start + 60), rng.randint(1, 40))))
        upto, leave = dedup.step_table(times, ttl, start)
        for entry in range(start - 30, start):
            walked = greedy(times.tolist(), ttl, entry)
            expected = walked[-1] if walked else entry
            i = int(np.searchsorted(upto, entry))
            assert (leave[i] if i < len(upto) else entry) == expected


def test_composed_tables_against_walking():
    rng = random.Random(8)
    for _ in range(300):
        ttl, width = rng.randint(1, 40), rng.randint(5, 20)
        parts = [sorted(rng.sample(range(100 + n * width, 100 + (n + 1) * width), rng.randint(1, 5))) for n in range(3)]
        tables = [dedup.step_table(np.array(t), ttl, 100 + n * width) for n, t in enumerate(parts)]
        upto, leave = dedup.compose(dedup.compose(*tables[:2]), tables[2])
        for entry in range(40, 100):
            walked = greedy([t for p in parts for t in p], ttl, entry)
            i = int(np.searchsorted(upto, entry))
            assert (leave[i] if i < len(upto) else entry) == (walked[-1] if walked else entry)


@pytest.mark.parametrize("ttl, chunk, fan", [(50, 7, 2), (7, 50, 3), (1000, 10, 4), (3, 3, 2), (200, 64, 64)])
def test_tree_of_chunks_against_walking(spark, monkeypatch, ttl, chunk, fan):
    monkeypatch.setattr(dedup, "FAN", fan)
    rng = random.Random(ttl)
    rows = [("hot", rng.randint(-500, 4000)) for _ in range(900)] + [("rare", rng.randint(0, 90_000)) for _ in range(60)]
    rows += [(f"i{rng.randint(0, 20)}", rng.randint(0, 3000)) for _ in range(500)]
    frame = spark.createDataFrame(rows, "key string, ts bigint")
    got = {}
    for r in dedup.accepted_times(frame, ttl, chunk).collect():
        got.setdefault(r.key, []).append(r.ts)
    want = {}
    for k, t in rows:
        want.setdefault(k, set()).add(t)
    assert {k: sorted(v) for k, v in got.items()} == {k: greedy(v, ttl) for k, v in want.items()}


def test_ttl_is_not_extended_by_repeats(spark):
    rows = [("a", t, "r") for t in (0, 100, 300, 301, 650)]
    kept = dedup.dedup_ttl(arrivals(spark, rows))
    assert sorted((r.arrival_ts.timestamp() - T0.timestamp()) for r in kept.collect()) == [0, 301, 650]


def test_random_arrivals_and_one_hot_id(spark):
    rng = random.Random(3)
    rows = [("hot", rng.randint(0, 60_000), f"r{rng.randint(0, 2)}") for _ in range(6000)]
    rows += [(f"i{rng.randint(0, 400)}", rng.randint(0, 20_000), "r") for _ in range(4000)]
    rows += [("dense", t, "r") for t in range(0, 20_000, 7)]
    kept = dedup.dedup_ttl(arrivals(spark, rows)).groupBy("id").agg(
        F.sort_array(F.collect_list(F.unix_seconds("arrival_ts"))).alias("t")
    )
    got = {r.id: [t - int(T0.timestamp()) for t in r.t] for r in kept.collect()}
    by_id = {}
    for i, t, _ in rows:
        by_id.setdefault(i, set()).add(t)
    assert got == {i: greedy(ts, 300) for i, ts in by_id.items()}


def test_exact_copies_pass_once(spark):
    rows = [("a", 5, "r")] * 500 + [("b", 5, "r1"), ("b", 5, "r0")]
    got = dedup.dedup_ttl(arrivals(spark, rows)).collect()
    assert sorted((r.id, r.relay) for r in got) == [("a", "r"), ("b", "r0")]


def test_null_ids_are_kept(spark):
    got = dedup.dedup_ttl(arrivals(spark, [(None, 0, "r"), (None, 10, "r"), ("a", 1, "r")])).collect()
    assert sorted(str(r.id) for r in got) == ["None", "a"]


def events(spark, rows):
    """(name, second, relay, state): state is good, bad (shape) or forged."""
    author = "ab" * 32
    data = [
        (n, s, author, 1000, 1, [["t", n]], f"text {n}", "", r, T0 + timedelta(seconds=s), state)
        for n, s, r, state in rows
    ]
    df = spark.createDataFrame(
        data, "name string, second int, pubkey string, created_at bigint, kind int, "
        "tags array<array<string>>, content string, sig string, relay string, arrival_ts timestamp, state string",
    )
    fields = [F.col(c) for c in ("pubkey", "created_at", "kind", "tags", "content")]
    df = df.withColumn("id", event_id(*fields))
    df = df.withColumn("pubkey", F.when(F.col("state") == "bad", "short").otherwise(F.col("pubkey")))
    return df.withColumn(
        "content", F.when(F.col("state") == "forged", F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    )


def walk(rows, ttl=300):
    last, passed, quarantined = {}, [], []
    for n, s, r, state in sorted(rows, key=lambda x: (x[1], x[2])):
        if n in last and s - last[n] <= ttl:
            continue
        if state == "forged":
            quarantined.append((n, s, r))
            continue
        last[n] = s
        if state == "good":
            passed.append((n, s, r))
    return sorted(passed), sorted(quarantined)


def outcome(good, quarantine):
    rows = lambda df: sorted((r["name"], r["second"], r["relay"]) for r in df.collect())
    return rows(good), rows(quarantine)


def test_fold_of_repeats_and_checks(spark):
    rng = random.Random(11)
    rows = {
        (f"n{rng.randint(0, 60)}", rng.randint(0, 3000), f"r{rng.randint(0, 3)}") for _ in range(2500)
    }
    rows = [(*k, rng.choice(["good", "good", "bad", "forged"])) for k in sorted(rows)]
    assert outcome(*dedup.ingress_fold(events(spark, rows))) == walk(rows)


def test_rows_are_found_again_in_their_files(spark, tmp_path):
    """With a row id from the source only narrow columns are written."""
    rng = random.Random(5)
    rows = [
        (f"n{rng.randint(0, 20)}", rng.randint(0, 2000), "r", rng.choice(["good", "bad", "forged"]))
        for _ in range(600)
    ]
    events(spark, rows).union(events(spark, rows[:50])).repartition(5).write.parquet(str(tmp_path / "e"))
    source = spark.read.parquet(str(tmp_path / "e"))
    placed = file_row_id(source)
    assert placed.select("row_id").distinct().count() == 650
    both = [dedup.ingress_fold(source), dedup.ingress_fold(placed, row_id="row_id")]
    (good, bad), (good_again, bad_again) = [outcome(*b) for b in both]
    key = lambda rs: sorted((n, s) for n, s, _ in rs)
    assert key(bad) == key(bad_again) and key(good) == key(good_again)
    times = lambda df: sorted((r.id, r.arrival_ts) for r in df.select("id", "arrival_ts").collect())
    assert times(dedup.dedup_ttl(source)) == times(dedup.dedup_ttl(placed, row_id="row_id"))


def test_every_copy_of_a_forged_event_is_quarantined(spark):
    rows = [("a", 5, "r", "forged")] * 300 + [("a", 6, "r", "good")] + [("a", 7, "r", "forged")] * 200
    passed, quarantined = outcome(*dedup.ingress_fold(events(spark, rows).repartition(7)))
    assert passed == [("a", 6, "r")]
    assert quarantined == [("a", 5, "r")] * 300


def test_bad_shape_blocks_a_good_copy_and_forged_does_not(spark):
    rows = [
        ("x", 0, "r", "bad"), ("x", 10, "r", "good"), ("x", 301, "r", "good"),
        ("y", 0, "r", "forged"), ("y", 10, "r", "good"),
    ]
    assert outcome(*dedup.ingress_fold(events(spark, rows))) == (
        [("x", 301, "r"), ("y", 10, "r")], [("y", 0, "r")],
    )


def test_signature_column(spark):
    df = events(spark, [("a", 0, "r", "good"), ("b", 0, "r", "good")]).withColumn("sig_ok", F.col("name") == "a")
    good, quarantine = dedup.ingress_fold(df, sig_ok="sig_ok")
    assert outcome(good, quarantine) == ([("a", 0, "r")], [("b", 0, "r")])


def envelope(spark, **changes):
    row = dict(id="i", pubkey="ab" * 32, created_at=1, kind=1, tags=[["t", "x"]], content="c", sig="",
               relay="r", arrival_ts=T0)
    row.update(changes)
    names = ["id", "pubkey", "created_at", "kind", "tags", "content", "sig", "relay", "arrival_ts"]
    return spark.createDataFrame([[row[n] for n in names]], ENVELOPE)


def test_structure(spark):
    ok = lambda **c: envelope(spark, **c).select(ingest.valid_structure()).first()[0]
    assert ok() and ok(tags=[]) and ok(tags=[[]]) and ok(content="")
    assert not any([
        ok(kind=None), ok(created_at=None), ok(content=None), ok(tags=None), ok(pubkey=None),
        ok(pubkey="AB" * 32), ok(pubkey="ab" * 31), ok(pubkey="ab" * 32 + "\n"), ok(tags=[["t", None]]),
        ok(tags=[None]),
    ])


def test_freshness(spark):
    base = int(T0.timestamp())
    fresh = lambda age: ingest.freshness(envelope(spark, created_at=base - age)).count()
    assert [fresh(600), fresh(601), fresh(-5)] == [1, 0, 1]


def test_kind_routing(spark, apply):
    assert apply(ingest.parse_kind, ["1", " 1x", "+1", "-1", "x1", "", "99999999999"]) == [
        1, 1, 1, -1, None, None, None,
    ]
    df = spark.createDataFrame([("1",), ("7",), ("x",), (" 1abc",), (None,)], "kind string")
    notes, others = ingest.route_by_kind(df)
    assert notes.count() == 2 and others.count() == 3


def test_backfill_above_the_group_limit(spark):
    df = spark.range(3000).select(
        F.lit("r").alias("relay"), F.col("id").alias("created_at"), F.col("id").cast("string").alias("id"),
        F.lit(T0).alias("arrival_ts"),
    )
    got = ingest.backfill_latest_per_relay(df, n=1200).agg(F.min("created_at"), F.count("*")).first()
    assert tuple(got) == (1800, 1200)


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("cast(id % 2 AS string) AS relay", "id AS created_at", "cast(id AS string) AS id", "now() AS arrival_ts")
    plan = ingest.backfill_latest_per_relay(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_union_keeps_the_relay(spark):
    df = spark.range(2).selectExpr("cast(id AS string) AS id")
    got = ingest.multi_relay_union({"a": df, "b": df}).groupBy("relay").count().collect()
    assert sorted(map(tuple, got)) == [("a", 2), ("b", 2)]


def test_watermark_form_is_for_streams(spark, tmp_path):
    rows = [("a", 0, "r"), ("a", 10, "r"), ("b", 0, "r")]
    with pytest.raises(ValueError):
        dedup.dedup_ttl(arrivals(spark, rows), exact=False)
    source = str(tmp_path / "in")
    arrivals(spark, rows).write.parquet(source)
    stream = spark.readStream.schema(arrivals(spark, rows).schema).parquet(source)
    with pytest.raises(ValueError):
        dedup.dedup_ttl(stream)
    job = (
        dedup.dedup_ttl(stream, exact=False).writeStream.format("memory").queryName("cheap")
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()
    assert spark.table("cheap").count() == 2


def test_one_id_over_many_adjacent_chunks(spark):
    """100,000 chunks that reach one another: passed through in order, in a few tasks."""
    ttl, chunk = 1_000, 1_000
    times = spark.range(100_000).selectExpr("'a' AS key", "explode(array(id * 1000 + 3, id * 1000 + 600)) AS ts")
    got = sorted(r.ts for r in dedup.accepted_times(times, ttl, chunk).collect())
    want, last = [], None
    for n in range(100_000):
        for ts in (n * 1000 + 3, n * 1000 + 600):
            if last is None or ts - last > ttl:
                want.append(ts)
                last = ts
    assert got == want


def test_chunks_that_reach_no_other_need_no_python(spark, monkeypatch):
    """Entries of chunks without neighbours come from the plan: no tables are made for them."""
    monkeypatch.setattr(dedup, "_steps", None)
    monkeypatch.setattr(dedup, "_sorted_groups", None)
    times = spark.range(3_000).selectExpr("concat('k', id) AS key", "explode(array(id % 40, id % 40 + 900, id % 40 + 1001)) AS ts")
    got = {}
    for r in dedup.accepted_times(times, 950, 1_000).collect():
        got.setdefault(r.key, []).append(r.ts)
    want = {}
    for n in range(3_000):
        want[f"k{n}"] = [n % 40, n % 40 + 1001]
    assert {k: sorted(v) for k, v in got.items()} == want
