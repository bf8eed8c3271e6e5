"""Notes released by their own time, and scores kept across micro-batches."""

import os
import time

from pyspark.sql import functions as F

from noteflow.operators.scoring import ModelScorer, score_once
from noteflow.streaming import run, sinks
from noteflow.streaming.fold_state import FoldStore
from noteflow.streaming.release import ReleaseQueue
from noteflow.streaming.score_memory import ScoreMemory


def test_notes_of_two_micro_batches_go_out_by_their_own_time(spark, tmp_path):
    now = [100.0]
    queue = ReleaseQueue(FoldStore(spark, str(tmp_path / "state")), 1000, clock=lambda: now[0])
    out = []
    target = lambda df, output, batch_id: out.append((output, batch_id, sorted(r.id for r in df.collect())))
    queue.add(spark.range(2), 0)
    now[0] = 100.6
    queue.add(spark.range(5, 6), 1)
    assert queue.release([target]) == [] and not out
    now[0] = 101.1
    assert queue.release([target]) == [0]
    now[0] = 101.5
    assert queue.release([target]) == []
    now[0] = 101.7
    assert queue.release([target]) == [1] and queue.release([target]) == []
    assert out == [("notes", 0, [0, 1]), ("notes", 1, [5])]


def test_a_release_that_fails_is_repeated_in_place(spark, tmp_path):
    import pytest

    queue = ReleaseQueue(FoldStore(spark, str(tmp_path / "state")), 0)
    queue.add(spark.range(3), 4)

    def down(*_):
        raise RuntimeError("down")

    with pytest.raises(sinks.PublishError):
        queue.release([sinks.file_target(str(tmp_path / "out")), down])
    assert queue.release([sinks.file_target(str(tmp_path / "out"))]) == [4]
    assert spark.read.parquet(str(tmp_path / "out" / "notes")).count() == 3


def test_a_clock_beside_the_flow_releases_notes(spark, tmp_path):
    queue = ReleaseQueue(FoldStore(spark, run.state_folder(str(tmp_path / "flow"))), 1500)
    queue.add(spark.range(3), 0)
    clock = run.release_stream(spark, str(tmp_path / "clock"), str(tmp_path / "flow"), [sinks.file_target(str(tmp_path / "out"))])
    start = time.monotonic()
    while not os.path.exists(tmp_path / "out" / "notes" / "batch_id=0" / "_SUCCESS") and time.monotonic() - start < 60:
        time.sleep(0.2)
    clock.stop()
    assert spark.read.parquet(str(tmp_path / "out" / "notes")).count() == 3


def test_an_input_is_scored_once_over_micro_batches(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def load():
        def model(urls):
            with open(calls, "a") as log:
                log.write("".join(f"{u}\n" for u in urls))
            if "bad" in urls:
                raise ValueError("no")
            return [len(u) for u in urls]

        return model

    store, now = FoldStore(spark, str(tmp_path / "state")), [1000.0]
    scorer = ModelScorer(load, "bigint", attempts=2, pause_s=0.0)

    def batch(n, urls):
        rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string")
        memory = ScoreMemory(store, n, keep_s=100, clock=lambda: now[0])
        got = score_once(rows, "url", scorer, ["id"], memory=memory)
        return sorted((r.url, r.response.ok, r.response.data) for r in got.select("url", F.col("response")).collect())

    assert batch(0, ["a", "a", "bb"]) == [("a", True, 1), ("a", True, 1), ("bb", True, 2)]
    assert batch(1, ["a", "bad", "ccc"]) == [("a", True, 1), ("bad", False, None), ("ccc", True, 3)]
    assert batch(1, ["a", "bad", "ccc"])[0] == ("a", True, 1)  # run again
    logged = open(calls).read().split()
    assert logged.count("a") == 1 and logged.count("bb") == 1 and logged.count("bad") >= 2
    now[0] = 1101.0  # expired
    batch(2, ["a"])
    assert open(calls).read().split().count("a") == 2
