import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from noteflow import staging
from noteflow.operators import dedup
from noteflow.operators.scoring import NativeScorer
from noteflow.plans import flow
from noteflow.schema import FlowOptions
from noteflow.sources import events as sources
from noteflow.sources import views
from noteflow.staging import cut_lineage
from noteflow.streaming import run, sinks

SF = "/root/testdata/sf0.001"
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def options(**kw):
    return FlowOptions.all_tasks(
        scorers={"nsfw": NativeScorer(views.nsfw_response)}, note_delay_ms=0, **kw
    )


@pytest.fixture(scope="module")
def notes(spark):
    return cut_lineage(views.notes(spark, SF), "notes")


def same_rows(a, b):
    a, b = a.select(sorted(a.columns)), b.select(sorted(a.columns))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_stream_equals_batch_over_two_runs(spark, notes, tmp_path):
    """State from the first run decides over arrivals of the second."""
    arrivals, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    cut = notes.selectExpr("percentile_approx(unix_millis(arrival_ts), 0.5) AS m").first().m
    halves = [F.unix_millis("arrival_ts") <= cut, F.unix_millis("arrival_ts") > cut]
    for half in halves:
        notes.filter(half).write.mode("append").json(arrivals, timestampFormat=STAMP)
        run.flow_stream(
            sources.stream_events(spark, arrivals, kinds=None), options(), state,
            [sinks.file_target(out)], [sinks.file_target(out)], available_now=True,
        ).awaitTermination()
    expected = flow.run_flow(notes, options())
    for output, df in {
        "notes": expected.notes, "others": expected.others, "records_gating": expected.gating,
        "records_later": expected.later, "messages_events": expected.event_messages,
        "messages_gating": expected.gating_messages, "messages_later": expected.later_messages,
        "audit": expected.audit,
    }.items():
        got = spark.read.parquet(os.path.join(out, output)).drop("batch_id")
        assert got.count() > 0
        assert same_rows(got, df), output


def test_signature_verdicts_reach_the_stream(spark, notes, tmp_path):
    signed = notes.withColumn("sig_ok", F.char_length("content") % 5 != 0)
    signed.write.json(str(tmp_path / "in"), timestampFormat=STAMP)
    events = sources.stream_events(spark, str(tmp_path / "in"), kinds=None, extra="sig_ok boolean")
    target = sinks.file_target(str(tmp_path / "out"))
    run.flow_stream(events, FlowOptions(note_delay_ms=0), str(tmp_path / "state"), [target], [target],
                    available_now=True, sig_ok="sig_ok").awaitTermination()
    expected = flow.run_flow(signed, FlowOptions(), sig_ok="sig_ok")
    got = spark.read.parquet(str(tmp_path / "out" / "notes"))
    assert got.filter("NOT sig_ok").isEmpty() and got.count() == expected.notes.count() > 0
    audit = spark.read.parquet(str(tmp_path / "out" / "audit"))
    assert audit.filter("bucket = 'invalid_events'").count() == expected.quarantine.count()


def test_state_walks_like_the_batch_fold(spark, tmp_path):
    """Repeats, bad shapes and forged copies of few ids, in several micro-batches."""
    from tests.test_ingest_dedup import events, walk

    rows = [
        (f"n{i % 5}", 37 * i, f"r{i % 3}", ["good", "bad", "forged", "good"][(i * 7) % 11 % 4])
        for i in range(240)
    ]
    whole = events(spark, rows)
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    run.use_rocksdb(spark)
    got = []
    for part in range(2):
        whole.filter((F.col("second") >= 4440) == (part == 1)).write.mode("append").parquet(source)
        stream = run.dedup_stream(spark.readStream.schema(whole.schema).parquet(source))
        stream.writeStream.foreachBatch(
            lambda df, _: got.extend((r.outcome, r.name, r.second, r.relay) for r in df.collect())
        ).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    passed, quarantined = walk(rows)
    assert sorted(g[1:] for g in got if g[0] == "pass") == passed
    assert sorted(g[1:] for g in got if g[0] == "quarantine") == quarantined


def test_events_without_arrival_time_arrive_now(spark, tmp_path):
    from tests.test_ingest_dedup import events

    rows = [("a", 0, "r", "good"), ("a", 9, "r", "good"), ("b", 0, "r", "forged")]
    raw = events(spark, rows).drop("arrival_ts", "relay")
    good, quarantine = dedup.ingress_fold(raw)
    assert (good.count(), quarantine.count()) == (1, 1)
    raw.write.parquet(str(tmp_path / "in"))
    run.use_rocksdb(spark)
    got = []
    run.dedup_stream(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(
        lambda df, _: got.extend(r.outcome for r in df.collect())
    ).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == ["pass", "quarantine"]


def test_counts_run_over_every_arrival(spark, notes, tmp_path):
    folder = str(tmp_path / "in")
    notes.write.json(folder, timestampFormat=STAMP)
    target = sinks.file_target(str(tmp_path / "out"))
    run.count_stream(
        sources.stream_events(spark, folder, kinds=None), [target], str(tmp_path / "cp"), available_now=True,
    ).awaitTermination()
    totals = spark.read.parquet(str(tmp_path / "out" / "relay_counts"))
    last = totals.agg(F.max("batch_id")).first()[0]
    assert totals.filter(F.col("batch_id") == last).agg(F.sum("arrivals")).first()[0] == notes.count()


def test_permissive_reading(spark):
    lines = spark.createDataFrame(
        [('{"id":"a","kind":"x","tags":[["t"]],"content":"c"}',), ("not json",)], "line string"
    )
    rows = lines.select(sources.parse_events(F.col("line")).alias("e")).select("e.*").collect()
    assert rows[0].id == "a" and rows[0].kind is None and rows[0].content == "c"
    assert rows[1].id is None


def test_publish_tries_once_more(spark):
    df, calls = spark.range(1), []

    def failing(times, message="down"):
        def write(_df, output, batch_id):
            calls.append(output)
            if len(calls) <= times:
                raise RuntimeError(message)

        return write

    assert sinks.publish(df, "x", 0, [failing(1)]) and len(calls) == 2
    calls.clear()
    assert not sinks.publish(df, "x", 0, [failing(9)]) and len(calls) == 2
    calls.clear()
    assert not sinks.publish(df, "x", 0, [failing(9, " ")]) and len(calls) == 2
    calls.clear()
    good = []
    assert sinks.publish(df, "x", 0, [lambda *_: good.append(1), failing(1, "")])
    assert len(good) == 1 and len(calls) == 2

    def wrong(d, output, batch_id):
        calls.append(output)
        d.select("no such column")

    calls.clear()
    with pytest.raises(AnalysisException):
        sinks.publish(df, "x", 0, [wrong])
    assert len(calls) == 1


def test_order_delay_and_failure(spark):
    import time

    one = spark.range(1)
    result = flow.FlowResult(one, one, one, lambda: late, one, one, one, one)
    late = spark.createDataFrame([("t", "i")], "task string, id string").selectExpr(
        "id", "'p' AS pubkey", "1L AS created_at", "1 AS kind", "array(array('a')) AS tags", "'c' AS content", "'' AS sig", "task")
    log = []
    target = lambda df, output, batch_id: log.append((output, time.monotonic()))
    sinks.publish_ordered(result, 3, [target], [target], note_delay_ms=300)
    names = [n for n, _ in log]
    assert names == ["messages_events", "records_gating", "others", "notes", "messages_gating", "audit",
                     "records_later", "messages_later"]
    when = dict(log)
    assert when["notes"] - when["records_gating"] >= 0.3

    def down(df, output, batch_id):
        raise RuntimeError("down")

    with pytest.raises(sinks.PublishError):
        sinks.publish_ordered(result, 3, [down])


def test_failing_late_models_hold_nothing_up(spark, notes):
    """Sentiment that cannot even be planned: notes, messages and gating records are out before."""

    def unplannable(df, *_):
        raise RuntimeError("no model")

    class Broken:
        apply = staticmethod(unplannable)

    broken = FlowOptions.all_tasks(
        scorers={"nsfw": NativeScorer(views.nsfw_response), "sentiment": Broken()}, note_delay_ms=0)
    written = []
    with pytest.raises(RuntimeError, match="no model"):
        sinks.publish_ordered(flow.run_flow(notes, broken), 0, [lambda d, o, b: written.append(o)],
                              [lambda d, o, b: written.append(o)])
    assert written == ["messages_events", "records_gating", "others", "notes", "messages_gating", "audit"]


def test_frames_for_a_broker(spark, notes):
    import json

    result = flow.run_flow(notes, options())
    for df, output in ((result.notes, "notes"), (result.gating, "records"), (result.messages, "m"), (result.audit, "a")):
        frame = sinks.kafka_frame(df, output)
        assert frame.columns == ["topic", "key", "value"]
        row = frame.first()
        body = json.loads(row.value)
        if output != "a":
            assert row.key == body["id"] and "relay" not in body and "task" not in body and "sig" in body


def test_replayed_batch_is_there_once(spark, tmp_path):
    target = sinks.file_target(str(tmp_path))
    for _ in range(2):
        sinks.publish(spark.range(5), "x", 4, [target])
    sinks.publish(spark.range(2), "x", 5, [target])
    assert spark.read.parquet(str(tmp_path / "x")).count() == 7


def test_side_outputs_as_json_lines(spark, tmp_path):
    import json

    df = spark.createDataFrame([("a/1", '{"x":1}'), ("b", '{"x":2}')], "topic string, value string")
    assert sinks.publish(df, "messages", 0, [sinks.file_target(str(tmp_path), "text")])
    back = spark.read.text(str(tmp_path / "messages")).collect()
    assert sorted((r.topic, json.loads(r.value)["x"]) for r in back) == [("a/1", 1), ("b", 2)]


def test_switched_off_tasks_leave_no_trace(spark, notes):
    off = flow.run_flow(notes, FlowOptions())
    assert off.records.count() == 0
    assert {r.topic for r in off.messages.select("topic").distinct().collect()} == {"nostr-events"}
    language = flow.run_flow(notes, FlowOptions(toxicity=True, sentiment=True, topic=True))
    assert language.records.count() == 0


def test_nothing_is_emitted_beyond_the_rules(spark, notes):
    result = flow.run_flow(notes, options())
    by_task = {r.task: r["count"] for r in result.records.groupBy("task").count().collect()}
    n = result.notes.count()
    assert all(c <= n for c in by_task.values())
    assert by_task["nostr-sentiment-classification"] == by_task["nostr-topic-classification"]
    assert dedup.dedup_ttl(notes).count() <= notes.count()
    ids = result.records.select("id")
    assert ids.filter("id rlike '^[0-9a-f]{64}$'").count() == ids.count()


def test_staged_files_are_released_by_scope(spark):
    outside = cut_lineage(spark.range(3), "kept")
    with staging.scope(spark):
        inside = cut_lineage(spark.range(3), "gone")
        path = inside.inputFiles()[0].removeprefix("file:").removeprefix("//")
        assert os.path.exists(path)
    assert not os.path.exists(path)
    assert outside.count() == 3
    assert staging.release(spark) > 0


def test_rounds_keep_what_the_next_round_reads(spark):
    with staging.scope(spark):
        rounds, frame, paths = staging.Rounds(spark), spark.range(4), []
        for _ in range(4):
            frame = rounds.cut(frame.selectExpr("id + 1 AS id"), "round")
            paths.append(frame.inputFiles()[0].removeprefix("file:").removeprefix("//"))
            rounds.turn()
        assert [os.path.exists(path) for path in paths] == [False, False, False, True]
        assert sorted(r.id for r in frame.collect()) == [4, 5, 6, 7]
    assert not os.path.exists(paths[-1])


@pytest.mark.parametrize("retention_s, late", [(None, []), (3600, ["a", "b"])])
def test_repeats_later_than_the_retention(spark, tmp_path, retention_s, late):
    """Without a retention a repeat is found however late it comes; with one it passes as new."""
    from tests.test_ingest_dedup import events

    batches = [
        [("a", 0, "r", "good"), ("b", 0, "r", "good"), ("z", 9000, "r", "good")],
        [("b", 9000, "r", "good"), ("y", 9001, "r", "good")],
        [("x", 9002, "r", "good")],
        [("a", 10, "s", "good"), ("b", 10, "s", "good"), ("b", 9010, "s", "good")],
    ]
    run.use_rocksdb(spark)
    got, source = [], str(tmp_path / "in")
    for rows in batches:
        events(spark, rows).write.mode("append").parquet(source)
        schema = spark.read.parquet(source).schema
        stream = run.dedup_stream(spark.readStream.schema(schema).parquet(source), retention_s=retention_s)
        part = []
        stream.writeStream.foreachBatch(
            lambda df, _, part=part: part.extend((r.name, r.second) for r in df.collect())
        ).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        got.append(sorted(part))
    assert got[:3] == [[("a", 0), ("b", 0), ("z", 9000)], [("b", 9000), ("y", 9001)], [("x", 9002)]]
    assert got[3] == [(name, 10) for name in late]


def test_retention_is_at_least_the_ttl(spark, notes):
    with pytest.raises(ValueError, match="retention_s"):
        run.dedup_stream(notes, 300, retention_s=299)
