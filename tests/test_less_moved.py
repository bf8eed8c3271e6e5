"""Nothing is made twice, kept longer than it is read, or moved where a narrow part of it does."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from noteflow import staging
from noteflow.operators import classify, dedup
from noteflow.plans import flow
from noteflow.plans.catalog import QUERIES
from noteflow.schema import FlowOptions
from noteflow.staging import cut_lineage
from noteflow.streaming import run, sinks
from noteflow.sources import views

EVENT = "id string, pubkey string, created_at bigint, kind int, tags array<array<string>>, content string, sig string, relay string, arrival_ts timestamp"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables of a few rows: events of three relays and documents with texts."""
    folder = str(tmp_path_factory.mktemp("tables"))
    texts = ["the cat is on the mat and it is good", "you are an idiot and the trash", "la casa es muy grande y el sol", "hello"]
    spark.createDataFrame([(i, texts[i % 4] + f" {i}") for i in range(12)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.range(90).selectExpr(
        "id AS event_id", "timestamp_millis(1704067200000 + id * 40000) AS ts", "id % 5 AS user_id").write.parquet(f"{folder}/events.parquet")
    return folder


def names(spark, *kinds):
    """Files of staged folders of some names."""
    root = os.path.join(staging.shared_folder(spark), "noteflow")
    return {f for kind in kinds for f in glob.glob(f"{root}/{kind}-*/**/*", recursive=True) if os.path.isfile(f)}


def test_switches_share_the_ingress(spark, tables, monkeypatch):
    calls, fold = [], dedup.ingress_fold
    monkeypatch.setattr(dedup, "ingress_fold", lambda *a, **k: calls.append(1) or fold(*a, **k))
    got = {(r.switches, r.task): r.emitted for r in QUERIES["task_switches"](spark, tables).collect()}
    assert len(calls) == 1
    notes, by_name = views.notes(spark, tables), {
        "none": FlowOptions(), "language": FlowOptions(language=True), "toxicity, language": FlowOptions(language=True, toxicity=True)}
    for name, options in by_name.items():
        want = {r.task: r["count"] for r in flow.run_flow(notes, options).records.groupBy("task").count().collect()}
        assert {t: n for (s, t), n in got.items() if s == name} == want
    assert len(want) == 2


def test_texts_that_no_task_reads_are_not_cleaned(spark):
    notes = spark.createDataFrame([("a", "p", 1, 1, [], "some text", "", "r", None)], EVENT)

    def plan(options):
        wide = flow._needed_texts(classify.classify_text(notes, options), options)
        return wide._jdf.queryExecution().optimizedPlan().toString()

    assert "regexp" in plan(FlowOptions(language=True))
    assert "regexp" not in plan(FlowOptions()) and "Generate" not in plan(FlowOptions())


def test_what_the_fold_staged_goes_and_its_results_stay(spark, tables):
    before = names(spark, "arrivals", "blocking", "fresh", "quarantine")
    with staging.scope(spark):
        fresh, quarantine = flow.run_ingress(views.notes(spark, tables), FlowOptions())
        left = names(spark, "arrivals", "blocking", "fresh", "quarantine") - before
        assert fresh.count() + quarantine.count() > 0
    assert {os.path.relpath(f, staging.shared_folder(spark)).split("/")[1].split("-")[0] for f in left} == {"fresh", "quarantine"}
    assert names(spark, "arrivals", "blocking", "fresh", "quarantine") == before


def test_writes_delete_what_they_shuffled(spark, tmp_path):
    conf = lambda: spark.conf.get(staging.CLEANUP_CONF, "false")
    was = conf()
    with staging.unsorted_writes(spark):
        assert conf() == "true"
    assert conf() == was


def test_parts_of_a_stream_are_held_once(spark, tables):
    before = names(spark, "arrivals", "notes")
    got = QUERIES["ingress_late_arrivals"](spark, tables).collect()
    want = QUERIES["ingress_fold"](spark, tables).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and got
    left = {f for f in names(spark, "arrivals", "notes") - before if not os.path.basename(f).startswith(("_", "."))}
    assert not [f for f in left if ".json" in f or "_part=" in f]


@pytest.mark.parametrize("words", [dedup.WORDS, 0])
def test_places_give_the_rows_of_the_keyed_stream(spark, tables, tmp_path, monkeypatch, words):
    """Over two micro-batches, with exact copies, forged ones and rows without an id."""
    monkeypatch.setattr(dedup, "WORDS", words)
    notes = cut_lineage(views.notes(spark, tables), "notes")
    notes = notes.unionByName(notes.limit(7)).unionByName(notes.limit(9).withColumn("id", F.lit(None).cast("string")))
    source, folder = str(tmp_path / "in"), str(tmp_path / "rows")
    late = F.unix_millis("arrival_ts") > 1704067200000 + 45 * 40000
    run.use_rocksdb(spark)
    for check in (True, False):
        out = str(tmp_path / f"out_{check}")
        found = {}
        for part in (~late, late):
            notes.filter(part).write.mode("append").parquet(source)
            stream = spark.readStream.schema(notes.schema).parquet(source)
            run.stage_stream(stream, folder, str(tmp_path / "staged"), available_now=True).awaitTermination()
            run.repeats_stream(
                spark, folder, notes.schema, str(tmp_path / f"state_{check}"), [sinks.file_target(out)], check=check,
                available_now=True).awaitTermination()
            run.dedup_stream(stream, check=check).writeStream.format("parquet").trigger(availableNow=True).start(
                f"{out}_whole", checkpointLocation=str(tmp_path / f"whole_{check}")).awaitTermination()
        found = [sorted(map(str, spark.read.parquet(p).select("outcome", *notes.columns).collect()))
                 for p in (f"{out}/accepted", f"{out}_whole")]
        assert found[0] == found[1] and len(found[0]) > 20
        outcomes = {r.outcome for r in spark.read.parquet(f"{out}/accepted").select("outcome").distinct().collect()}
        assert outcomes == ({"pass", "quarantine"} if check else {"pass"})


def test_late_notes_are_named_to_the_texts(spark, tables):
    fresh, quarantine = flow.run_ingress(views.notes(spark, tables), FlowOptions())
    again = fresh.limit(0).withColumn("attempt", F.lit(0))
    result = flow.enrich(fresh, quarantine, FlowOptions(language=True), None, again)
    for df in (result.notes, result.put_off):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert result.notes.count() > 0 and result.put_off.count() == 0
