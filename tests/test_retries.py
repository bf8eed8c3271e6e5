"""A failing model holds up its own note only."""

from pyspark.sql import functions as F

from noteflow.operators.scoring import ModelScorer
from noteflow.plans.flow import enrich
from noteflow.schema import FlowOptions
from noteflow.streaming.fold_state import FoldStore
from noteflow.streaming.retries import RetryTable
from tests.test_ingest_dedup import events


def detector(broken):
    """A language model that fails on texts with a word of ``broken`` and calls all others English."""

    def load():
        def model(texts):
            if any(d in t for t in texts for d in broken):
                raise ValueError("down")
            return [[{"confidence": 99.0, "language": "en"}] for _ in texts]

        return model

    return ModelScorer(load, "array<struct<confidence: double, language: string>>", pause_s=60.0)


def notes(spark, names):
    rows = events(spark, [(n, i, "r", "good") for i, n in enumerate(names)])
    return rows.select("id", "pubkey", "created_at", "kind", "tags", "content", "sig", "relay", "arrival_ts")


def test_failed_notes_come_back_and_then_have_the_default(spark, tmp_path):
    now = [1000.0]
    table = RetryTable(FoldStore(spark, str(tmp_path)), pause_s=5.0, clock=lambda: now[0])
    none = notes(spark, ["x"]).limit(0)

    def batch(n, fresh, broken):
        options = FlowOptions(language=True, scorers={"language": detector(broken)})
        result = enrich(fresh, none, options, again=table.taken(n, fresh))
        table.add(result.put_off, n)
        out = sorted(r.content for r in result.notes.collect())
        found = {r.content.split('"confidence":')[1][:2] for r in result.gating.collect()}
        return out, result.put_off.count(), found

    one = notes(spark, ["one", "two", "three"])
    out, late, found = batch(0, one, ["one"])
    assert (out, late) == (["text three", "text two"], 1)
    assert batch(1, none, [])[:2] == ([], 0)  # not due yet
    now[0] += 6
    for _replay in range(2):
        again, left, found = batch(2, none, ["one"])
        assert (again, left) == (["text one"], 0)
    assert found == {"0,"}  # the default of the task
    now[0] += 60
    assert batch(3, notes(spark, ["four"]), [])[:2] == (["text four"], 0)
    assert 0 not in table.store.versions("retries")


def test_without_retries_nothing_is_put_off(spark):
    options = FlowOptions(language=True, scorers={"language": detector([])})
    result = enrich(notes(spark, ["a"]), notes(spark, ["x"]).limit(0), options)
    assert result.put_off is None and result.notes.count() == 1
    assert result.gating.filter(F.col("content").contains("99")).count() == 1
