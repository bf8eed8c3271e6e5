"""The whole flow over a frame of arrivals, in batch or inside one micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.functions import constants as K
from noteflow.functions.constants import TASKS
from noteflow.operators import classify, dedup, ingest, media, records
from noteflow.operators.scoring import without_pause
from noteflow.schema import FlowOptions
from noteflow.staging import TEXTS, cut_lineage, scope


#: Notes put off that may be named to every task: some 20 MB.
LATE_KEYS = 100_000


@dataclass(frozen=True)
class FlowResult:
    """``gating`` records come before the notes. ``later`` records are made when first asked for,
    from the staged notes, and written once for all that read them."""

    notes: DataFrame
    others: DataFrame
    gating: DataFrame
    make_later: Callable[[], DataFrame]
    event_messages: DataFrame
    gating_messages: DataFrame
    audit: DataFrame
    quarantine: DataFrame
    #: Notes put off because a gating model failed on them, with ``attempt``, how often it has.
    put_off: DataFrame | None = None

    @cached_property
    def later(self) -> DataFrame:
        return cut_lineage(self.make_later(), "later")

    @property
    def later_messages(self) -> DataFrame:
        return records.text_messages(self.later)

    @property
    def records(self) -> DataFrame:
        return self.gating.unionByName(self.later)

    @property
    def messages(self) -> DataFrame:
        return self.event_messages.unionByName(self.gating_messages).unionByName(self.later_messages)


def _needed_texts(classified: DataFrame, options: FlowOptions) -> DataFrame:
    """What records, audit rows and the late tasks need: only English or flagged notes keep texts."""
    flagged = F.col("is_toxic") if "is_toxic" in classified.columns else F.lit(False)
    late = F.col("is_english") if options.sentiment or options.topic else F.lit(False)
    tasks = [c for c in (*TASKS, "is_toxic", "failed", "attempt", "arrival_ts", "relay") if c in classified.columns]
    return classified.select(
        "id", "pubkey", "created_at", *tasks, "is_english",
        F.when(flagged, F.col("content")).alias("content"),
        F.when(flagged | late, F.col("clean")).alias("clean"),
    )


def enrich(fresh: DataFrame, quarantine: DataFrame, options: FlowOptions, memory=None,
           again: DataFrame | None = None) -> FlowResult:
    """Classify what passed the ingress. ``fresh`` and ``quarantine`` are read several times,
    so they are files; the costly intermediates are written once as well. ``memory`` keeps the
    scores of URLs from one micro-batch to the next.

    ``again`` holds notes of earlier micro-batches with ``attempt``, the times a gating model has failed on
    them. If it is given (it may be empty), nothing waits for a failing model, and notes it fails on before
    the last micro-batch they may have are ``put_off``: they have no output yet, and hold up no other note.
    """
    notes, others = ingest.route_by_kind(fresh)
    first = replace(options, sentiment=False, topic=False)
    put_off = None
    if again is not None:
        notes = notes.withColumn("attempt", F.lit(0)).unionByName(again)
        first = replace(first, scorers={
            task: without_pause(s) if task in ("language", "toxicity") else s for task, s in first.scorers.items()})
        tried = classify.classify_text(notes.withColumn("failed", F.lit(False)), first)
    else:
        tried = classify.classify_text(notes, first)
    classified = cut_lineage(_needed_texts(tried, options), "classified", compression=TEXTS)
    if again is not None:
        late = F.col("failed") & (F.col("attempt") + 1 < K.SCORE_ATTEMPTS)
        keys = ["id", "arrival_ts", "relay"]
        late_keys = classified.filter(late).select(*[F.col(c).alias(f"{c}_") for c in keys])
        if late_keys.count() <= LATE_KEYS:  # else whole texts are shuffled to find them
            late_keys = F.broadcast(late_keys)
        same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in keys]
        put_off = notes.join(late_keys, same, "left_semi").withColumn("attempt", F.col("attempt") + 1)
        notes = notes.join(late_keys, same, "left_anti").drop("attempt")
        classified = classified.filter(~late)
    gating = records.text_records(classified, options.publisher)
    gating_messages = records.text_messages(gating)
    audit = records.invalid_audit(quarantine)
    if "is_toxic" in classified.columns:
        audit = audit.unionByName(records.toxicity_audit(classified, options))
    if options.nsfw:
        scored = cut_lineage(
            media.nsfw_url_records(notes, options.scorers["nsfw"], options.media_patterns, memory), "media"
        )
        nsfw_out = records.nsfw_records(scored, options.publisher)
        gating_messages = gating_messages.unionByName(records.nsfw_messages(nsfw_out))
        audit = audit.unionByName(records.nsfw_audit(scored))
        gating = gating.unionByName(
            nsfw_out.filter("size(records) > 0").select(*records.RECORD_COLUMNS)
        )

    def later() -> DataFrame:
        english = classified.filter("is_english").select("id", "pubkey", "created_at", "clean", "is_english")
        return records.text_records(classify.late_tasks(english, options), options.publisher)

    return FlowResult(
        notes, others, gating, later, records.event_messages(fresh), gating_messages, audit, quarantine,
        put_off)


def settle(fold: Callable[[], tuple[DataFrame, DataFrame]], spark: SparkSession, options: FlowOptions) -> tuple[DataFrame, DataFrame]:
    """(fresh, quarantine) of the ingress that ``fold`` makes, staged; what the fold staged goes."""
    with scope(spark):
        good, quarantine = fold()
        fresh = cut_lineage(ingest.freshness(good, options.fresh_minutes), "fresh", compression=TEXTS, outlives=True)
        return fresh, cut_lineage(quarantine, "quarantine", compression=TEXTS, outlives=True)


def run_ingress(
    events: DataFrame, options: FlowOptions, sig_ok: str | None = None, row_id: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(fresh, quarantine) of a batch, for ``enrich`` under any switches."""
    return settle(lambda: dedup.ingress_fold(events, options.dedup_ttl_s, sig_ok, row_id), events.sparkSession, options)


def run_flow(
    events: DataFrame, options: FlowOptions, sig_ok: str | None = None, row_id: str | None = None
) -> FlowResult:
    """Batch: the ingress, its results staged, then every output of the flow."""
    return enrich(*run_ingress(events, options, sig_ok, row_id), options)
