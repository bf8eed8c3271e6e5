"""Event-level operators: validity, freshness, routing, counting and backfill."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteflow.functions import constants as K
from noteflow.functions.jsonio import event_id
from noteflow.staging import TEXTS, cut_lineage

GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def with_arrival(events: DataFrame) -> DataFrame:
    """Events without an arrival time arrive now; those without a relay column have none."""
    if "relay" not in events.columns:
        events = events.withColumn("relay", F.lit(None).cast("string"))
    if "arrival_ts" not in events.columns:
        return events.withColumn("arrival_ts", F.current_timestamp())
    return events.withColumn("arrival_ts", F.coalesce("arrival_ts", F.current_timestamp()))


def multi_relay_union(sources: dict[str, DataFrame]) -> DataFrame:
    """All relays as one frame; each event keeps the relay it came from."""
    tagged = [df.withColumn("relay", F.lit(relay)) for relay, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def relay_counts(events: DataFrame) -> DataFrame:
    """Arrivals per relay, counted before any filter. Partial counts keep the shuffle tiny."""
    return events.groupBy("relay").agg(F.count(F.lit(1)).alias("arrivals"))


def of_kinds(events: DataFrame, kinds=(K.NOTE_KIND,)) -> DataFrame:
    return events.filter(F.col("kind").isin(list(kinds)))


def backfill_latest_per_relay(
    events: DataFrame, n: int = K.BACKFILL_PER_RELAY, salts: int = 256
) -> DataFrame:
    """The newest ``n`` events of each relay.

    A relay may hold a third of all rows. Up to the optimizer's group-limit threshold each
    map task keeps its own ``n`` before the shuffle; above it the ranking is done twice,
    first within salted parts of a relay.
    """
    newest = [F.col("created_at").desc(), F.col("id"), F.col("arrival_ts")]
    limit = int(events.sparkSession.conf.get(GROUP_LIMIT_CONF, "1000"))
    if n >= limit:
        part = F.pmod(F.xxhash64("id", "arrival_ts"), F.lit(salts))
        within = Window.partitionBy("relay", "_part").orderBy(*newest)
        events = (
            events.withColumn("_part", part)
            .withColumn("_rank", F.row_number().over(within))
            .filter(F.col("_rank") <= n)
            .drop("_part", "_rank")
        )
    per_relay = Window.partitionBy("relay").orderBy(*newest)
    return (
        events.withColumn("_rank", F.row_number().over(per_relay))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )


def valid_structure() -> Column:
    """Every field present with its type, a 64-digit hex author, no NULL inside the tags."""
    tag_ok = lambda t: t.isNotNull() & F.coalesce(
        F.forall(t, lambda v: v.isNotNull()), F.lit(False)
    )
    return F.coalesce(
        F.col("kind").isNotNull()
        & F.col("created_at").isNotNull()
        & F.col("content").isNotNull()
        & F.col("pubkey").rlike(r"^[a-f0-9]{64}\z")
        & F.col("tags").isNotNull()
        & F.forall("tags", tag_ok),
        F.lit(False),
    )


def intact(sig_ok: str | None = None) -> Column:
    """The id is the hash of the content; ``sig_ok`` names a column with a signature check."""
    same = F.col("id") == event_id(*[F.col(c) for c in ("pubkey", "created_at", "kind", "tags", "content")])
    if sig_ok:
        same = same & F.col(sig_ok)
    return F.coalesce(same, F.lit(False))


def integrity_split(events: DataFrame, sig_ok: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) among structurally valid events. In batch they are written with their verdict, so that
    each is made and hashed once for both."""
    checked = events.filter(valid_structure())
    if events.isStreaming:
        return checked.filter(intact(sig_ok)), checked.filter(~intact(sig_ok))
    judged = cut_lineage(checked.withColumn("_intact", intact(sig_ok)), "judged", ("_intact",), TEXTS)
    return judged.filter("_intact").drop("_intact"), judged.filter("NOT _intact").drop("_intact")


def freshness(events: DataFrame, minutes: int = K.FRESH_MINUTES) -> DataFrame:
    """Not older than ``minutes`` at arrival, the limit included; future dates pass."""
    floor_s = F.floor((F.unix_millis("arrival_ts") - F.lit(minutes * 60_000)) / 1000)
    return events.filter(F.col("created_at") >= floor_s)


def parse_kind(kind: Column) -> Column:
    """Leading integer of a text, as ``parseInt`` reads it; NULL if there is none."""
    digits = F.regexp_extract(kind, rf"^[{K.SPACE}]*([+-]?\d+)", 1)
    return digits.try_cast("int")


def route_by_kind(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, others); an unreadable kind is not a note."""
    kind = F.col("kind")
    if dict(events.dtypes)["kind"] == "string":
        kind = parse_kind(kind)
    is_note = F.coalesce(kind == K.NOTE_KIND, F.lit(False))
    return events.filter(is_note), events.filter(~is_note)
