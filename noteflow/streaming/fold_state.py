"""Exact repeat removal on a stream by the fold of the batch, a micro-batch at a time.

A micro-batch is staged; key, time, order and verdicts of its arrivals are folded against the times
accepted before, and whole rows are joined to the outcome at the end. No worker holds the rows of an
id: a hot one is spread over slots of time, and forged copies, which block nothing, bypass the fold.

What is kept between micro-batches are written tables that name their micro-batch: a replay writes
its own again and reads only earlier ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.functions import constants as K
from noteflow.operators import dedup
from noteflow.operators.ingest import with_arrival
from noteflow.staging import TEXTS, cut_lineage, unsorted_writes

#: How far one relay may lag behind its own latest arrival before the times it could repeat are freed.
LAG_S = 86_400
#: Micro-batches after which the accepted times are rewritten without those that are free.
REWRITE = 20
#: The micro-batch of what a batch run left.
BEFORE = -1


class FoldStore:
    """Tables below ``path``: ``part=n`` is what micro-batch n added, ``base=n`` all up to n."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, table: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, table: str) -> dict[str, list[int]]:
        """The numbers of the whole ones among the parts and bases of a table."""
        path, files = self._folder(table)
        found: dict[str, list[int]] = {"part": [], "base": []}
        for status in files.listStatus(path) if files.exists(path) else ():
            kind, _, number = status.getPath().getName().partition("=")
            done = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if kind in found and files.exists(done):
                found[kind].append(int(number))
        return {kind: sorted(numbers) for kind, numbers in found.items()}

    def write(self, table: str, version: int, df: DataFrame, kind: str = "part") -> None:
        with unsorted_writes(df.sparkSession):
            df.write.mode("overwrite").option("compression", TEXTS).parquet(f"{self.path}/{table}/{kind}={version}")

    def read(self, table: str, before: int) -> DataFrame | None:
        """All rows that micro-batches below ``before`` left; None where there are none."""
        known = self._versions(table)
        base = max((n for n in known["base"] if n < before), default=None)
        paths = [f"base={base}"] if base is not None else []
        paths += [f"part={n}" for n in known["part"] if n < before and (base is None or n > base)]
        return self.spark.read.parquet(*[f"{self.path}/{table}/{p}" for p in paths]) if paths else None

    def parts(self, table: str, versions: Sequence[int]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{table}/part={n}" for n in versions])

    def versions(self, table: str) -> list[int]:
        """The micro-batches whose parts are there."""
        return self._versions(table)["part"]

    def drop(self, table: str, version: int) -> None:
        path, files = self._folder(table)
        files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"part={version}"), True)

    def rewrite(self, table: str, version: int, df: DataFrame) -> None:
        """``df`` as all of ``table`` up to ``version``; what an earlier base already replaced is deleted."""
        self.write(table, version, df, "base")
        known = self._versions(table)
        older = [n for n in known["base"] if n < version]
        gone = [f"base={n}" for n in older[:-1]] + [f"part={n}" for n in known["part"] if older and n <= older[-1]]
        path, files = self._folder(table)
        for name in gone:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, name), True)


def _since(arrivals: DataFrame, ttl_ms: int) -> int | None:
    """The earliest time that can matter to ``arrivals``; pushed down, it skips files of earlier times."""
    first = arrivals.agg(F.min("ts")).first()[0]
    return None if first is None else first - ttl_ms


def fold_batch(
    batch: DataFrame, batch_id: int, store: FoldStore, ttl_s: int = K.DEDUP_TTL_S, sig_ok: str | None = None,
    lag_s: int | None = LAG_S,
) -> tuple[DataFrame, DataFrame]:
    """(passed, quarantine) of a micro-batch, given those before it.

    Within a micro-batch arrivals are folded in time order. One that comes after later ones in an earlier
    micro-batch is a repeat within a ttl of any accepted arrival, before or after it; what has passed is not
    taken back (``fold_changes`` does that). Accepted times are kept until every relay seen so far has
    delivered arrivals ``lag_s`` and a ttl past them; a repeat that comes even later passes as new. With
    ``lag_s=None`` they are kept for good.
    """
    ttl_ms = ttl_s * 1000
    arrivals, rows = dedup.stage_arrivals(batch, sig_ok)
    since = _since(arrivals, ttl_ms)
    past = store.read("accepted", batch_id)
    if past is not None and since is not None:
        past = past.filter(F.col("ts") >= since)
    blocking, free = dedup.fold_arrivals(arrivals, ttl_ms, past)
    remember(store, batch_id, blocking, arrivals, ttl_ms, lag_s)
    return dedup.outcomes(blocking, free, rows)


def remember(store: FoldStore, version: int, blocking: DataFrame, arrivals: DataFrame, ttl_ms: int,
             lag_s: int | None) -> None:
    """Add the accepted times of a micro-batch and how far its relays have come."""
    store.write("accepted", version, blocking.select("key", "ts", "order"))
    store.write("relays", version, arrivals.groupBy(F.col("order.relay").alias("relay")).agg(F.max("ts").alias("latest")))
    if version % REWRITE != REWRITE - 1:
        return
    relays = store.read("relays", version + 1).groupBy("relay").agg(F.max("latest").alias("latest"))
    kept = store.read("accepted", version + 1)
    if lag_s is not None:
        slowest = relays.agg(F.min("latest")).first()[0]
        if slowest is not None:
            kept = kept.filter(F.col("ts") >= slowest - ttl_ms - lag_s * 1000)
    store.rewrite("accepted", version, kept)
    store.rewrite("relays", version, relays)


def hand_over(
    events: DataFrame, store: FoldStore, ttl_s: int = K.DEDUP_TTL_S, sig_ok: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``ingress_fold`` of a batch that leaves its accepted times to the stream that goes on from there."""
    ttl_ms = ttl_s * 1000
    arrivals, rows = dedup.stage_arrivals(events, sig_ok)
    blocking, free = dedup.fold_arrivals(arrivals, ttl_ms)
    remember(store, BEFORE, blocking, arrivals, ttl_ms, None)
    return dedup.outcomes(blocking, free, rows)


KEPT = ("key", "ts", "order", "valid")


def fold_changes(
    batch: DataFrame, batch_id: int, store: FoldStore, ttl_s: int = K.DEDUP_TTL_S, sig_ok: str | None = None,
) -> DataFrame:
    """What a micro-batch changes: rows of events with ``outcome`` and ``op``, 1 if new, -1 if taken back.

    After any sequence of micro-batches the rows whose ops sum to 1 are those that the batch fold gives for
    all arrivals, in whatever order they came. A late arrival may block others that had passed, and so
    free still others: each id is folded again from its earliest new arrival on, entered with the
    last arrival accepted before it. Arrivals, their rows and the changes are kept; earlier ones are only read
    as far as the new arrivals reach back.
    """
    ttl_ms = ttl_s * 1000
    batch = with_arrival(batch)
    place = F.concat(F.lit(f"{batch_id}-"), F.monotonically_increasing_id().cast("string"))
    store.write("rows", batch_id, batch.withColumn("place", place))
    arrivals, _ = dedup.stage_arrivals(store.parts("rows", [batch_id]), sig_ok, "place")
    store.write("arrivals", batch_id, arrivals)
    starts = cut_lineage(arrivals.groupBy(F.col("key").alias("k")).agg(F.min("ts").alias("start")), "starts")
    since = _since(arrivals, ttl_ms)
    since = 0 if since is None else since

    def touched(table: str, before: int) -> DataFrame:
        rows = store.read(table, before).filter(F.col("ts") >= since)
        return rows.join(starts, F.col("key") == F.col("k")).drop("k")

    again = cut_lineage(touched("arrivals", batch_id + 1).filter("ts >= start").drop("start"), "again", ("forged",))
    if store.read("changes", batch_id) is None:
        old = entries = None
    else:
        now = touched("changes", batch_id).groupBy(*KEPT, "outcome", "start").agg(F.sum("op").alias("n")).filter("n > 0")
        now = cut_lineage(now, "outcomes-so-far")
        old = now.filter("ts >= start").select(*KEPT, "outcome")
        last = now.filter((F.col("ts") < F.col("start")) & (F.col("outcome") != "quarantine")).groupBy("key").agg(
            F.max(F.struct("ts", "order")).alias("last"))
        entries = cut_lineage(last.select("key", "last.*"), "entries")
    first = again.filter(~F.col("forged")).groupBy("key", "ts").agg(F.min(F.struct("order", "valid")).alias("first"))
    times = first.select("key", "ts")
    if entries is not None:
        times = times.unionByName(entries.select("key", "ts"))
    accepted = cut_lineage(first.join(dedup.accepted_times(times, ttl_ms), ["key", "ts"]).select("key", "ts", "first.*"), "blocking")
    known = accepted.select("key", "ts", "order")
    free = dedup._free(again.filter("forged"), known if entries is None else known.unionByName(entries), ttl_ms)
    new = accepted.select(*KEPT, F.when(F.col("valid"), "pass").otherwise("shape").alias("outcome")).unionByName(
        free.select(*KEPT, F.lit("quarantine").alias("outcome")))
    if old is None:
        changes = new.withColumn("op", F.lit(1))
    else:
        new = cut_lineage(new, "outcomes-now")
        same = lambda a, b: (F.col(f"{a}.order.row_no") == F.col(f"{b}.order.row_no")) & (F.col(f"{a}.outcome") == F.col(f"{b}.outcome"))
        added = new.alias("n").join(old.alias("o"), same("n", "o"), "left_anti")
        taken = old.alias("o").join(new.alias("n"), same("o", "n"), "left_anti")
        changes = added.withColumn("op", F.lit(1)).unionByName(taken.withColumn("op", F.lit(-1)))
    store.write("changes", batch_id, changes)

    seen = store.parts("changes", [batch_id]).filter("outcome <> 'shape'").select(
        F.col("order.row_no").alias("place"), "outcome", "op")
    # Rows that are taken back, or pass at last, lie with the micro-batch they came in.
    origins = [r[0] for r in seen.select(F.substring_index("place", "-", 1).cast("int")).distinct().collect()]
    rows = store.parts("rows", sorted(origins)) if origins else store.parts("rows", [batch_id])
    return _changed_rows(rows, seen)


def _changed_rows(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """``rows`` at the places that are ``seen``, with their outcome and op: these go to the rows as bits, a word
    of 64 places for each kind of change, unless there are too many words to send to every task."""
    def origin(place: str):
        return F.substring_index(place, "-", 1).cast("int")

    word, bit = dedup.word_and_bit(F.substring_index("place", "-", -1).cast("bigint"))
    kinds = [(outcome, op) for outcome in ("pass", "quarantine") for op in (1, -1)]
    words = cut_lineage(seen.groupBy(origin("place").alias("origin"), word.alias("word")).agg(*[
        F.bit_or(F.when((F.col("outcome") == outcome) & (F.col("op") == op), bit)).alias(f"bits_{n}")
        for n, (outcome, op) in enumerate(kinds)]), "row-bits")
    if words.count() > dedup.WORDS // len(kinds):
        return rows.join(seen, "place").drop("place")
    found = F.array_compact(F.array(*[
        F.when(bit.bitwiseAND(F.col(f"bits_{n}")) != 0, F.struct(F.lit(outcome).alias("outcome"), F.lit(op).alias("op")))
        for n, (outcome, op) in enumerate(kinds)]))
    here = (origin("place") == F.col("origin")) & (word == F.col("word"))
    return rows.join(F.broadcast(words), here).select(*[c for c in rows.columns if c != "place"], F.inline(found))
