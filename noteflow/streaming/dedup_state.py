"""Exact repeat removal on a stream: the same fold as in batch, with the accepted times per id as state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from noteflow.functions import constants as K
from noteflow.operators import dedup
from noteflow.operators.ingest import intact, valid_structure, with_arrival
from noteflow.staging import cut_lineage, even

STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PASS, QUARANTINE = "pass", "quarantine"


class FixedTtl(StatefulProcessor):
    """Keeps the times of the arrivals that block an id.

    Two of them are never within a ttl of each other, so a slot as wide holds one at most, and
    an arrival, however late, asks its own slot and the two beside it.
    """

    def __init__(self, ttl_ms: int, retention_ms: int | None = None):
        self.ttl_ms = ttl_ms
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getMapState("accepted", "slot bigint", "ts bigint")

    def _slot(self, ts: int) -> int:
        return ts // (self.ttl_ms + 1)

    def _blocks(self, ts: int, known: dict[int, int | None], empty: bool) -> bool:
        at = self._slot(ts)
        for slot in (at, at - 1, at + 1):
            if slot not in known:
                stored = None if empty else self.accepted.getValue((slot,))
                known[slot] = None if stored is None else int(stored[0])
            if known[slot] is not None and abs(ts - known[slot]) <= self.ttl_ms:
                return True
        return False

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Of the non-forged arrivals in one millisecond only the first can pass, so a hot id
        # holds no more rows than the micro-batch has milliseconds.
        # Most ids have a row or three: plain lists take a small part of the time that frames take.
        kept = []
        for part in rows:
            kept += zip(*[part[c].tolist() for c in ("ts", "relay", "copy", "forged", "valid", "payload")])
            kept.sort(key=lambda row: row[:3])
            kept = self._firsts(kept)
        empty, known, out = not self.accepted.exists(), {}, []
        for ts, _, _, forged, valid, payload in kept:
            # An arrival from long before an accepted one is no repeat of it either.
            if self._blocks(ts, known, empty):
                continue
            if forged:
                out.append((QUARANTINE, payload))
                continue
            known[self._slot(ts)] = ts
            self.accepted.updateValue((self._slot(ts),), (ts,))
            if self.retention_ms is not None:
                self.handle.registerTimer(ts + self.retention_ms)
            if valid:
                out.append((PASS, payload))
        if out:
            yield pd.DataFrame(out, columns=["outcome", "payload"], dtype=object)

    @staticmethod
    def _firsts(rows: list[tuple]) -> list[tuple]:
        """Sorted rows without those that another of their millisecond, not forged, comes before."""
        found, latest = [], None
        for row in rows:
            if row[3]:
                found.append(row)
            elif row[0] != latest:
                latest = row[0]
                found.append(row)
        return found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.accepted.removeKey((self._slot(expiredTimerInfo.getExpiryTimeInMs() - self.retention_ms),))
        yield pd.DataFrame({"outcome": [], "payload": []}, dtype=object)

    def close(self) -> None:
        pass


def dedup_stream(
    events: DataFrame, ttl_s: int = K.DEDUP_TTL_S, sig_ok: str | None = None, check: bool = True,
    retention_s: int | None = None,
) -> DataFrame:
    """Events with an ``outcome`` of ``pass`` or ``quarantine``; the others are dropped.

    ``check=False`` only removes repeats. Late order inside a micro-batch does not matter,
    arrivals are folded in time order. The source's rate limit bounds a micro-batch.

    The accepted times of an id are kept for good, so that a repeat is found however late it comes.
    With ``retention_s`` they are freed once arrivals are that far past them: state is bounded,
    and a repeat that comes later than that passes as new.
    """
    if retention_s is not None and retention_s < ttl_s:
        raise ValueError("retention_s must not be below the ttl")
    ttl_ms = ttl_s * 1000
    retention_ms = None if retention_s is None else retention_s * 1000
    events = with_arrival(events)
    whole = F.to_json(
        F.struct(*events.columns), {"ignoreNullFields": "false", "timestampFormat": _TS, "timeZone": "UTC"})
    outcomes = _keyed(events, events.columns, whole, ttl_ms, sig_ok, check, retention_ms)
    event = F.from_json("payload", events.schema, {"timestampFormat": _TS, "timeZone": "UTC"})
    return outcomes.select("outcome", event.alias("event")).select("outcome", "event.*")


def dedup_places(
    rows: DataFrame, columns: Sequence[str], ttl_s: int = K.DEDUP_TTL_S, sig_ok: str | None = None, check: bool = True,
    retention_s: int | None = None,
) -> DataFrame:
    """As ``dedup_stream``, over staged rows of ``columns`` that have a ``place``, a short text: ``outcome, place``.

    Only ids, times, verdicts and places are shuffled and go through Python; ``rows_at`` finds the rows again."""
    if retention_s is not None and retention_s < ttl_s:
        raise ValueError("retention_s must not be below the ttl")
    retention_ms = None if retention_s is None else retention_s * 1000
    outcomes = _keyed(rows, columns, F.col("place"), ttl_s * 1000, sig_ok, check, retention_ms)
    return outcomes.withColumnRenamed("payload", "place")


def _keyed(events: DataFrame, columns: Sequence[str], payload: Column, ttl_ms: int, sig_ok: str | None, check: bool,
           retention_ms: int | None) -> DataFrame:
    """``outcome, payload`` of the events that are not dropped, by the state of their ids."""
    valid = valid_structure() if check else F.lit(True)
    keyed = (
        events.withWatermark("arrival_ts", "0 seconds")
        .withColumn("valid", valid)
        .withColumn("forged", F.when(F.col("valid"), ~intact(sig_ok)).otherwise(False) if check else F.lit(False))
        # The clock column ends here: it drives the timers, but no late arrival is dropped.
        .select(
            F.coalesce("id", F.lit("undefined")).alias("key"),
            F.unix_millis("arrival_ts").alias("ts"),
            F.coalesce("relay", F.lit("")).alias("relay"),
            F.xxhash64(*columns).alias("copy"),
            "valid", "forged", payload.alias("payload"),
        )
    )
    return keyed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=FixedTtl(ttl_ms, retention_ms),
        outputStructType="outcome string, payload string",
        outputMode="Append",
        timeMode="EventTime",
    )


_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def with_place(rows: DataFrame) -> DataFrame:
    """Rows of Parquet files with the ``place`` they have on every reading: the number in a file and its name."""
    place = F.concat(F.col("_metadata.row_index").cast("string"), F.lit("/"), F.col("_metadata.file_name"))
    return rows.select("*", place.alias("place"))


def rows_at(folder: str, schema: StructType, seen: DataFrame) -> DataFrame:
    """The rows of Parquet files in ``folder`` at the places that are ``seen`` (``outcome, place``, staged), with
    their outcome. Places go to the rows as bits, unless there are too many words to send to every task."""
    file = F.substring_index("place", "/", -1)
    files = [r[0] for r in seen.select(file).distinct().collect()]
    read = seen.sparkSession.read.schema(schema)
    rows = with_place(read.parquet(*[f"{folder}/{name}" for name in files] or [folder]))
    word, bit = dedup.word_and_bit(F.substring_index("place", "/", 1).cast("bigint"))
    words = cut_lineage(seen.groupBy(file.alias("file"), word.alias("word")).agg(*[
        F.bit_or(F.when(F.col("outcome") == outcome, bit)).alias(outcome) for outcome in (PASS, QUARANTINE)]), "row-bits")
    if words.count() > dedup.WORDS // 4:  # a word has the name of its file
        return even(rows, "place").join(even(seen, "place"), "place").select("outcome", *schema.names)
    outcome = F.coalesce(*[F.when(bit.bitwiseAND(F.col(name)) != 0, F.lit(name)) for name in (PASS, QUARANTINE)])
    here = (file == F.col("file")) & (word == F.col("word"))
    return rows.join(F.broadcast(words), here).select(outcome.alias("outcome"), *schema.names).filter("outcome IS NOT NULL")


def use_rocksdb(spark: SparkSession) -> None:
    """The keyed state above needs the RocksDB state store."""
    spark.conf.set(STATE_STORE_CONF, ROCKSDB)
