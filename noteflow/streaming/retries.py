"""Notes on which a model failed, until a later micro-batch takes them up again."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflow.functions import constants as K
from noteflow.streaming.fold_state import FoldStore


class RetryTable:
    """Notes with ``attempt`` and ``due_ms``; a note is due a pause per attempt after it failed.

    Which parts a micro-batch takes is written before it uses them: run again, it takes the same
    ones. Parts are deleted once a later micro-batch has begun.
    """

    def __init__(self, store: FoldStore, pause_s: float = K.SCORE_PAUSE_S, clock=time.time):
        self.store, self.pause_s, self.clock = store, pause_s, clock

    def add(self, notes: DataFrame, batch_id: int) -> None:
        """Put off ``notes`` (with ``attempt``), each for as many pauses as it has attempts."""
        now = int(self.clock() * 1000)
        due = F.lit(now) + F.col("attempt") * F.lit(int(self.pause_s * 1000))
        self.store.write("retries", batch_id, notes.withColumn("due_ms", due.cast("bigint")))

    def taken(self, batch_id: int, like: DataFrame) -> DataFrame:
        """The notes that this micro-batch takes up, with the columns of ``like`` and ``attempt``."""
        spark = self.store.spark
        taken = self.store.versions("taken")
        for earlier in [n for n in taken if n < batch_id]:
            for row in self.store.parts("taken", [earlier]).collect():
                self.store.drop("retries", row.part)
            self.store.drop("taken", earlier)
        if batch_id in taken:
            parts = [r.part for r in self.store.parts("taken", [batch_id]).collect()]
        else:
            now = self.clock() * 1000
            waiting = [n for n in self.store.versions("retries") if n < batch_id]
            parts = [n for n in waiting if (self._due(n) or 0) <= now]
            self.store.write("taken", batch_id, spark.createDataFrame([(n,) for n in parts], "part int"))
        if not parts:
            return like.limit(0).withColumn("attempt", F.lit(0))
        return self.store.parts("retries", parts).select(*like.columns, "attempt")

    def _due(self, part: int) -> int | None:
        """When the last note of a part is due, None if it has none."""
        return self.store.parts("retries", [part]).agg(F.max("due_ms")).first()[0]
