"""Scores that are kept from one micro-batch to the next, so that an input is scored once."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflow.streaming.fold_state import REWRITE, FoldStore

#: After this long a score counts no more, and its input is scored anew.
KEEP_S = 7 * 86_400


class ScoreMemory:
    """Good responses of earlier micro-batches, by input. Failures are not kept: they may pass later."""

    def __init__(self, store: FoldStore, batch_id: int, keep_s: int = KEEP_S, clock=time.time):
        self.store, self.batch_id = store, batch_id
        self.now_ms, self.keep_ms = int(clock() * 1000), keep_s * 1000

    def _latest(self, before: int) -> DataFrame | None:
        rows = self.store.read("scores", before)
        if rows is None:
            return None
        live = rows.filter(F.col("scored_ms") >= self.now_ms - self.keep_ms)
        return live.groupBy("input").agg(F.max("scored_ms").alias("scored_ms"),
                                         F.max_by("response", "scored_ms").alias("response"))

    def known(self, input_col: str, out: str) -> DataFrame | None:
        rows = self._latest(self.batch_id)
        return None if rows is None else rows.select(F.col("input").alias(input_col), F.col("response").alias(out))

    def remember(self, scored: DataFrame, input_col: str, out: str) -> DataFrame:
        """Keeps what is good of ``scored`` and returns it all. Now and then what has expired goes."""
        good = scored.filter(F.col(f"{out}.ok")).select(
            F.col(input_col).alias("input"), F.col(out).alias("response"), F.lit(self.now_ms).cast("bigint").alias("scored_ms"))
        self.store.write("scores", self.batch_id, good)
        if self.batch_id % REWRITE == REWRITE - 1:
            self.store.rewrite("scores", self.batch_id, self._latest(self.batch_id + 1))
        return scored
