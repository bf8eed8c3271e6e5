"""Notes that wait until some time after their gating records.

The queue is a written table: notes of a micro-batch with the time they are due, which is when their gating
records were out plus the delay. Whoever comes by first after that releases them; nobody waits.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflow.functions import constants as K
from noteflow.streaming.fold_state import FoldStore
from noteflow.streaming.sinks import PublishError, Target, publish

_one_at_a_time = threading.Lock()


class ReleaseQueue:
    def __init__(self, store: FoldStore, delay_ms: int = K.NOTE_DELAY_MS, clock=time.time):
        self.store, self.delay_ms, self.clock = store, delay_ms, clock

    def add(self, notes: DataFrame, batch_id: int) -> None:
        """Queue the notes whose gating records are out now. A replay queues them again and later."""
        due = int(self.clock() * 1000) + self.delay_ms
        self.store.write("waiting", batch_id, notes.withColumn("due_ms", F.lit(due).cast("bigint")))

    def _due(self, batch_id: int) -> int:
        """When the last note of a micro-batch is due; at once if it has none."""
        return self.store.parts("waiting", [batch_id]).agg(F.max("due_ms")).first()[0] or 0

    def release(self, targets: Sequence[Target], wait: bool = False) -> list[int]:
        """Publish the notes that are due as output ``notes`` of their own micro-batches, which it returns.

        A write names its micro-batch, so a release that was cut off is repeated in place. With
        ``wait`` it stays until the last queued one is due, as a run that ends must.
        """
        released = []
        with _one_at_a_time:
            for batch_id in self.store.versions("waiting"):
                due = self._due(batch_id) / 1000
                if wait:
                    time.sleep(max(0.0, due - self.clock()))
                elif due > self.clock():
                    continue
                notes = self.store.parts("waiting", [batch_id]).drop("due_ms")
                if targets and not publish(notes, "notes", batch_id, targets):
                    raise PublishError(f"cannot publish notes of batch {batch_id}")
                self.store.drop("waiting", batch_id)
                released.append(batch_id)
        return released
