"""Written intermediates in the folder the cluster shares."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Codec of files with whole texts.
TEXTS = "zstd"
_written: list[str] = []  # outside of any scope
_scopes = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local one only for local masters."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    return _local_folder()


@lru_cache(maxsize=None)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="noteflow-")


def new_path(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A new folder, deleted with the innermost scope; one that ``outlives`` it, with the scope around that."""
    path = os.path.join(shared_folder(spark), "noteflow", f"{name}-{uuid.uuid4().hex}")
    stack = getattr(_scopes, "stack", ())
    stack = stack[:-1] if outlives else stack
    (stack[-1] if stack else _written).append(path)
    return path


def cut_lineage(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), compression: str | None = None,
                outlives: bool = False) -> DataFrame:
    """Write ``df`` once and go on from the files.

    Column and partition pruning work on them, and a lost executor costs a re-read, not the
    work before it. Whole texts are worth a ``compression`` of ``TEXTS``. What ``outlives`` the scope it
    is written in lets all else that was staged there go.
    """
    spark = df.sparkSession
    path = new_path(spark, name, outlives)
    with unsorted_writes(spark):
        writer = df.write.partitionBy(*partition_by)
        (writer.option("compression", compression) if compression else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def unsorted_writes(spark: SparkSession):
    """Writes inside keep a file open for each partition value, of which ours are few: rows are not sorted by it.
    What a write has shuffled is deleted when it is done."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before, cleaned = spark.conf.get(name), spark.conf.get(CLEANUP_CONF, "false")
    if int(before) <= 0:
        spark.conf.set(name, "32")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
        spark.conf.set(CLEANUP_CONF, cleaned)


def even(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by ``by`` to as many tasks as the session has shuffle partitions.

    Adaptive execution merges small shuffles, which is wrong before a projection that costs far more
    than the bytes it reads; a stated number it leaves alone. Joins on ``by`` shuffle no more.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


class Rounds:
    """Intermediates of a loop, of which each round reads those of the round before it.

    What the last two rounds wrote stays until the scope ends or ``release``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.before, self.now = spark, [], []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """``cut_lineage`` as part of this round."""
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.now.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def turn(self) -> None:
        """End this round; nothing may read the round before it from now on."""
        done, self.before, self.now = self.before, self.now, []
        _forget(done)
        _delete(self.spark, done)


@contextmanager
def scope(spark: SparkSession):
    """Delete at the end what this thread staged inside, e.g. for one micro-batch."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        _delete(spark, stack.pop())


def release(spark: SparkSession) -> int:
    """Delete what was staged outside of scopes, once the results are written."""
    return _delete(spark, _written)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, ahead of its scope."""
    _delete(spark, [path])


def _forget(paths: list[str]) -> None:
    for held in (*getattr(_scopes, "stack", ()), _written):
        held[:] = [path for path in held if path not in paths]


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        count += bool(path.getFileSystem(conf).delete(path, True))
    return count
