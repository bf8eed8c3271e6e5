"""Session settings: for a cluster, and for tests and the bench on one machine."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

# Worth having on every session that runs the flow; all of them can be set at submit time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # No broadcast on an estimate; below this size, as measured after the shuffle, there is one.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # Hash joins without sorting where every measured build partition is small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Cleaning text is CPU-bound: smaller splits spread it better and spill less.
    "spark.sql.files.maxPartitionBytes": "64m",
    # Outputs have few partition values: a writer for each instead of a sort of whole rows.
    "spark.sql.maxConcurrentOutputFileWriters": "32",
    # Rows sent to Python may hold long arrays of times.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def with_settings(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def local_session(cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    spark = (
        with_settings(SparkSession.builder.master(f"local[{cpus}]").appName("noteflow"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def state_partitions(spark: SparkSession):
    """One state partition per core for streams started inside: adaptive execution does not
    merge the shuffle partitions of a stream, and their number is fixed at its first start."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)
