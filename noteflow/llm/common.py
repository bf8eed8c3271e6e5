"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six ASCII characters that separate words, as a pattern and one by one.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A table is broadcast only below this many rows of a few narrow columns, counted beforehand;
#: above it, a shuffled join gives the same rows.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words between the six ASCII spaces; a null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, SPACES, -1))


def narrow_join(wide: DataFrame, narrow: DataFrame, on: Column, how: str) -> DataFrame:
    """Join a written, narrow table to a wide one without moving the wide one where that is safe.

    ``narrow`` is counted: small enough it is broadcast, else both sides are shuffled, and
    adaptive execution splits keys with many rows.
    """
    fits = narrow.count() <= BROADCAST_ROWS
    return wide.join(F.broadcast(narrow) if fits else narrow.hint("merge"), on, how)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
