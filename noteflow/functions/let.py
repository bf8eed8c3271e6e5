"""Keep a costly expression from being evaluated more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def add_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` whose value the optimizer does not repeat inside a filter above it.

    A filter is moved below a projection by repeating the projected expression; it is not
    moved below a generator whose output it reads.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))
