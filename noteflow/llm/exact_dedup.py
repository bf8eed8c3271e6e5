"""Exact repeats: groups by a 128-bit content hash, with the bytes compared inside of groups.

Only ids and hashes of all rows are shuffled. Whole texts move for rows whose hash is not
unique, and of those each task sends one copy per distinct text: grouping by hash and text is
the comparison of bytes, and a group of any size collapses before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteflow.llm.common import SPACES, free_name, narrow_join
from noteflow.staging import cut_lineage


def normalised(text: Column) -> Column:
    """Each run of the six ASCII spaces becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_hash(norm: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(norm.cast("binary")))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                 hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal normalised texts the smallest id stays, a null id only if there is no other. Rows
    with equal texts and the same smallest id are all ``kept`` here (``drop_repeats`` leaves one
    of them). Null texts count as empty and form a group. ``hash_of`` may be any function of the
    text: rows whose hashes collide are told apart by their bytes.
    """
    norm = normalised(F.col(text))
    hashed = cut_lineage(docs.select(
        F.col(id_col).alias("id"),
        hash_of(norm).alias("h"),
        F.sha2(norm, 256).alias("text_sha256"),
    ), "content-hashes")
    many = cut_lineage(
        hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-hashes")
    # Bytes are compared here: the normalised text is part of the key.
    suspects = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), hash_of(norm).alias("h_"))
    suspects = narrow_join(suspects, many, F.col("h_") == F.col("h"), "left_semi")
    groups = suspects.groupBy("h_", "norm").agg(
        F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = cut_lineage(groups.select(
        F.col("h_").alias("h"), F.sha2("norm", 256).alias("sha"), "keep_id", "group_size",
    ), "verified-groups")
    _no_double(groups)
    joined = narrow_join(
        hashed, groups.withColumnRenamed("h", "gh"),
        (F.col("h") == F.col("gh")) & (F.col("text_sha256") == F.col("sha")), "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def _no_double(groups: DataFrame) -> None:
    """Two different texts that share both hashes cannot be told apart by the join that follows."""
    if groups.groupBy("h", "sha").agg(F.count("*").alias("n")).where("n > 1").head(1):
        raise RuntimeError("different texts share the content hash and their SHA-256")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, one of each group, with all their columns.

    Of rows that agree in text and id, one stays; which one is open if other columns differ.
    """
    sha, i_, t_ = (free_name(docs, name) for name in ("sha_", "id_", "text_sha256_"))
    found = cut_lineage(find_repeats(docs, id_col, text).select(
        F.col(id_col).alias(i_), "kept", F.col("text_sha256").alias(t_), "group_size"), "repeats")
    tagged = docs.withColumn(sha, F.sha2(normalised(F.col(text)), 256))
    key = F.col(id_col).eqNullSafe(F.col(i_)) & (F.col(sha) == F.col(t_))
    dropped = cut_lineage(found.where("NOT kept").select(i_, t_).distinct(), "dropped")
    double = cut_lineage(
        found.where("kept AND group_size > 1").groupBy(i_, t_)
        .agg(F.count("*").alias("n")).where("n > 1").select(i_, t_), "double-rows")
    stay = narrow_join(tagged, dropped, key, "left_anti")
    if not double.head(1):
        return stay.drop(sha)
    once = narrow_join(stay, double, key, "left_semi").dropDuplicates([id_col, sha])
    return narrow_join(stay, double, key, "left_anti").unionByName(once).drop(sha)
