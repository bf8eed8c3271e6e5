"""Shards by a versioned map of fixed virtual slots.

A record's slot is a hash of its id and never changes. Bytes and rows are summed per slot, and a
small table says which slot lies in which shard. Only that table is edited, as a new version, when
shards are out of balance or one is added, so a record moves only with its slot.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.llm.common import free_name
from noteflow.staging import cut_lineage

SLOTS = 4096
#: Rows of a slot that one task numbers, on average, while a slot is cut in parts.
PART_ROWS = 20_000


def slot_of(id_col: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of an id; null has one too."""
    return F.pmod(F.xxhash64(id_col), F.lit(slots)).cast("int")


def slot_sums(docs: DataFrame, size: str, slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """``vslot, bytes, rows`` of the slots that have rows."""
    return docs.groupBy(slot_of(F.col(id_col), slots).alias("vslot")).agg(
        F.sum(size).alias("bytes"), F.count("*").alias("rows"))


def first_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    return {slot: slot % shards for slot in range(slots)}


def rebalanced(current: dict[int, int], sums: dict[int, int], shards: int) -> dict[int, int]:
    """The next version of a map: slots are moved until no move or swap brings shards nearer.

    ``sums`` has the bytes of slots. A slot goes from the fullest to the emptiest shard if that
    makes the larger of the two smaller: the slot, or pair of slots to swap, whose difference is
    nearest to half the gap. New shards start empty. Work on the fixed number of slots.
    """
    members: list[dict[int, int]] = [{} for _ in range(shards)]
    for slot, shard in current.items():
        members[shard][slot] = sums.get(slot, 0)
    load = [sum(m.values()) for m in members]
    if len(load) < 2:
        return dict(current)
    for _ in range(20 * len(current)):
        high = max(range(shards), key=lambda s: (load[s], -s))
        low = min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        give = sorted((b, s) for s, b in members[high].items() if 0 < b < gap)
        if give:
            moved, slot = min(give, key=lambda x: (abs(gap - 2 * x[0]), x))
            best = (abs(gap - 2 * moved), slot, None)
        else:
            best = (gap, None, None)
        # A swap of two slots may come nearer than a move.
        out = sorted((b, s) for s, b in members[high].items())
        into = sorted((b, s) for s, b in members[low].items())
        at = 0
        for b, s in out:
            while at + 1 < len(into) and abs(gap - 2 * (b - into[at + 1][0])) <= abs(gap - 2 * (b - into[at][0])):
                at += 1
            if into and abs(gap - 2 * (b - into[at][0])) < best[0]:
                best = (abs(gap - 2 * (b - into[at][0])), s, into[at][1])
        if best[0] >= gap or best[1] is None:
            break
        _, slot, back = best
        size = members[high].pop(slot)
        members[low][slot] = size
        load[high], load[low] = load[high] - size, load[low] + size
        if back is not None:
            size = members[low].pop(back)
            members[high][back] = size
            load[high], load[low] = load[high] + size, load[low] - size
    return {slot: shard for shard, m in enumerate(members) for slot in m}


def store_map(spark: SparkSession, path: str, version: int, slot_map: dict[int, int], sums: Iterable = ()) -> None:
    """Append a version of the map as ``version, vslot, shard, bytes, rows``."""
    held = {r["vslot"]: (r["bytes"], r["rows"]) for r in sums}
    rows = [(version, slot, shard, *held.get(slot, (0, 0))) for slot, shard in sorted(slot_map.items())]
    spark.createDataFrame(rows, "version int, vslot int, shard int, bytes long, rows long").coalesce(1).write.mode(
        "append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the latest without ``version``."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def balanced_map(spark: SparkSession, docs: DataFrame, size: str, shards: int, path: str,
                 slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """Store version 0 (slots in turn) and version 1 (edited to equal bytes); return the latter.

    What comes to the driver is one row per slot, of which the number is fixed.
    """
    sums = slot_sums(docs, size, slots, id_col).collect()
    first = first_map(shards, slots)
    store_map(spark, path, 0, first, sums)
    store_map(spark, path, 1, rebalanced(first, {r["vslot"]: r["bytes"] for r in sums}, shards), sums)
    return read_map(spark, path, 1)


def assign(docs: DataFrame, slot_map: DataFrame, slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``vslot``, ``shard`` and ``place``, the row's number in its shard from 0.

    Rows are numbered in the order of slots, parts of slots and ids. A shard is never sorted as
    one: sums of rows give the first number of each part of a slot, and rows are numbered within
    parts, which are cut by a second hash as fine as the number of rows asks for. Rows without an
    id fall into one slot, in parts by their other columns; equal rows are numbered in any order.
    A column of ``docs`` with one of the three names raises ``ValueError``.
    """
    for name in ("vslot", "shard", "place"):
        if name in {c.lower() for c in docs.columns}:
            raise ValueError(f"a column named {name} is there already")
    names = list(docs.columns)
    rows = docs.count()
    parts = max(1, rows // (slots * PART_ROWS))
    part, before, low = (free_name(docs, n) for n in ("part_", "before_", "low_"))
    v_, s_ = free_name(docs, "v_"), free_name(docs, "s_")
    cut = docs.withColumn("vslot", slot_of(F.col(id_col), slots)).withColumn(
        part, F.pmod(F.xxhash64(F.lit("part"), *[F.col(c) for c in names]), F.lit(parts)))
    counts = cut.groupBy("vslot", part).agg(F.count("*").alias("n"))
    counts = counts.join(F.broadcast(slot_map.select(F.col("vslot").alias(v_), "shard")), F.col("vslot") == F.col(v_))
    # Slots of a shard, then parts of a slot: at most as many rows as there are slots, and parts.
    slots_of = counts.groupBy("shard", "vslot").agg(F.sum("n").alias("n"))
    in_shard = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    first = slots_of.select(F.col("vslot").alias(s_), F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias(low))
    in_slot = Window.partitionBy("vslot").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(before, F.coalesce(F.sum("n").over(in_slot), F.lit(0)))
    starts = starts.join(F.broadcast(first), F.col("vslot") == F.col(s_)).select(
        F.col("vslot").alias(v_), F.col(part).alias(s_), "shard", (F.col(before) + F.col(low)).alias(before))
    number = F.row_number().over(Window.partitionBy("vslot", part).orderBy(F.col(id_col), *[F.col(c) for c in names if c != id_col]))
    numbered = cut.withColumn(low, number)
    placed = numbered.join(starts, (F.col("vslot") == F.col(v_)) & (F.col(part) == F.col(s_)))
    return placed.select(*names, "vslot", "shard", (F.col(before) + F.col(low) - 1).cast("long").alias("place"))


def sharded_sizes(docs: DataFrame, shards: int, map_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` in one of ``shards`` of nearly equal bytes.

    ``id_col, size, text_crc32, vslot, shard, place``. The size is the number of UTF-8 bytes of
    the text (null: none) and 1. The map of slots is stored in ``map_path``. Repeated rows share
    a slot; an empty table gives no rows.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    sized = cut_lineage(docs.select(
        F.col(id_col), (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32")), "shard-sizes")
    slot_map = balanced_map(spark, sized, "size", shards, map_path, id_col=id_col)
    return assign(sized, slot_map, id_col=id_col)
