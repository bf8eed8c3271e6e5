"""The trie of conversation prefixes, built as burst tries.

A conversation is one row: the ids (128 bits) and lengths of its turns. Equal conversations are one sequence
with a count. All sequences start in one container under the root. A container of too many turns bursts:
its head becomes a node row, and its sequences go on to the containers of their next turn ids. What
remains are containers of bounded size (or of a single sequence); shards hold them sorted by
head and turn ids, and a sweep over each makes its nodes. Burst heads are then summed up from the deepest on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteflow.llm.common import require
from noteflow.staging import cut_lineage

#: A container of more turns bursts, unless it holds a single sequence.
CONTAINER_TURNS = 20_000
#: Characters of joined ids that one row holds, about.
CHUNK_CHARS = 1 << 16
NONE = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of the role and the text, 32 hexadecimal digits."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(whole, 256), 1, 32)


def ordered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """``conv, turns``: of each conversation the ids and code points of its turns, by turn (null first).

    Null roles and texts are empty. Turns of one number stand in the order of their ids; repeated
    rows are turns of their own. Rows without a conversation belong to none and are left out.
    """
    require(turns, [conv_id, turn, role, text])
    name, words = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).alias("conv"), F.struct(
        F.col(turn).alias("turn"), turn_id(name, words).alias("tid"), F.char_length(words).alias("chars")).alias("t"))
    return rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns")).select(
        "conv", F.transform("turns", lambda t: F.struct(F.unhex(t["tid"]).alias("tid"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(conversations: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """Each conversation c after the first h turns of conversation c - c % ``block``, in place of its own
    first h; h is the checksum of c as a decimal modulo ``most`` + 1. An absent one has no turns."""
    base = F.col("conv") - F.col("conv") % F.lit(block)
    heads = conversations.select(F.col("conv").alias("first"), F.slice("turns", 1, most).alias("head"))
    taken = F.crc32(F.col("conv").cast("string")) % F.lit(most + 1)
    wide = conversations.withColumn("base", base).withColumn("h", taken.cast("int"))
    joined = wide.join(heads, F.col("base") == F.col("first"), "left")
    none = F.slice("turns", 1, 0)
    own = F.slice("turns", F.col("h") + 1, F.size("turns") + 1)
    return joined.select("conv", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), own).alias("turns"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one sequence, comma-joined; rows come sorted by sequence and id."""
    schema = pa.schema([("sid", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    here, first, ids, held, out = None, None, [], 0, []

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for part in batches:
        for sid, conv in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            if sid != here or held > CHUNK_CHARS:
                if ids:
                    out.append((here, first, ",".join(ids)))
                here, first, ids, held = sid, conv, [], 0
            ids.append(str(conv))
            held += len(ids[-1]) + 1
        if out:
            yield batch(out)
            out = []
    if ids:
        yield batch([(here, first, ",".join(ids))])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of all ids of a sequence; rows come sorted by sequence and first id, one is held."""
    schema = pa.schema([("sid", pa.binary()), ("ends", pa.string())])
    here, state = None, None
    for part in batches:
        out = []
        for sid, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
            if sid == here:
                state.update(b",")
            else:
                if here is not None:
                    out.append((here, state.hexdigest()))
                here, state = sid, hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if here is not None:
        yield pa.RecordBatch.from_arrays([pa.array([here], pa.binary()), pa.array([state.hexdigest()])], schema=schema)


def sequences(conversations: DataFrame) -> DataFrame:
    """Distinct turn sequences, written: ``tids, chars, conv`` (the smallest), ``n`` and ``ends``, the digest
    of the ids of all conversations that are this sequence, ascending and comma-joined.

    Any number of conversations may be equal: their ids are sorted by ranges and joined there, and
    the digest, which has to be made in order, reads a few long strings.
    """
    sid = F.unhex(F.sha2(F.coalesce(F.aggregate(
        "turns", F.lit(b""), lambda a, t: F.concat(a, t["tid"])), F.lit(b"")), 256))
    rows = cut_lineage(conversations.withColumn("sid", sid), "conversations")
    ranged = rows.select("sid", "conv").repartitionByRange("sid", "conv").sortWithinPartitions("sid", "conv")
    chunks = ranged.mapInArrow(_joined_ids, "sid binary, first long, ids string")
    ends = chunks.repartition("sid").sortWithinPartitions("sid", "first").mapInArrow(_ends, "sid binary, ends string")
    found = rows.groupBy("sid").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.first("turns").alias("turns"))
    return cut_lineage(found.join(ends.withColumnRenamed("sid", "s"), F.col("sid") == F.col("s")).select(
        F.transform("turns", lambda t: t["tid"]).alias("tids"), F.transform("turns", lambda t: t["chars"]).alias("chars"),
        "conv", "n", "ends"), "sequences")


NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, "
        "ends string, head binary, parent binary")


def _swept(members: list[tuple], head: bytes, parent: bytes | None, depth: int, last: int) -> list[tuple]:
    """The nodes of a container; ``members`` are (turn ids, lengths, conversation, count, ends), sorted.

    The first one is its head. Nodes come after their parents, so sums go backwards.
    """
    above, level, chars = [None], [depth], [last]
    conv, count, ends = [None], [0], [NONE]
    path, before = [0], []
    for tids, sizes, first, n, digest in members:
        at = depth
        while at < len(before) and at < len(tids) and before[at] == tids[at]:
            at += 1
        del path[at - depth + 1:]
        for d in range(at, len(tids)):
            above.append(path[-1])
            path.append(len(level))
            level.append(d + 1)
            chars.append(int(sizes[d]))
            conv.append(None)
            count.append(0)
            ends.append(NONE)
        node, before = path[-1], tids
        conv[node], count[node], ends[node] = int(first), int(n), digest
    size = len(level)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for node in range(size - 1, -1, -1):
        leaves[node] = leaves[node] or 1
        saved[node] += (count[node] - 1) * chars[node]
        up = above[node]
        if up is not None:
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            count[up] += count[node]
            conv[up] = conv[node] if conv[up] is None else min(conv[up], conv[node])
    return [(conv[x], level[x], None if above[x] is None else conv[above[x]], count[x], children[x], leaves[x], saved[x],
             ends[x], head if x == 0 else None, parent if x == 0 else None) for x in range(size)]


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Containers one after the other; rows come sorted by head and turn ids."""
    columns = [c.split()[0] for c in NODE.split(", ")]
    here, members = None, []

    def frame(rows):
        return pd.DataFrame(rows, columns=columns).astype({"parent_conv_id": "Int64"})

    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            if here is None or row.head != here[0]:
                if members:
                    out += _swept(members, *here)
                here, members = (row.head, row.parent, row.depth, row.last), []
            members.append((list(row.tids), list(row.chars), row.conv, row.n, row.ends))
        if out:
            yield frame(out)
    if members:
        yield frame(_swept(members, *here))


def prefix_nodes(conversations: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """One row per distinct prefix of the sequences of ``conversations`` (``conv, turns``), the empty one included:
    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Members of a node are the conversations that start with it; ``conv_id`` is the smallest, ``n_convs`` their number.
    ``n_leaves`` are childless nodes in its subtree, itself included; ``saved_tokens`` sums
    (members - 1) x code points of the last text over it; ``ends_sha256`` is the digest of the ids of the
    members that end there. Without conversations there are no rows.
    """
    spark = conversations.sparkSession
    state = sequences(conversations).select(
        "*", F.lit(b"").alias("head"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("last"))
    done, heads = [], []
    while True:
        sizes = state.groupBy("head").agg(
            F.sum(F.size("tids") - F.col("depth") + 1).alias("size"), F.count("*").alias("many"))
        large = cut_lineage(sizes.where((F.col("size") > container_turns) & (F.col("many") > 1)).select(
            F.col("head").alias("burst")), "burst-heads")
        if not large.head(1):
            done.append(state)
            break
        done.append(state.join(large, F.col("head") == F.col("burst"), "left_anti"))
        moving = state.join(large, F.col("head") == F.col("burst"), "left_semi")
        over = F.size("tids") == F.col("depth")
        heads.append(cut_lineage(moving.groupBy("head", "parent", "depth", "last").agg(
            F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"),
            F.coalesce(F.max(F.when(over, F.col("ends"))), F.lit(NONE)).alias("ends")), "heads"))
        following = F.get("tids", F.col("depth"))
        state = cut_lineage(moving.where(~over).select(
            "tids", "chars", "conv", "n", "ends", F.unhex(F.sha2(F.concat("head", following), 256)).alias("head"),
            F.col("head").alias("parent"), (F.col("depth") + 1).alias("depth"), F.get("chars", F.col("depth")).alias("last")),
            "containers")
    containers = done[0]
    for part in done[1:]:
        containers = containers.unionByName(part)
    shards = containers.repartition("head").sortWithinPartitions("head", "tids")
    swept = cut_lineage(shards.mapInPandas(_sweep, NODE), "swept")

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    nodes = swept.where("head IS NULL").select(*columns)
    tops = swept.where("head IS NOT NULL").drop("parent_conv_id")
    # From the deepest burst heads up: each sums what is one turn below it.
    parts, below = [], tops
    for depth, level in reversed(list(enumerate(heads))):
        under = below.where(F.col("depth") == depth + 1).groupBy(F.col("parent").alias("up")).agg(
            F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        level = level.join(under, F.col("head") == F.col("up"), "left").select(
            "conv_id", F.col("depth").cast("long").alias("depth"), "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("last")).alias("saved"), "ends", "head", "parent")
        level = cut_lineage(level, "summed-heads")
        parts.append(level)
        below = tops.unionByName(level)
    every = tops
    for level in parts:
        every = every.unionByName(level)
    names = [x.select(F.col("head").alias("up"), F.col("conv_id").alias("parent_conv_id")) for x in parts]
    parents = spark.createDataFrame([], "up binary, parent_conv_id long")
    for part in names:
        parents = parents.unionByName(part)
    linked = every.join(parents, F.col("parent") == F.col("up"), "left").select(*columns)
    return nodes.unionByName(linked).withColumnsRenamed({"saved": "saved_tokens", "ends": "ends_sha256"})
