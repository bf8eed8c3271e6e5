"""Mixing of sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents, served again from the start up to ``max_epochs``
times. A document's virtual finish time is the number of tokens served from its source up to its
end, divided by the weight of the source. All queue entries in order of virtual finish time are
the mix; it ends at the total budget. Sources that run out leave their share to the others.

The order is cut into ranges of equally many entries. Sums per range give the tokens before each
range, and a running sum exists only within one range, so neither a large source nor the whole
mix is ever sorted in one task. The running sum over all is the ``position`` of an entry, and the
mix ends at the position of the first entry that finishes after the budget is used up: what ends
before it is taken whole, and of the entry in service in each source then, the part served by then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteflow.llm.common import free_name, words
from noteflow.staging import cut_lineage

WEIGHTS = (3, 1, 2)
#: Documents of a source that one range of its shuffled order holds on average.
RANGE_ROWS = 2000
#: Equal rows that are listed from their count at once; more are listed in blocks by many tasks.
COPIES = 4096
#: Entries of the mix that one range of its order holds on average.
ORDER_ROWS = 100_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5,
                   max_epochs: int = 2) -> DataFrame:
    """Targets of the sources: ``source``, ``source_size``, ``weight``, ``target``.

    ``sizes`` has ``source`` and ``source_size``, a row per source. Sources by code point, null
    last, take the ``weights`` in turn. Together they get ``share`` of all tokens by weight; a
    target stops at ``max_epochs`` times its source, and the rest is shared by the others. In the
    order of the virtual time at which sources run out, those before the first that outlasts the
    budget are exhausted. ``until`` is the virtual end of the mix if just the sources before a row
    ran out; it falls from the first that outlasts it on, so that one has the largest. The table of sources is a setting of the mix, one short row each.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    number = (F.row_number().over(order) - 1) % len(weights) + 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), number))
    weighed = weighed.withColumn("cap", max_epochs * F.col("source_size").cast("double"))
    ends = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = ends.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = weighed.select(
        "source", "source_size", "weight", "cap",
        ((F.lit(float(share)) * F.sum(F.col("source_size").cast("double")).over(everything)
          - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         / (F.sum("weight").over(everything)
            - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("until"),
    )
    lasting = F.max(F.when(F.col("cap") / F.col("weight") > F.col("until"), F.col("until"))).over(everything)
    target = F.when(lasting.isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("weight") * lasting))
    return level.withColumn("target", target).select("source", "source_size", "weight", "target")


def shuffle_key(id_col: Column, seed: str) -> Column:
    """The place of a document in the shuffled order of its source."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("?"))))


def queue_entries(docs: DataFrame, targets: DataFrame, max_epochs: int, seed: str) -> DataFrame:
    """Every document once per epoch: ``id, source, size, epoch, rank_key, row, served, finish``.

    ``served`` is the number of tokens of the source up to the document's end. The shuffled
    order is that of a hash of the id (and size, then of equal rows in any order); ``row`` numbers
    the documents in it, so it tells equal rows apart and is the same in all epochs. Its first
    digits cut the order of a source into ranges; their number follows the number of rows.

    Rows of one id, source and size are counted before they are ordered and listed again from
    their count afterwards, so no number of rows with the same id, or without one, meets in a task.
    """
    key = shuffle_key(F.col("id"), seed)
    rows = docs.count()
    digits = 1
    while 16 ** digits * RANGE_ROWS < rows:
        digits += 1
    keyed = cut_lineage(
        docs.groupBy("id", "source", "size").agg(F.count("*").alias("copies"))
        .withColumn("rank_key", key).withColumn("part", F.substring("rank_key", 1, digits)), "mix-queue")
    tokens = F.col("size") * F.col("copies")
    sums = keyed.groupBy("source", "part").agg(F.sum(tokens).alias("part_size"), F.sum("copies").alias("part_rows"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("s_"), F.col("part").alias("p_"),
        F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("before"),
        F.coalesce(F.sum("part_rows").over(ahead), F.lit(0)).alias("rows_before"))
    within = Window.partitionBy("source", "part").orderBy("rank_key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.withColumn("row", F.coalesce(F.sum("copies").over(within), F.lit(0))).withColumn(
        "within", F.coalesce(F.sum(tokens).over(within), F.lit(0)))
    run = run.join(sums, F.col("source").eqNullSafe(F.col("s_")) & (F.col("part") == F.col("p_")))
    run = run.select("id", "source", "size", "copies", "rank_key", (F.col("rows_before") + F.col("row")).alias("row"),
                     (F.col("before") + F.col("within")).alias("ahead"))
    t = targets.select(F.col("source").alias("t_"), "source_size", "weight", "target")
    run = listed(run).join(F.broadcast(t), F.col("source").eqNullSafe(F.col("t_")))
    epochs = run.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    served = F.col("epoch") * F.col("source_size") + F.col("ahead") + F.col("copy") * F.col("size")
    return epochs.withColumn("served", served).select(
        "id", "source", "size", "source_size", "target", "epoch", "rank_key",
        (F.col("row") + F.col("copy")).alias("row"), "served", (F.col("served") / F.col("weight")).alias("finish"))


def listed(counted: DataFrame) -> DataFrame:
    """Each row of ``counted`` as often as its ``copies`` says, with ``copy`` from 1 on.

    Rows of many copies are dealt out in blocks of ``COPIES`` first.
    """
    counted = cut_lineage(counted, "mix-counted")
    few = counted.where(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    blocks = counted.where(F.col("copies") > COPIES).withColumn(
        "low", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(COPIES).cast("long"))))
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(parts, "id", "source", "size", "low")
    many = blocks.withColumn("copy", F.explode(F.sequence(
        F.col("low"), F.least(F.col("copies"), F.col("low") + (COPIES - 1))))).drop("low")
    return few.unionByName(many).drop("copies")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5,
        max_epochs: int = 2, seed: str = "mix", id_col: str = "doc_id",
        source: str = "source", size: Column | None = None) -> DataFrame:
    """The queue entries with what the mix takes of them, in no order of rows.

    Columns: ``id_col, source, size, source_size, target, row, epoch, served, finish, position, taken``.
    ``row`` is the place of the document in the shuffled order of its source, ``served`` the number
    of tokens of the source up to the end of the entry.
    ``position`` is the number of tokens of the mix before the entry in the order of virtual
    finish times (then of source and shuffled order). The order is cut at the first entry that finishes after
    the budget is used up: entries that end before that position are taken whole; of the entry of each source
    that is being served then, the served part is taken, so that each source meets its target to the token,
    which is checked.

    Without ``size``, the number of words of ``text`` counts. A null text has size 0, is in the
    mix and takes nothing. A null source is a source. An empty table gives an empty mix.
    Repeated rows are documents of their own.
    """
    sized = cut_lineage(docs.select(
        F.col(id_col).alias("id"), F.col(source).alias("source"),
        (F.size(words(F.col("text"))) if size is None else F.coalesce(size, F.lit(0)))
        .cast("long").alias("size"),
    ), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, share, max_epochs), "mix-targets")
    entries = cut_lineage(queue_entries(sized, targets, max_epochs, seed), "mix-entries")

    placed = cut_lineage(in_order(entries), "mix-order")
    end = placed.where("served > floor(target)").agg(F.min("position")).first()[0]
    if end is None:  # every source runs out
        mixed = placed.withColumn("taken", F.col("size"))
    else:
        whole = F.when(F.col("position") + F.col("size") <= end, F.col("size"))
        before = placed.groupBy(F.col("source").alias("s_")).agg(F.coalesce(F.sum(whole), F.lit(0)).alias("whole"))
        # The next in line of a source is in service when the budget is used up.
        part = F.when(F.col("served") - F.col("size") == F.col("whole"), F.least("size", F.floor("target") - F.col("whole")))
        mixed = placed.join(F.broadcast(before), F.col("source").eqNullSafe(F.col("s_"))).withColumn(
            "taken", F.coalesce(whole, part, F.lit(0)).cast("long"))
    missed = mixed.groupBy("source", "target").agg(F.sum("taken").alias("n")).where("n <> floor(target)").first()
    if missed is not None:
        raise RuntimeError(f"the mix takes {missed.n} tokens of {missed.source!r}, its target is {missed.target}")
    return mixed.select(
        F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target", "row", "epoch",
        "served", "finish", "position", "taken",
    )


def in_order(entries: DataFrame) -> DataFrame:
    """``entries`` with ``position``, the tokens before each in the order of virtual finish times."""
    order = ["finish", F.col("source").isNull(), F.col("source").cast("binary"), "epoch", "rank_key", "id", "size", "row"]
    ranges = max(1, -(-entries.count() // ORDER_ROWS))
    # The write keeps which range an entry is in.
    ranged = cut_lineage(
        entries.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    total = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range").agg(F.sum("size").alias("n"))
    sums = sums.select(F.col("range").alias("r_"), F.coalesce(F.sum("n").over(total), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("size").over(inside), F.lit(0))
    return ranged.withColumn("within", within).join(F.broadcast(sums), F.col("range") == F.col("r_")).withColumn(
        "position", F.col("before") + F.col("within")).drop("range", "r_", "before", "within")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5,
                    max_epochs: int = 2, seed: str = "mix", id_col: str = "doc_id",
                    source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes whole, once per epoch that takes them.

    A source is served in the order of its shuffle keys, so what it gives in an epoch is all up to
    one key. Those keys, one per source and epoch, are joined to the documents; no text is
    shuffled. Rows with the same id have the same key and are taken alike.
    """
    entries = mix(docs, weights, share, max_epochs, seed, id_col, source)
    # An entry without words past the target takes all of its nothing, but is not in the mix.
    whole = entries.where("taken = size AND served <= floor(target)")
    s, e = free_name(docs, "s_"), free_name(docs, "e_")
    last = [free_name(docs, f"k{n}_") for n in range(max_epochs)]
    ends = cut_lineage(whole.groupBy(F.col(source).alias(s)).agg(*[
        F.max(F.when(F.col("epoch") == n, shuffle_key(F.col(id_col), seed))).alias(name)
        for n, name in enumerate(last)
    ]), "mix-ends")
    key = shuffle_key(F.col(id_col), seed)
    joined = docs.join(F.broadcast(ends), F.col(source).eqNullSafe(F.col(s)))
    times = F.array_compact(F.array(*[
        F.when(key <= F.col(name), F.lit(n)) for n, name in enumerate(last)]))
    return joined.withColumn(e, F.explode(times)).select(*docs.columns)
