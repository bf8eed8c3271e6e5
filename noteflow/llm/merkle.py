"""A Merkle manifest of a table: a tree per source, a tree over their roots, and proofs by climbing.

Leaves are numbered within their source by ranges of (source, id), so no task holds a source. Levels
are built from the bottom; each node row knows its parent, its place among the nodes of its run and
the digests of its own children, and is stored. A recursive query then starts at every leaf and ascends:
a step joins the parent, folds the digest so far into the run of siblings and appends the siblings
to the proof. The siblings above a run are the same for all its leaves, so one leaf of each run carries them.

Near the roots very many leaves meet in one node: node rows are there several times, by salts that
follow from the number of leaves below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteflow.llm.common import require
from noteflow.staging import cut_lineage

FAN = 16
#: Leaves below a node per copy of its row, and copies at most.
SALT_LEAVES = 64
MOST_SALTS = 256
MOST_LEVELS = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def small_letters(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hex(body: Column) -> Column:
    return F.lower(F.hex(body))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows``, written, with ``idx``, their place from 0 in their ``group`` by ``order`` (null first), and
    ``width``, the rows of the group.

    Rows are sorted by ranges over group and order; a group of any size spans as many tasks as it
    needs, and only the numbers of rows per task and group are summed up.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    place = F.monotonically_increasing_id()
    ranged = cut_lineage(ranged.withColumn("row", place), "ranges")
    key = F.struct(group)  # a null is a group
    task = F.shiftright("row", 33)
    counts = ranged.groupBy(task.alias("task"), key.alias("of")).agg(F.min("row").alias("low"), F.count("*").alias("n"))
    before = Window.partitionBy("of").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut_lineage(counts.select(
        "task", "of", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), "n"), "range-counts")
    widths = counts.groupBy("of").agg(F.sum("n").alias("width"))
    counts = counts.join(widths.select(F.col("of").alias("of_"), "width"), F.col("of").eqNullSafe(F.col("of_")))
    tagged = ranged.withColumn("task_", task).withColumn("key_", key)
    found = tagged.join(counts, (F.col("task_") == F.col("task")) & F.col("key_").eqNullSafe(F.col("of")))
    return found.select(*ranged.columns, (F.col("row") - F.col("low") + F.col("offset")).alias("idx"), "width")


def _salts(leaves: Column) -> Column:
    return F.least(F.lit(MOST_SALTS), F.greatest(F.lit(1), F.floor(leaves / SALT_LEAVES))).cast("int")


def _runs(level: DataFrame, tree: Column) -> DataFrame:
    """``tree, idx, width, children`` of the level above: sixteen nodes in a row become one."""
    members = F.array_sort(F.collect_list(F.struct("idx", F.unhex("digest").alias("body"))))
    runs = level.groupBy(tree.alias("tree"), F.floor(F.col("idx") / FAN).alias("run"), "width").agg(members.alias("members"))
    children = F.aggregate("members", F.lit(b""), lambda a, m: F.concat(a, m["body"]))
    return runs.select("tree", F.col("run").alias("idx"), F.ceil(F.col("width") / FAN).alias("width"), children.alias("children"))


@dataclass(frozen=True)
class Manifest:
    """Written tables. ``leaves``: ``row, id, tampered, leaf, s, parent, place, salts, width``;
    ``nodes``: ``id, parent, place, salts, children, salt``; ``subroots``: ``s, source, subroot, leaves``.
    ``parent`` is null at the root, ``salts`` says how many rows the parent has."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None


def _node_id(tree: Column, level: int, idx: Column) -> Column:
    return F.concat_ws(".", tree, F.lit(level), idx.cast("string"))


def build(docs: DataFrame, tampered: Column, text: str = "text", fields: tuple[str, ...] = FIELDS,
          id_col: str = "doc_id", source: str = "source") -> Manifest:
    """The stored tree of ``docs``. ``tampered`` is the text as a reader got it, null where it is the same.

    Leaves of a source (a null one is a source) ascend by id, null first; rows with one id ascend by
    their digest. Each sixteen in a row, or what is left of them, make a node, up to a single one; the
    sources' roots, by source (null first, bytewise), are the leaves of the upper tree.
    """
    require(docs, list(fields))
    parts = lambda changed: [field(changed if c == text and changed is not None else F.col(c)) for c in fields]
    changed = F.when(tampered.isNotNull(), digest(*parts(tampered)))
    rows = docs.select(F.col(source).alias("source"), F.col(id_col).alias("doc"), digest(*parts(None)).alias("leaf"),
                       changed.alias("tampered"))
    # Written, as ranges are found by reading once more.
    rows = numbered(cut_lineage(rows, "digests"), "source", "doc", "leaf")

    sources = cut_lineage(rows.groupBy("source").agg(F.count("*").alias("leaves")), "sources")
    total = sources.count()
    ranked = numbered(sources.withColumn("all", F.lit(0)), "all", "source").select(
        F.col("idx").alias("s"), F.col("source").alias("of"), "leaves")
    ranked = cut_lineage(ranked, "ranked-sources")
    copies = ranked.select("*", F.explode(F.sequence(F.lit(0), _salts(F.col("leaves")) - 1)).alias("copy"))
    salt = F.pmod(F.xxhash64("row"), _salts(F.col("width")).cast("long")).cast("int")
    rows = cut_lineage(rows.withColumn("copy_", salt).join(
        copies.drop("leaves"), F.col("source").eqNullSafe(F.col("of")) & (F.col("copy_") == F.col("copy"))).select(
        "row", "doc", "leaf", "tampered", "s", "idx", "width"), "leaves")

    # Trees of the sources; what remains of each goes to the tree above them.
    tree = lambda s: F.concat(F.lit("s"), s.cast("string"))
    level, at, nodes, remains = rows.select("s", "idx", "width", F.col("leaf").alias("digest")), 0, [], []
    while True:
        remains.append(level.where("width = 1").select("s", "digest", F.lit(at).alias("height")))
        if not level.where("width > 1").head(1):
            break
        runs = _runs(level.where("width > 1"), F.col("s")).withColumnRenamed("tree", "s")
        level = cut_lineage(runs.withColumn("digest", F.sha2(_hex(F.col("children")), 256)), "level")
        at += 1
        nodes.append(level.select(
            "s", _node_id(tree(F.col("s")), at, F.col("idx")).alias("id"), "idx", "width", "children", F.lit(at).alias("height")))
    roots = remains[0]
    for more in remains[1:]:
        roots = roots.unionByName(more)
    subroots = cut_lineage(ranked.join(roots.withColumnRenamed("s", "s_"), F.col("s") == F.col("s_")).select(
        "s", F.col("of").alias("source"), F.col("digest").alias("subroot"), "leaves", "height"), "subroots")

    # The tree above, of which a node has any number of leaves below.
    leaves = subroots.agg(F.sum("leaves")).first()[0] or 0
    level = subroots.select(F.col("s").alias("idx"), F.lit(total).cast("long").alias("width"), F.col("subroot").alias("digest"))
    width, upper = total, []
    top = F.lit("t")
    over = lambda nodes: max(1, min(MOST_SALTS, leaves // (FAN * nodes)))
    while width > 1:
        level = cut_lineage(_runs(level, F.lit(0)).withColumn("digest", F.sha2(_hex(F.col("children")), 256)), "level")
        width = -(-width // FAN)
        up = F.lit(None).cast("string") if width == 1 else _node_id(top, len(upper) + 2, F.floor(F.col("idx") / FAN))
        upper.append(level.select(
            _node_id(top, len(upper) + 1, F.col("idx")).alias("id"), up.alias("parent"),
            F.pmod("idx", F.lit(FAN)).cast("int").alias("place"), F.lit(over(-(-width // FAN))).alias("salts"), "children",
            F.lit(over(width)).alias("own")))
    single = level.head(1) if width == 1 else []
    root = single[0]["digest"] if single else None

    # What a row of a source's tree links to: the next level of it, or the first of the tree above.
    above = F.lit(None).cast("string") if total == 1 else _node_id(top, 1, F.floor(F.col("s") / FAN))

    def linked(rows: DataFrame, height: int, size: Column) -> list[Column]:
        inside = F.col("width") > 1
        below = F.least(F.lit(FAN ** (height + 1)).cast("long"), size)
        return [F.when(inside, _node_id(tree(F.col("s")), height + 1, F.floor(F.col("idx") / FAN))).otherwise(above).alias("parent"),
                F.pmod(F.when(inside, F.col("idx")).otherwise(F.col("s")), F.lit(FAN)).cast("int").alias("place"),
                F.when(inside, _salts(below)).otherwise(F.lit(over(-(-total // FAN) or 1))).alias("salts")]

    found = upper
    sizes = ranked.select(F.col("s").alias("s_"), "leaves")
    for height, part in enumerate(nodes, 1):
        part = part.join(sizes, F.col("s") == F.col("s_"))
        own = _salts(F.least(F.lit(FAN ** height).cast("long"), F.col("leaves"))).alias("own")
        found.append(part.select("id", *linked(part, height, F.col("leaves")), "children", own))
    stored = None
    for part in found:
        stored = part if stored is None else stored.unionByName(part)
    if stored is None:
        stored = docs.sparkSession.createDataFrame(
            [], "id string, parent string, place int, salts int, children binary, own int")
    stored = cut_lineage(stored.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("own") - 1))).drop("own"), "nodes")
    linked_rows = cut_lineage(rows.select(
        "row", "doc", "leaf", "tampered", "s", "idx", "width", *linked(rows, 0, F.col("width"))), "linked-leaves")
    return Manifest(linked_rows, stored, subroots, root)


# A run without one of its nodes, and with another digest in the place of one.
CLIMB = """
WITH RECURSIVE climb MAX RECURSION LEVEL {levels} AS (
  SELECT row, parent, place, salts, coalesce(tampered, leaf) AS folded,
    CASE WHEN width = 1 OR place = 0 THEN X'' END AS above, 0 AS step
  FROM {{leaves}}
  UNION ALL
  SELECT c.row, n.parent, n.place, n.salts,
    sha2(concat(lower(hex(substring(n.children, 1, 32 * c.place))), c.folded,
                lower(hex(substring(n.children, 32 * c.place + 33)))), 256),
    CASE WHEN c.step = 0 THEN c.above ELSE concat(c.above,
      substring(n.children, 1, 32 * c.place), substring(n.children, 32 * c.place + 33)) END,
    c.step + 1
  FROM climb c JOIN {{nodes}} n ON n.id = c.parent AND n.salt = pmod(xxhash64(c.row), c.salts))
SELECT row, folded, above FROM climb WHERE parent IS NULL LIMIT ALL
"""


def proofs(manifest: Manifest) -> DataFrame:
    """Per leaf ``row, doc, leaf, s, width, proof, folded``: the digest of its siblings up to the root, level by
    level, and the root as it follows from the (tampered) leaf and those siblings."""
    leaves, nodes = manifest.leaves, manifest.nodes
    climbed = cut_lineage(leaves.sparkSession.sql(CLIMB.format(levels=MOST_LEVELS), leaves=leaves, nodes=nodes), "climbed")
    # The siblings above a run, by the run or, for a source of one leaf, by the leaf.
    run = F.when(F.col("width") > 1, F.col("parent")).otherwise(F.concat(F.lit("row"), F.col("row").cast("string")))
    named = leaves.select("row", "doc", "leaf", "s", "width", "parent", "place", run.alias("run"))
    heads = leaves.where("width = 1 OR place = 0").select("row", run.alias("run_"))
    above = heads.join(climbed.select("row", "above"), "row").select("run_", "above")
    near = nodes.where("salt = 0").select(F.col("id").alias("near"), "children")
    found = named.join(climbed.select("row", "folded"), "row").join(above, F.col("run") == F.col("run_"))
    found = found.join(near, F.col("parent") == F.col("near"), "left")
    own = F.coalesce(F.concat(F.expr("substring(children, 1, 32 * place)"), F.expr("substring(children, 32 * place + 33)")),
                     F.lit(b""))
    return found.select("row", "doc", "leaf", "s", "width", F.sha2(_hex(F.concat(own, "above")), 256).alias("proof"), "folded")


def crc_fifth(id_col: Column) -> Column:
    """Whether 5 divides the checksum of the id as a decimal; not without an id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def verified_leaves(docs: DataFrame, tampered: Column | None = None, id_col: str = "doc_id",
                    source: str = "source", text: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per row of ``docs``: ``id_col, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``tampered`` is the text a reader got, null where it is the text; by default texts of which the id's
    checksum is divisible by 5 got small letters for A-Z. ``folded_root`` is the root that follows
    from it and the original siblings; ``verified`` tells whether it is the root. Null texts stay null. Equal rows
    are leaves of their own; rows without an id come first in their source and are not tampered with by default. A
    table of one row is its own root, with the digest of nothing as proof. An empty one gives no rows.
    Only the ``fields`` count: other columns have no part in the digests.
    """
    if tampered is None:
        tampered = F.when(crc_fifth(F.col(id_col)), small_letters(F.col(text)))
    manifest = build(docs, tampered, text, fields, id_col, source)
    found = proofs(manifest)
    sub = manifest.subroots.select(F.col("s").alias("s_"), "subroot", F.explode(
        F.sequence(F.lit(0), _salts(F.col("leaves")) - 1)).alias("copy"))
    salt = F.pmod(F.xxhash64("row"), _salts(F.col("width")).cast("long")).cast("int")
    found = found.withColumn("copy_", salt).join(sub, (F.col("s") == F.col("s_")) & (F.col("copy_") == F.col("copy")))
    root = F.lit(manifest.root).cast("string")
    return found.select(F.col("doc").alias(id_col), "leaf", "subroot", root.alias("root"), F.col("proof").alias("proof_sha256"),
                        F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))
