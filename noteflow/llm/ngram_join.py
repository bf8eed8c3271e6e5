"""Similarity join of word shingle sets with prefix filters under several global orders.

If two sets are similar enough, then under *any* total order of shingles their prefixes (the first
n - ceil(t n) + 1 elements) share one. Three orders are used: in all of them shingles that many
documents hold come last, and among equally common ones each order has its own hash. How common a
shingle is, is counted exactly over the whole corpus for those that can reach a prefix by their
hash, and kept per cell of a table whose size follows from their number. Candidates share a prefix shingle under the
first order (found by a shuffle), then under the second and the third; only those are verified.

No large group of documents that share a shingle is expanded into its pairs. First each document
is compared with the smallest one of its group; what that links is one component. What remains are
groups that still hold several components. The pairs of small ones are listed. Documents of large
ones are families of near copies below the threshold or at it: they are dealt to blocks, and each
pair of blocks is compared within a task by products of incidence matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteflow.llm.common import free_name, narrow_join
from noteflow.llm.components import components
from noteflow.llm.shingles import mixed, sequence_key, shingle_hashes, word_slices
from noteflow.staging import cut_lineage

#: Shingles in fewer prefixes count as equally rare. Cells of the tables that shingles are looked
#: up in by the last bits of their hashes: a byte for each of how common they are, a bit for each of
#: whether they are repeated. Beyond the most, which bounds what is broadcast, cells are shared more often: an
#: order is still an order, and what is sent needlessly finds no partner.
RARE = 4
CLASS_CELLS, MOST_CLASS_CELLS = 8, 1 << 26
MARK_CELLS, MOST_MARK_CELLS = 32, 1 << 31
#: Bytes of sets that a task sends on at once, and documents of a block, on average.
FLUSH_BYTES = 4 << 20
BLOCK = 100
#: Columns of an incidence matrix at a time.
COLUMNS = 1 << 13
#: Documents of a group of which the pairs are listed, at most.
SMALL = 64
SALTS = 64
#: Shingles are counted in prefixes so many times as long: some give way to less common ones.
WIDER = 1.5
ORDERS = (0x632BE59BD9B4E019, 0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB)


def _read(batches: Iterator[pa.RecordBatch], k: int):
    """(ids, row in ids, words, sorted distinct shingles) of every document."""
    for batch in batches:
        for first, counts, hashes in word_slices(batch.column(1)):
            ends = np.cumsum(counts)
            for at, (low, high) in enumerate(zip(ends - counts, ends, strict=True)):
                words = hashes[low:high]
                yield batch.column(0), first + at, words, np.unique(shingle_hashes(words, k))


def _flush(schema: pa.Schema, ids: list[pa.Array], rest: list[list]) -> pa.RecordBatch:
    first = pa.concat_arrays(ids).cast(schema[0].type)
    arrays = [pa.array(x, f.type) if not isinstance(x, pa.Array) else x
              for x, f in zip(rest, list(schema)[1:], strict=True)]
    return pa.RecordBatch.from_arrays([first, *arrays], schema=schema)


def _arrow_type(docs: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[column].dataType)


def _summaries(docs: DataFrame, k: int) -> DataFrame:
    """Of each row ``id, n, k1, k2``: size of the set and key of the text, null without words."""
    id_type = docs.schema["id"].dataType.simpleString()
    schema = pa.schema([("id", _arrow_type(docs, "id")), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])

    def run(batches):
        ids, rows = [], []
        for column, row, words, shingles in _read(batches, k):
            ids.append(column.slice(row, 1))
            rows.append((len(shingles), *(sequence_key(words) if len(words) else (None, None))))
            if len(rows) >= 4096:
                yield _flush(schema, ids, list(zip(*rows, strict=True)))
                ids, rows = [], []
        if rows:
            yield _flush(schema, ids, list(zip(*rows, strict=True)))

    return docs.mapInArrow(run, f"id {id_type}, n long, k1 long, k2 long")


def _size(count: int, each: int, most: int) -> int:
    return min(most, max(1 << 16, 1 << (each * count).bit_length()))


def _classes(common: DataFrame) -> np.ndarray:
    """The class of every cell: the logarithm of the largest count of its shingles (``t, c``)."""
    cells = _size(common.count(), CLASS_CELLS, MOST_CLASS_CELLS)
    found = common.groupBy(F.pmod("t", F.lit(cells)).cast("int").alias("m")).agg(
        F.floor(F.log2(F.max("c"))).cast("tinyint").alias("v")).toArrow()
    out = np.zeros(cells, np.uint8)
    out[found["m"].to_numpy()] = found["v"].to_numpy()
    return out


def _marks(repeated: DataFrame) -> np.ndarray:
    """A bit for every cell: whether a repeated shingle (``t``) falls on it."""
    cells = _size(repeated.count(), MARK_CELLS, MOST_MARK_CELLS)
    found = repeated.select(F.pmod("t", F.lit(cells)).cast("int").alias("m")).distinct().toArrow()["m"].to_numpy()
    out = np.zeros(cells // 8, np.uint8)
    np.bitwise_or.at(out, found >> 3, np.left_shift(1, found & 7).astype(np.uint8))
    return out


def _marked(marks: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    at = shingles & np.uint64(8 * len(marks) - 1)
    return (marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _order_keys(shingles: np.ndarray, classes: np.ndarray | None, order: int) -> np.ndarray:
    """Sort keys under a global order: the class of the count, if known, then a hash."""
    keys = mixed(shingles ^ np.uint64(ORDERS[order])) >> np.uint64(6)
    if classes is None:
        return keys
    return (classes[(shingles & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | keys


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _prefix(shingles: np.ndarray, classes: np.ndarray | None, order: int, percent: int, times: float = 1.0) -> np.ndarray:
    size = int(prefix_length(len(shingles), percent) * times)
    keys = _order_keys(shingles, classes, order)
    if size < len(shingles):
        first = np.argpartition(keys, size - 1)[:size]
        return shingles[first[np.argsort(keys[first])]]
    return shingles[np.argsort(keys)]


def _wide_tokens(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``token`` for each shingle in a prefix ``WIDER`` than needed, where all are equally common."""
    schema = pa.schema([("token", pa.int64())])

    def run(batches):
        tokens, held = [], 0
        for _, _, words, shingles in _read(batches, k):
            if len(words):
                tokens.append(_prefix(shingles, None, 0, percent, WIDER).astype(np.int64))
                held += len(tokens[-1])
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens))], schema=schema)
                tokens, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens))], schema=schema)

    return docs.mapInArrow(run, "token long")


def _prefixes(docs: DataFrame, k: int, percent: int, classes) -> DataFrame:
    """``id, n, tokens`` of every document with words: the prefix of its set under the first order."""
    id_type = docs.schema["id"].dataType.simpleString()
    schema = pa.schema([("id", _arrow_type(docs, "id")), ("n", pa.int32()), ("tokens", pa.list_(pa.int64()))])

    def flush(ids, sizes, tokens):
        ends = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens)))
        return _flush(schema, ids, [sizes, lists])

    def run(batches):
        ids, sizes, tokens, held = [], [], [], 0
        for column, row, words, shingles in _read(batches, k):
            if not len(words):
                continue
            ids.append(column.slice(row, 1))
            sizes.append(len(shingles))
            tokens.append(_prefix(shingles, classes.value, 0, percent).astype(np.int64))
            held += len(tokens[-1])
            if held > 100_000:
                yield flush(ids, sizes, tokens)
                ids, sizes, tokens, held = [], [], [], 0
        if held:
            yield flush(ids, sizes, tokens)

    return docs.mapInArrow(run, f"id {id_type}, n int, tokens array<long>")


def _postings(prefixes: DataFrame, marks) -> DataFrame:
    """``id, token, n, r`` of those prefix shingles whose mark is set, ``r`` being the place in
    the order."""
    id_type = prefixes.schema["id"].dataType.simpleString()
    schema = pa.schema([("id", _arrow_type(prefixes, "id")), ("token", pa.int64()), ("n", pa.int32()), ("r", pa.int32())])

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            tokens = lists.values.to_numpy()[ends[0]:ends[-1]]
            counts = np.diff(ends)
            good = np.flatnonzero(_marked(marks.value, tokens.view(np.uint64)))
            row = np.repeat(np.arange(len(counts)), counts)[good]
            places = (np.arange(len(tokens)) - np.repeat(ends[:-1] - ends[0], counts))[good]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)).cast(schema[0].type), pa.array(tokens[good]),
                 batch.column(1).take(pa.array(row)), pa.array(places, pa.int32())], schema=schema)

    return prefixes.mapInArrow(run, f"id {id_type}, token long, n int, r int")


def _forest(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node reached) that join what the links (a, b) of ``count`` nodes join.

    At most one less than the nodes, however many links there are.
    """
    label = np.arange(count)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if np.array_equal(least, label):
            break
        label = least
    node = np.flatnonzero(label != np.arange(count))
    return node, label[node]


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """``id, f, lo, hi, body``: the whole set, sorted, as 64-bit numbers in binary."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("id", "f", "lo", "hi")}
    schema = pa.schema([*[(c, _arrow_type(docs, c)) for c in kinds], ("body", pa.binary())])

    def run(batches):
        for batch in batches:
            rows, bodies, held = [], [], 0
            for _, row, _, shingles in chain(_read(iter([batch]), k), [(None, None, None, None)]):
                if row is not None:
                    rows.append(row)
                    bodies.append(shingles.tobytes())
                    held += len(bodies[-1])
                if rows and (row is None or held > FLUSH_BYTES):
                    at = pa.array(rows)
                    columns = [batch.column(n).take(at).cast(schema.field(c).type)
                               for n, c in ((0, "id"), (2, "f"), (3, "lo"), (4, "hi"))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(bodies, pa.binary())], schema=schema)
                    rows, bodies, held = [], [], 0

    return docs.select("id", "text", "f", "lo", "hi").mapInArrow(
        run, ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", body binary")


def _can_link(na: Column, ra: Column, nb: Column, rb: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar when their first common shingle has these places.

    Both lists are in the same order, so nothing before those places is common. For later common
    shingles the condition only gets stricter: a pair that is similar meets it at its first one.
    """
    most = F.least(na - ra, nb - rb)
    return 100 * most >= percent * (na + nb - most)


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, classes, name: str) -> DataFrame:
    """Links (a, b), written, that join what the pairs that are similar join. ``f`` names the family of a pair.

    A family may be large, and its pairs many more than its documents. Its documents are dealt to
    blocks of ``BLOCK`` on average; a pair belongs to the cell of its two blocks, and a document's
    set, made again from its text, is sent once to each cell that has a pair of it. In a cell, first
    the prefixes under the other orders decide, then the sets themselves.
    """
    nodes = pairs.select("f", F.col("a").alias("w")).unionByName(pairs.select("f", F.col("b").alias("w"))).distinct()
    blocks = nodes.groupBy(F.col("f").alias("g")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    dealt = pairs.join(blocks, F.col("f") == F.col("g"))
    block_a, block_b = (F.pmod(F.xxhash64(c), F.col("blocks")).cast("int") for c in ("a", "b"))
    cells = cut_lineage(dealt.select(
        "a", "b", "f", F.least(block_a, block_b).alias("lo"), F.greatest(block_a, block_b).alias("hi")), "pair-cells")
    places = cut_lineage(cells.select(F.col("a").alias("w"), "f", "lo", "hi").unionByName(
        cells.select(F.col("b").alias("w"), "f", "lo", "hi")).distinct(), "set-places")
    sets = _sets(narrow_join(docs, places, F.col("id") == F.col("w"), "inner"), k)
    id_type = docs.schema["id"].dataType.simpleString()

    def similar(a: np.ndarray, b: np.ndarray, orders: list) -> bool:
        if any(not len(np.intersect1d(x, y, True)) for x, y in orders):
            return False
        common = len(np.intersect1d(a, b, True))
        return 100 * common >= percent * (len(a) + len(b) - common)

    def run(pair: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        body = {w: np.frombuffer(x, np.uint64) for w, x in zip(sent["id"], sent["body"], strict=True)}
        first = {w: [_prefix(x, classes.value, order, percent) for order in (1, 2)] for w, x in body.items()}
        keep = [similar(body[a], body[b], list(zip(first[a], first[b], strict=True)))
                for a, b in zip(pair["a"], pair["b"], strict=True)]
        good = pair.loc[np.array(keep, bool), ["a", "b"]]
        codes, names = pd.factorize(pd.concat([good["a"], good["b"]]), sort=True)
        node, root = _forest(codes[:len(good)], codes[len(good):], len(names))
        names = np.asarray(names)
        return pd.DataFrame({"a": names[node], "b": names[root]})

    key = ["f", "lo", "hi"]
    links = cells.groupBy(*key).cogroup(sets.groupBy(*key)).applyInPandas(run, f"a {id_type}, b {id_type}")
    return cut_lineage(links, name)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share, ``COLUMNS`` elements at a time."""
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[column]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[column >= 0]
    column = column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        here = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        incidence = np.zeros((len(sets), COLUMNS), np.float32)
        incidence[row[here], column[here] - low] = 1
        total += (incidence @ incidence.T).astype(np.int64)
    return total


def _compared(nodes: DataFrame, docs: DataFrame, k: int, percent: int, classes, name: str) -> DataFrame:
    """Links (a, b), written, that join what the links among ``nodes`` (``w, f``) of one family ``f`` join.

    A family of m documents has m/``BLOCK`` blocks, and each document's set is sent once for each
    of them: to the cells of its own block with every block. In a cell, pairs must share a prefix
    shingle under all three orders before their sets are compared.
    """
    blocks = nodes.groupBy(F.col("f").alias("g")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = nodes.join(blocks, F.col("f") == F.col("g"))
    block = F.pmod(F.xxhash64("w"), F.col("blocks")).cast("int")
    dealt = dealt.select("w", "f", block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    places = cut_lineage(dealt.select(
        "w", "f", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).distinct(), "set-places")
    sets = _sets(narrow_join(docs, places, F.col("id") == F.col("w"), "inner"), k)
    id_type = docs.schema["id"].dataType.simpleString()

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates("id").sort_values("id", ignore_index=True)
        body = [np.frombuffer(x, np.uint64) for x in cell["body"]]
        size = np.array([len(x) for x in body])
        may = np.triu(np.ones((len(body), len(body)), bool), 1)
        for order in (0, 1, 2):
            may &= _common([_prefix(x, classes.value, order, percent) for x in body]) > 0
        common = _common(body)
        total = size[:, None] + size[None, :] - common
        node, root = _forest(*np.nonzero(may & (100 * common >= percent * total)), len(body))
        return pd.DataFrame({"a": cell["id"].to_numpy()[node], "b": cell["id"].to_numpy()[root]})

    links = sets.groupBy("f", "lo", "hi").applyInPandas(run, f"a {id_type}, b {id_type}")
    return cut_lineage(links, name)


def similar_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles`` and ``component_id``.

    Words are lower-cased (A-Z) and stand between the six ASCII spaces. The set of a text is that
    of its distinct runs of ``k`` words (fewer words: the whole sequence). Texts are linked when
    the Jaccard similarity of their sets is ``percent``/100 or more; ``component_id`` is the
    smallest id reachable by links, the own one included.

    Without words or text the set is empty and linked with nothing. A row without an id is linked
    with nothing, and its ``component_id`` is null. Rows with one id are one node, with the links of
    all of their texts. Shingles are
    compared by 64-bit hashes, whole texts (to collapse copies first) by 128-bit ones.
    """
    narrow, rows, several = _summed(docs, k, id_col, text)
    if several is None:
        groups = _groups(narrow, rows, k, percent)
    else:
        # Texts are the nodes, then those of one id are joined.
        found = _text_groups(narrow, several, k, percent)
        first = found.groupBy(F.col("component").alias("c")).agg(F.min("id").alias("b"))
        groups = cut_lineage(components(cut_lineage(
            found.join(first, F.col("component") == F.col("c")).select(F.col("id").alias("a"), "b").distinct(),
            "id-links")), "id-components")
    out = rows.join(groups, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.coalesce("component", "id").alias("component_id"))


def _summed(docs: DataFrame, k: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Ids and texts, their summaries, and the ids that have several texts if there are any."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = cut_lineage(_summaries(narrow, k), "shingle-counts")
    keys = rows.where("id IS NOT NULL AND k1 IS NOT NULL").groupBy("id").agg(
        F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("k1", "k2")).alias("high"))
    several = cut_lineage(keys.where("low <> high").select(F.col("id").alias("several_")), "ids-of-several-texts")
    return narrow, rows, several if several.head(1) else None


def _with_node(docs: DataFrame, several: DataFrame, id_col: str, text: str, node: str) -> DataFrame:
    """``docs`` with a ``node`` that is one per id, but one per id and text for ids with several."""
    name = free_name(docs, "several_")
    found = narrow_join(docs, several.withColumnRenamed("several_", name), F.col(id_col) == F.col(name), "left")
    plain = F.hex(id_col) if docs.schema[id_col].dataType.simpleString() == "binary" else F.col(id_col).cast("string")
    key = F.when(F.col(name).isNull(), F.concat(F.lit("1"), plain)).otherwise(
        F.concat(F.lit("2"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256), plain))
    return found.withColumn(node, key).drop(name)


def _text_groups(narrow: DataFrame, several: DataFrame, k: int, percent: int) -> DataFrame:
    """``id, node, component`` of every node with a link, ``component`` being a node; written."""
    noded = _with_node(narrow, several, "id", "text", "w")
    texts = noded.select(F.col("w").alias("id"), "text")
    groups = _groups(texts, cut_lineage(_summaries(texts, k), "text-shingle-counts"), k, percent)
    names = noded.where("w IS NOT NULL").select("id", "w").distinct()
    return cut_lineage(names.join(groups, F.col("w") == F.col("node")).select("id", "node", "component"), "text-components")


def _groups(narrow: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """``node, component`` of the ids with a link, written; rows of one id have one text."""
    spark = narrow.sparkSession
    named = rows.where("id IS NOT NULL AND k1 IS NOT NULL")

    # Copies first: of equal word sequences the smallest id stands for all.
    copies = named.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1")
    copies = copies.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "first")
    copies = cut_lineage(named.join(copies, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
                         .where("id > first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct(),
                         "copies")
    readable = narrow.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    single = narrow_join(readable, copies.select(F.col("a").alias("w")).distinct(), F.col("id") == F.col("w"), "left_anti")

    def repeated(tokens: DataFrame, least: int, name: str) -> DataFrame:
        counts = tokens.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= least)
        return cut_lineage(counts.select(F.col("token").alias("t"), "c"), name)

    # How common shingles are: one table of classes, a byte per cell, orders them.
    common = repeated(_wide_tokens(single, k, percent), RARE, "common-shingles")
    classes = spark.sparkContext.broadcast(_classes(common))

    # Which prefix shingles several documents have. Marks of their cells keep most others from
    # being sent; those that are sent all the same find no partner.
    prefixes = cut_lineage(_prefixes(single, k, percent, classes), "prefixes")
    again = repeated(prefixes.select(F.explode("tokens").alias("token")), 2, "repeated-shingles")
    marks = spark.sparkContext.broadcast(_marks(again))
    shared = cut_lineage(_postings(prefixes, marks), "shared-postings")
    heads = shared.groupBy("token").agg(F.min(F.struct("id", "n", "r")).alias("head"), F.count("*").alias("c")).where("c > 1")
    # A shingle that very many documents have is split; its head goes to the salts in use.
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    salted = shared.withColumn("salt", salt)
    spread = salted.select(F.col("token").alias("u"), "salt").distinct()
    heads = heads.join(spread, F.col("token") == F.col("u")).select(
        F.col("token").alias("t"), F.col("salt").alias("s"), "head")
    headed = salted.join(heads, (F.col("token") == F.col("t")) & (F.col("salt") == F.col("s")))
    star = headed.where((F.col("id") != F.col("head.id")) & _can_link(F.col("n"), F.col("r"), F.col("head.n"), F.col("head.r"), percent))
    star = cut_lineage(star.select(F.col("id").alias("a"), F.col("head.id").alias("b")).distinct(), "star-pairs")
    star = star.withColumn("f", F.col("b"))
    links = _verified(star, single, k, percent, classes, "star-links")
    groups = cut_lineage(components(links), "star-components")

    # What the stars have not joined: groups with several components.
    labelled = shared.join(groups.select(F.col("node").alias("g"), "component"), F.col("id") == F.col("g"), "left")
    labelled = labelled.select("token", "id", "n", "r", F.coalesce("component", "id").alias("label"))
    several = labelled.groupBy("token").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c")).where("low <> high")
    several = cut_lineage(several.select(F.col("token").alias("t"), "c"), "open-groups")
    small = labelled.join(several.where(F.col("c") <= SMALL), F.col("token") == F.col("t"), "left_semi")
    small = cut_lineage(small, "small-groups")
    left = small.select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("r").alias("ra"), F.col("label").alias("la"))
    right = small.select(F.col("token").alias("t"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"),
                         F.col("label").alias("lb"))
    rest = left.join(right, (F.col("token") == F.col("t")) & (F.col("la") < F.col("lb"))
                     & _can_link(F.col("na"), F.col("ra"), F.col("nb"), F.col("rb"), percent)).select("a", "b").distinct()
    known = star.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
    rest = cut_lineage(rest.join(known, (F.greatest("a", "b") == F.col("x")) & (F.least("a", "b") == F.col("y")),
                                 "left_anti"), "rest-pairs")
    if rest.head(1):
        families = components(rest).select(F.col("node").alias("m"), F.col("component").alias("f"))
        rest = rest.join(families, F.col("a") == F.col("m")).drop("m")
        links = links.unionByName(_verified(rest, single, k, percent, classes, "rest-links"))
    # Of two sets that are similar, the smaller one has the shingle at an early place: common
    # passages of long texts come late and make no family.
    early = _can_link(F.col("n"), F.col("r"), F.col("n"), F.col("r"), percent)
    large = labelled.join(several.where(F.col("c") > SMALL).select(F.col("t").alias("s")),
                          F.col("token") == F.col("s"), "left_semi")
    large = cut_lineage(large.withColumn("early", early), "large-groups")
    bounds = large.where("early").groupBy(F.col("token").alias("t")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("id").alias("first"))
    large = large.join(bounds, F.col("token") == F.col("t")).where(
        F.col("early") | (F.col("n") >= F.col("least")) & (percent * F.col("n") <= 100 * F.col("most")))
    large = cut_lineage(large.select(F.col("id").alias("a"), F.col("first").alias("b")).distinct(), "family-edges")
    if large.head(1):
        # Similar sets lie in one band of sizes or in neighbouring ones: a family is compared by
        # bands. (Should two names of bands be equal, more is compared than needed.)
        families = components(large).select(F.col("node").alias("w"), "component")
        sizes = shared.select(F.col("id").alias("i"), "n").distinct()
        band = F.floor(F.log(F.col("n")) / F.lit(math.log(1.001 * 100 / percent)))
        families = families.join(sizes, F.col("w") == F.col("i")).select(
            "w", "component", F.explode(F.array(band, band - 1)).alias("band"))
        families = families.select("w", F.xxhash64("component", "band").alias("f"))
        links = links.unionByName(_compared(families, single, k, percent, classes, "family-links"))
    return cut_lineage(components(links.unionByName(copies)), "components")


def drop_similar(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """The rows of which one stays per component, that with the smallest id; all columns.

    Rows without an id or without words stay. Where rows of one id differ in text, each text is
    kept or dropped by its own links.
    """
    narrow, rows, several = _summed(docs, k, id_col, text)
    if several is not None:
        found = _text_groups(narrow, several, k, percent)
        first = found.groupBy(F.col("component").alias("c")).agg(F.min(F.struct("id", "node")).alias("first"))
        node, name = free_name(docs, "node_"), free_name(docs, "gone_")
        gone = cut_lineage(found.join(first, F.col("component") == F.col("c")).where(F.col("node") != F.col("first.node"))
                           .select(F.col("node").alias(name)), "similar-dropped")
        return narrow_join(_with_node(docs, several, id_col, text, node), gone,
                           F.col(node) == F.col(name), "left_anti").select(*docs.columns)
    found = rows.join(_groups(narrow, rows, k, percent), F.col("id") == F.col("node")).select(
        F.col("id").alias(id_col), F.col("component").alias("component_id"))
    gone = cut_lineage(found.where(F.col(id_col) != F.col("component_id"))
                       .select(F.col(id_col).alias("gone_")).distinct(), "similar-dropped")
    name = "gone_"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return narrow_join(docs, gone.withColumnRenamed("gone_", name), F.col(id_col) == F.col(name), "left_anti")
