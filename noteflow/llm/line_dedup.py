"""Lines that many documents share, found by two Bloom filters over hashes and confirmed by their text.

One pass over the texts fills two bit tables: cells that some line fell on, and cells that two or
more did. Both merge by or and and, so tasks fill their own and send only the cells they touched. A
line all of whose cells were hit twice may be repeated; only such lines are shuffled, each once per
task and text, and counted by their text. The keys found often enough fill a last filter, by which
a pass over the texts tells the lines to drop. Texts stay where they are until the lines to
drop are joined to them by a hash of the text, so a text that has thousands of copies is one row there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from noteflow.llm.common import free_name, require
from noteflow.llm.shingles import SLICE, SPACE, mixed, span_hashes, utf8
from noteflow.staging import cut_lineage

NEWLINE = 0x0A
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Keys of more bytes are hashed one by one.
LONG_KEY = 1 << 16
#: Cells per line, cells a line falls on, and cells at most: a filter is a bit for each, so what is
#: broadcast is at most 256 MB. With more lines than that serves, more of those that are not
#: repeated are shuffled and counted; the result is the same.
CELLS_PER_LINE = 8
HASHES = 3
MOST_CELLS = 1 << 31
SEGMENT = 1 << 20
#: Cells that a task holds before it sends them on.
HELD = 1 << 20


def _spans(data: np.ndarray, hashed: bool = True):
    """(key start, key end, hash) of the lines in bytes that end with a newline; blank keys are empty."""
    end = np.flatnonzero(data == NEWLINE)
    start = np.concatenate(([0], end[:-1] + 1))
    solid = np.flatnonzero(~SPACE[data])
    low, high = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = low < high
    first, last = start.copy(), start.copy()
    first[some], last[some] = solid[low[some]], solid[high[some] - 1] + 1
    hashes = np.zeros(len(end), np.uint64)
    short = np.flatnonzero(some & (last - first <= LONG_KEY))
    hashes[short] = span_hashes(data, first[short], last[short])
    for at in np.flatnonzero(some & (last - first > LONG_KEY)):
        hashes[at] = _long_hash(data[first[at]:last[at]].tobytes())
    return first, last, hashes


def _long_hash(key: bytes) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(key.translate(LOWER), digest_size=8).digest(), "little"))


def lines(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, rows, line numbers, key starts, key ends, hashes) of the lines of a text column, in order.

    A piece holds whole texts of up to ``SLICE`` bytes, or lines of one longer text, or one longer line.
    """
    data, at = utf8(column)
    row, rows = 0, len(column)
    while row < rows:
        last = max(row + 1, int(np.searchsorted(at, at[row] + SLICE, "right")) - 1)
        low, high = int(at[row]), int(at[last])
        if high - low <= SLICE:
            lengths = np.diff(at[row:last + 1])
            apart = np.full(high - low + last - row, NEWLINE, np.uint8)
            apart[np.arange(high - low) + np.repeat(np.arange(last - row), lengths)] = data[low:high]
            spans = _spans(apart)
            stops = np.cumsum(lengths + 1)
            counts = np.diff(np.searchsorted(np.flatnonzero(apart == NEWLINE), np.concatenate(([0], stops))))
            numbers = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            yield apart, np.repeat(np.arange(row, last), counts), numbers, *spans
        else:
            number = 0
            while low <= high:
                stop = low + SLICE
                near = np.flatnonzero(data[low:min(stop, high)] == NEWLINE)
                if stop >= high:
                    stop = high
                elif len(near):
                    stop = low + int(near[-1])
                else:
                    while stop < high and data[stop] != NEWLINE:
                        near = np.flatnonzero(data[stop:min(stop + SLICE, high)] == NEWLINE)
                        stop = stop + int(near[0]) if len(near) else min(stop + SLICE, high)
                piece = np.append(data[low:stop], np.uint8(NEWLINE))
                spans = _spans(piece)
                yield piece, np.full(len(spans[0]), row), np.arange(number, number + len(spans[0])), *spans
                number += len(spans[0])
                low = stop + 1
        row = last


def _long_enough(data: np.ndarray, first: np.ndarray, last: np.ndarray, min_chars: int) -> np.ndarray:
    if min_chars <= 1:
        return last - first >= min_chars
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points[last] - points[first] >= min_chars


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """The cells of each hash, a row of ``HASHES`` for each."""
    with np.errstate(over="ignore"):
        step = mixed(hashes ^ np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
        return np.stack([(hashes + step * np.uint64(n)) & np.uint64(cells - 1) for n in range(HASHES)], 1).astype(np.int64)


def _wanted_cells(count: int) -> int:
    wanted = max(SEGMENT, CELLS_PER_LINE * count)
    return min(MOST_CELLS, 1 << (wanted - 1).bit_length())


TOUCHED = "segment int, once binary, twice binary"


def _touched(column: str, cells: int, min_chars: int):
    """Per task, the cells its lines fell on, and those that two of them did, by segments of cells."""
    schema = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        segments, first = np.unique(found // SEGMENT, return_index=True)
        rows = []
        for segment, low, high in zip(segments, first, [*first[1:], len(found)]):
            here = (found[low:high] % SEGMENT).astype(np.uint32)
            rows.append((segment, here.tobytes(), here[counts[low:high] > 1].tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for data, rows, _, first, last, hashes in lines(batch.column(column)):
                good = _long_enough(data, first, last, min_chars)
                # A text counts once, however often it repeats a line.
                pairs = np.unique(np.stack([rows[good].astype(np.uint64), hashes[good]]), axis=1) if good.any() else None
                if pairs is None:
                    continue
                # Of one line, cells that agree count once.
                own = np.sort(_cells(pairs[1], cells), 1)
                fresh = np.ones(own.shape, bool)
                fresh[:, 1:] = own[:, 1:] != own[:, :-1]
                held.append(own[fresh])
                count += len(held[-1])
                if count > HELD:
                    yield flush(held)
                    held, count = [], 0
        if held:
            yield flush(held)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both tables of each segment as bits; rows come sorted by segment, one segment is held."""
    schema = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    here, once, twice = None, None, None

    def done():
        bits = [np.packbits(x, bitorder="little").tobytes() for x in (once, twice)]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((here, *bits), schema)], schema=schema)

    for batch in batches:
        for segment, a, b in zip(*(batch.column(n).to_pylist() for n in range(3))):
            if segment != here:
                if here is not None:
                    yield done()
                here, once, twice = segment, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
            a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
            twice[a] |= once[a]
            once[a] = True
            twice[b] = True
    if here is not None:
        yield done()


def bloom_filter(texts: DataFrame, column: str, cells: int, plane: str, min_chars: int = 1) -> np.ndarray:
    """The bits of the cells that lines of ``texts`` fell on ``once`` or more, or ``twice`` or more."""
    parts = texts.select(column).mapInArrow(_touched(column, cells, min_chars), TOUCHED)
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged, TOUCHED)
    found = merged.select("segment", plane).toArrow()  # a bit per cell at most
    out = np.zeros(cells // 8, np.uint8)
    for segment, bits in zip(found["segment"].to_pylist(), found[plane].to_pylist()):
        out[segment * SEGMENT // 8:(segment + 1) * SEGMENT // 8] = np.frombuffer(bits, np.uint8)
    return out


def _hit(bits: np.ndarray, hashes: np.ndarray, cells: int) -> np.ndarray:
    at = _cells(hashes, cells)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(1)


def _suspects(docs: DataFrame, bits, cells: int, min_chars: int, every_line: bool) -> DataFrame:
    """``by, key, line`` of the lines of ``docs`` (``by, text``) that the filter knows.

    Each key of a text comes once, with its first line, or for ``every_line`` of it.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["by"].dataType
    schema = pa.schema([("by", to_arrow_type(kind)), ("key", pa.string()), ("line", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here, seen = None, set()
            for data, rows, numbers, first, last, hashes in lines(batch.column(1)):
                good = np.flatnonzero(_long_enough(data, first, last, min_chars))
                good = good[_hit(bits.value, hashes[good], cells)]
                at, keys, places = [], [], []
                for row, number, low, high in zip(*(x[good].tolist() for x in (rows, numbers, first, last))):
                    key = data[low:high].tobytes().translate(LOWER)
                    if row != here:
                        here, seen = row, set()
                    if every_line or key not in seen:
                        seen.add(key)
                        at.append(row)
                        keys.append(key)
                        places.append(number)
                if at:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)).cast(schema[0].type),
                         pa.array(keys, pa.binary()).cast(pa.string()), pa.array(places, pa.int32())], schema=schema)

    return docs.select("by", "text").mapInArrow(run, f"by {kind.simpleString()}, key string, line int")


def _count_lines(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long") + 1


def common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``key, n_docs, first_id, first_line`` of the keys that ``min_docs`` rows or more hold; written.

    A key is a line without the six ASCII spaces at its ends, with a-z for A-Z, of ``min_chars`` code
    points or more. The first place is that with the smallest id (null last), then line.
    """
    texts = docs.select(F.col(id_col).alias("by"), F.coalesce(text, F.lit("")).alias("text"))
    count = texts.agg(F.sum(_count_lines(F.col("text")))).first()[0] or 0
    cells = _wanted_cells(count)
    bits = docs.sparkSession.sparkContext.broadcast(bloom_filter(texts, "text", cells, "twice", min_chars))
    found = _suspects(texts, bits, cells, min_chars, every_line=False)
    first = F.min(F.struct(F.col("by").isNull().alias("none"), "by", "line")).alias("first")
    often = found.groupBy("key").agg(F.count("*").alias("n_docs"), first).where(F.col("n_docs") >= min_docs)
    return cut_lineage(often.select("key", "n_docs", F.col("first.by").alias("first_id"),
                                    F.col("first.line").alias("first_line")), "common-lines")


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
                      id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, the text without the lines whose key many documents hold.

    Adds ``n_lines`` (before) and ``n_dropped``, with ``_`` after the name where ``docs`` has such a column. Lines
    end at ``\\n``; those that stay are joined by it, and a null text counts as one empty line. A key as
    in ``common_lines`` is dropped wherever it stands if ``min_docs`` rows (2 at least) hold it; rows that are repeated
    or lack an id are documents of their own. With ``keep_first`` it stays at its first place (in
    all equal rows with that id). An empty table gives an empty one.
    """
    require(docs, [id_col, text])
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    common = common_lines(docs, min_docs, min_chars, id_col, text)
    cells = _wanted_cells(common.count())
    bits = docs.sparkSession.sparkContext.broadcast(bloom_filter(common, "key", cells, "once"))
    whole = F.coalesce(F.col(text), F.lit(""))
    hashed = F.unhex(F.sha2(whole, 256))
    lines_of = _suspects(docs.select(hashed.alias("by"), whole.alias("text")), bits, cells, min_chars, every_line=True)
    known = common.select(F.col("key").alias("k"), "first_id", "first_line")
    places = lines_of.distinct().join(known, F.col("key") == F.col("k"))
    by, drop = free_name(docs, "by_"), free_name(docs, "drop_")
    drops = cut_lineage(places.groupBy(F.col("by").alias(by)).agg(
        F.collect_list(F.struct("line", "first_id", "first_line")).alias(drop)), "dropped-lines")
    own = free_name(docs, "own_")
    joined = docs.withColumn(own, hashed).join(drops, F.col(own) == F.col(by), "left")
    stays = lambda d: (d["line"] == d["first_line"]) & d["first_id"].eqNullSafe(F.col(id_col)) & F.lit(keep_first)
    places = F.transform(F.filter(drop, lambda d: ~stays(d)), lambda d: d["line"])
    gone = F.when(F.size(drop) > 0, places)
    cut = F.when(F.size(gone) > 0, _without(F.when(F.size(gone) > 0, whole), gone)).otherwise(whole)
    columns = [cut.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, _count_lines(whole).alias(free_name(docs, "n_lines")),
                         F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(free_name(docs, "n_dropped")))


@F.pandas_udf(StringType())
def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for whole, places in zip(text, gone):
        if whole is None:
            out.append(None)
            continue
        drop = set(places.tolist())
        out.append("\n".join([x for n, x in enumerate(whole.split("\n")) if n not in drop]))
    return pd.Series(out, dtype=object)
