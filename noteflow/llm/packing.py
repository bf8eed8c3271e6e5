"""Packing of token sequences into rows of fixed length by best-two-fit.

Texts become token ids in tasks, one row per piece of at most ``capacity`` ids; only ids of rows
and lengths go on. Pieces are dealt evenly to groups of bounded size, and each group is packed by
itself: at most one sequence per group is partly filled for want of pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflow.llm.common import require
from noteflow.llm.shingles import SLICE, SPACE, span_hashes, utf8
from noteflow.staging import cut_lineage

CAPACITY = 2048
END = 0
#: Pieces that one task packs together, on average.
GROUP_PIECES = 20_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A number for each byte, by which words are hashed.
CASED = np.random.Generator(np.random.PCG64(6)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
CACHED_CHARS = 4_000_000
CACHED_BYTES = 8_000_000
#: Ids that a task sends on at once, about.
HELD_IDS = 1 << 20
#: Signs that are a unit of their own after letters; letters below ``LATIN_END`` are composed, and
#: have one small form.
SIGNS = frozenset(".,;:!?")
LATIN_END = "\u0130"
BATCH_CHARS = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, and the byte.

    Printable bytes of Latin-1 stand for themselves, all others for the letters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


_LETTER = {b: c for c, b in byte_letters().items()}
BYTES = {c: "".join(_LETTER[b] for b in chr(c).encode()) for c in range(0x80, ord(LATIN_END))}


class WordEncoder:
    """Token ids of texts, by way of their distinct words and the distinct units of those.

    For tokenizers that never join characters across white space. New words are normalised and
    cut by the tokenizer many at a time, and its model sees each unit once. Words are found in the
    bytes of many texts at once and looked up by their hashes; their bytes are then compared
    with those of the words found. What is known is kept
    until ``CACHED_BYTES`` bytes of words are held; then the store starts anew.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.units: dict[str, tuple[int, ...]] = {}
        self.at = self.size = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)
        # Sorted hashes of words and the slots they stand for; the bytes of the word in each slot.
        self.hashes, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.spelled, self.spelled_at = np.empty(0, np.uint8), np.zeros(1, np.int64)

    def _unit(self, unit: str) -> tuple[int, ...]:
        ids = self.units.get(unit)
        if ids is None:
            ids = self.units[unit] = tuple([t.id for t in self.tokenizer.model.tokenize(unit)])
        return ids

    def _cut(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, by the tokenizer's own normaliser and cutter."""
        joined = " ".join(words)
        cut = self.tokenizer.normalizer.normalize_str(joined)
        lengths = [len(w) + 1 for w in cut.split(" ")]
        found: list[list[int]] = [[] for _ in words]
        if len(lengths) != len(words) or any(s in joined for s in self.special):
            out = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
            for n, token in zip(out.word_ids, out.ids, strict=True):
                found[n].append(token)
            return found
        parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(cut)
        places = np.searchsorted(np.cumsum(lengths), [start for _, (start, _) in parts], "right")
        for n, (unit, _) in zip(places.tolist(), parts, strict=True):
            found[n] += self._unit(unit)
        return found

    def _encode_words(self, words: list[str]) -> list[Sequence[int]]:
        """The ids of each word. Latin letters with at most one sign after them, which are most
        words, need no cutting: they are one unit, and the sign is another."""
        out: list[Sequence[int]] = []
        odd = []
        for n, word in enumerate(words):
            sign = word[-1] if word[-1] in SIGNS else ""
            body = word[:-1] if sign else word
            if body.isalpha() and (body.isascii() or max(body) < LATIN_END):
                unit = body.lower() if body.isascii() else body.lower().translate(BYTES)
                ids = self._unit(unit)
                out.append(ids + self._unit(sign) if sign else ids)
            else:
                odd.append(n)
                out.append(())
        if odd:
            for n, ids in zip(odd, self._cut([words[n] for n in odd]), strict=True):
                out[n] = ids
        return out

    def _encode_many(self, words: list[str]) -> list[Sequence[int]]:
        return [ids for low in range(0, len(words), 2000) for ids in self._encode_words(words[low:low + 2000])]

    def _learn(self, new: list[bytes], hashes: np.ndarray) -> None:
        """Add words by their hashes, which ascend and are not known yet."""
        found = self._encode_many([w.decode() for w in new])
        slots = np.arange(len(self.size), len(self.size) + len(new))
        places = np.searchsorted(self.hashes, hashes)
        self.hashes, self.slot = np.insert(self.hashes, places, hashes), np.insert(self.slot, places, slots)
        self.ids = np.concatenate([self.ids, np.array(list(chain.from_iterable(found)), np.uint32)])
        self.size = np.concatenate([self.size, np.fromiter(map(len, found), np.int64, len(found))])
        self.at = np.cumsum(self.size) - self.size
        self.spelled = np.concatenate([self.spelled, np.frombuffer(b"".join(new), np.uint8)])
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new))) + self.spelled_at[-1]
        self.spelled_at = np.concatenate([self.spelled_at, ends])

    def _known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots of hashes, which of them are known)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.slot[at], self.hashes[at] == hashes

    def _encode_bytes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of the words of some bytes, their ids in a row, where the ids of each word end)."""
        space = SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        hashes, again = np.unique(span_hashes(data, start, end, CASED), return_inverse=True)
        slots, known = self._known(hashes)
        if not known.all():
            first = np.empty(len(hashes), np.int64)
            first[again[::-1]] = np.arange(len(start))[::-1]
            new = np.flatnonzero(~known)
            self._learn([data[start[n]:end[n]].tobytes() for n in first[new]], hashes[new])
            slots, _ = self._known(hashes)
        slots, lengths = slots[again], end - start
        low = self.spelled_at[slots]
        same = np.array_equal(self.spelled_at[slots + 1] - low, lengths)
        if same:
            before = np.cumsum(lengths) - lengths
            same = np.array_equal(self.spelled[np.arange(lengths.sum()) + np.repeat(low - before, lengths)], data[~space])
        if not same:  # different words share a hash
            words = [data[x:y].tobytes().decode() for x, y in zip(start, end)]
            distinct = list(dict.fromkeys(words))
            ids = dict(zip(distinct, self._encode_many(distinct), strict=True))
            found = [ids[w] for w in words]
            return start, np.array(list(chain.from_iterable(found)), np.uint32), np.cumsum([len(x) for x in found])
        sizes = self.size[slots]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return start, self.ids[np.arange(total) + np.repeat(self.at[slots] - (ends - sizes), sizes)], ends

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return list(self.encode_column(pa.array(texts, pa.string())))

    def encode_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, null being empty; memory is bounded by ``SLICE`` and by one text's ids."""
        data, at = utf8(column)
        row, rows = 0, len(column)
        while row < rows:
            if len(self.spelled) > CACHED_BYTES:
                self._reset()
            last = max(row + 1, int(np.searchsorted(at, at[row] + SLICE, "right")) - 1)
            low, high = int(at[row]), int(at[last])
            if high - low <= SLICE:
                lengths = np.diff(at[row:last + 1])
                apart = np.full(high - low + last - row, 0x20, np.uint8)
                apart[np.arange(high - low) + np.repeat(np.arange(last - row), lengths)] = data[low:high]
                start, ids, ends = self._encode_bytes(apart)
                words = np.searchsorted(start, np.cumsum(lengths + 1))
                yield from np.split(ids, np.concatenate(([0], ends))[words][:-1])
            else:
                found = []
                while low < high:
                    cut = min(low + SLICE, high)
                    while cut < high and not SPACE[data[cut]]:
                        near = np.flatnonzero(SPACE[data[cut:cut + SLICE]])
                        cut = cut + int(near[0]) if len(near) else min(cut + SLICE, high)
                    found.append(self._encode_bytes(data[low:cut])[1])
                    low = cut
                yield np.concatenate(found)
            row = last


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with a bounded number of characters, or a single longer one."""
    low = held = 0
    for at, text in enumerate(texts):
        if held and held + len(text) > BATCH_CHARS:
            yield low, at
            low, held = at, 0
        held += len(text)
    if low < len(texts):
        yield low, len(texts)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
           text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Rows ``id_col, piece, start, length, ids_crc32, salt``, with ``ids`` if ``keep_ids``.

    A document is its token ids and then id 0; longer ones are cut after every ``capacity`` ids.
    A null or empty text is the single id 0. ``salt`` numbers the rows of a task.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    require(docs, [id_col, text])
    fields = [(id_col, to_arrow_type(docs.schema[id_col].dataType)), ("piece", pa.int32()), ("start", pa.int64()),
              ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for batch in batches:
            rows, out, held = [], [], 0
            for at, ids in enumerate(encoder(path).encode_column(batch.column(1))):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for number, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    rows.append(at)
                    out.append((number, start, len(part), zlib.crc32(part.tobytes()), salt,
                                *([part.astype(np.int32)] * keep_ids)))
                    salt += 1
                held += len(ids)
                if held > HELD_IDS or at == batch.num_rows - 1:
                    columns = [batch.column(0).take(pa.array(rows)).cast(schema[0].type)]
                    columns += [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                    rows, out, held = [], [], 0

    return docs.select(id_col, text).mapInArrow(
        run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, salt long"
        + ", ids array<int>" * keep_ids)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length (1 to ``capacity``).

    A bin takes the longest unpacked piece that fits until none does. Then its smallest piece
    gives way to the two unpacked pieces that fill the gap so expanded best, if they fill more
    than it did, and what still fits is added. Sets of lengths at hand are bits of whole numbers,
    so "the longest up to x" and "two that sum to x" are a shift and a mask.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for at in np.argsort(lengths, kind="stable")[::-1]:
        stacks[lengths[at]].append(int(at))
    ahead = sum(1 << n for n in range(1, capacity + 1) if stacks[n])
    back = sum(1 << (capacity - n) for n in range(1, capacity + 1) if stacks[n])
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(n: int) -> int:
        nonlocal ahead, back
        at = stacks[n].pop()
        if not stacks[n]:
            ahead ^= 1 << n
            back ^= 1 << (capacity - n)
        return at

    def give(n: int, at: int) -> None:
        nonlocal ahead, back
        if not stacks[n]:
            ahead ^= 1 << n
            back ^= 1 << (capacity - n)
        stacks[n].append(at)

    def fill(held: list[tuple[int, int]], gap: int) -> int:
        while gap and (fits := ahead & ((2 << gap) - 1)):
            n = fits.bit_length() - 1
            held.append((n, take(n)))
            gap -= n
        return gap

    def best_two(least: int, most: int) -> tuple[int, int] | None:
        for total in range(most, least, -1):
            pairs = ahead & (back >> (capacity - total)) & ((1 << total) - 1)
            while pairs:
                first = pairs.bit_length() - 1
                if 2 * first != total or len(stacks[first]) > 1:
                    return first, total - first
                pairs ^= 1 << first
        return None

    number = 0
    while ahead:
        held: list[tuple[int, int]] = []
        gap = fill(held, capacity)
        smallest = held[-1]
        if gap and (two := best_two(smallest[0], gap + smallest[0])):
            held.pop()
            held += [(n, take(n)) for n in two]
            give(*smallest)
            fill(held, gap + smallest[0] - sum(two))
        offset = 0
        for n, at in held:
            bins[at], offsets[at] = number, offset
            offset += n
        number += 1
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``length`` and ``salt``; drops ``salt``.

    ``parts`` must be written rows: the number of groups comes from their count, and their salts
    must not change between two reads.
    """
    groups = max(1, -(-parts.count() // group_pieces))
    names = [c for c in parts.columns if c != "salt"]
    dealt = parts.withColumn("group", F.pmod(F.xxhash64(*[c for c in parts.columns if c != "ids"]), F.lit(groups)))
    types = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in names)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_two_fit(rows["length"].to_numpy(), capacity)
        return rows[names].assign(sequence_id=bins * groups + rows["group"].iloc[0], offset=offsets)

    return dealt.groupBy("group").applyInPandas(run, f"{types}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                     text: str = "text", keep_ids: bool = False) -> DataFrame:
    """All rows of ``docs`` in sequences of at most ``capacity`` ids, a row per piece.

    ``id_col, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``). Repeated rows
    and rows without an id are packed like others; an empty table gives no rows. Other columns
    of ``docs`` are left out.
    """
    parts = cut_lineage(pieces(docs, path, capacity, id_col, text, keep_ids), "pieces")
    return pack(parts, capacity)
