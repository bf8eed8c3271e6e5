"""Word and shingle hashes of Arrow text columns, vectorised over the bytes of many texts.

Used inside of tasks. Texts are taken in slices of bounded size, so memory does not follow the
size of a batch; a longer text is cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C17 | 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LETTERS = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
LETTERS[ord("A"):ord("Z") + 1] = LETTERS[ord("a"):ord("z") + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    tables = []
    with np.errstate(over="ignore"):
        for base in (BASE, inverse):
            table = np.full(size + 1, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
    return tables[0], tables[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offsets of the texts; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray = LETTERS) -> np.ndarray:
    """Hashes of spans of bytes, none of them empty; with these ``letters`` A-Z counts as a-z."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = max(SLICE, 1 << int(len(data)).bit_length())
    power, inverse = _powers(size)
    with np.errstate(over="ignore"):
        total = np.cumsum(letters[data] * power[:len(data)])
        before = np.where(start > 0, total[np.maximum(start, 1) - 1], np.uint64(0))
        return mixed((total[end - 1] - before) * inverse[start])


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a slice; A-Z counts as a-z."""
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return edge[::2], span_hashes(data, edge[::2], edge[1::2])


def word_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word counts of the rows, hashes of all their words) for runs of rows."""
    data, at = utf8(column)
    row, rows = 0, len(column)
    while row < rows:
        last = max(row + 1, int(np.searchsorted(at, at[row] + SLICE, "right")) - 1)
        low, high = int(at[row]), int(at[last])
        if high - low <= SLICE:
            # A space between texts keeps words of neighbours apart.
            lengths = np.diff(at[row:last + 1])
            apart = np.full(high - low + last - row, 0x20, np.uint8)
            places = np.arange(high - low) + np.repeat(np.arange(last - row), lengths)
            apart[places] = data[low:high]
            start, hashes = _hash_words(apart)
            ends = np.cumsum(lengths + 1)
            counts = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
        else:
            found = []
            while low < high:
                cut = min(low + SLICE, high)
                while cut < high and not SPACE[data[cut]]:
                    step = data[cut:cut + SLICE]
                    near = np.flatnonzero(SPACE[step])
                    cut = cut + int(near[0]) if len(near) else min(cut + SLICE, high)
                found.append(_hash_words(data[low:cut])[1])
                low = cut
            hashes = np.concatenate(found)
            counts = np.array([len(hashes)])
        yield row, counts, hashes
        row = last


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of fewer words, one hash of the whole sequence."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    span = min(size, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - span + 1, span, np.uint64)
        for step in range(span):
            total = total * BASE + words[step:len(words) - span + 1 + step]
    return mixed(total)


def sequence_key(words: np.ndarray) -> tuple[int, int]:
    """128 bits of a sequence of words, as two signed 64-bit numbers."""
    with np.errstate(over="ignore"):
        place = np.arange(1, len(words) + 1, dtype=np.uint64)
        parts = [mixed(mixed(words + np.uint64(seed)) ^ mixed(place * np.uint64(seed))).sum(dtype=np.uint64)
                 for seed in (0xA24BAED4963EE407, 0x9FB21C651E98DF25)]
    return tuple(int(x.astype(np.int64)) for x in parts)
