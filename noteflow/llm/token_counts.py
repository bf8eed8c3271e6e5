"""Greedy longest-match token counts by an automaton that never builds a piece.

The vocabulary is a trie. Where no longer match exists at a node, the tokens that greedy matching
takes from the text so far are known beforehand: their number is stored at the node together with
a failure link to the node of what remains. A word is read once, symbol by symbol, and its count
is the sum of the numbers on the failure links it takes, in time linear in its length.

The automaton runs inside of tasks, over all distinct words of a run of texts at a time.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from noteflow.llm.common import require
from noteflow.llm.packing import CACHED_CHARS, WORD, _runs, byte_letters

#: Fixed value: units of a word as the vocabulary's tokenizer cuts them.
UNIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END_MARK = "</w>"
#: Symbols: a byte inside of a unit, or a unit's last byte plus 256.
SYMBOLS = 512


class Automaton:
    """Trie with failure links over tokens given as tuples of symbols.

    Every symbol that occurs in texts must be a token itself, so that matching never gets stuck.
    """

    def __init__(self, tokens: Iterable[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for token in tokens:
            node = 0
            for symbol in token:
                following = children[node].get(symbol)
                if following is None:
                    following = children[node][symbol] = len(children)
                    children.append({})
                    final.append(False)
                node = following
            final[node] = bool(token)
        fail, pops = [0] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for symbol, child in children[node].items():
                queue.append(child)
                if final[child]:
                    pops[child], fail[child] = 1, 0
                    continue
                if node == 0:
                    raise ValueError(f"symbol {symbol} begins tokens and is none")
                rest, popped = fail[node], pops[node]
                while symbol not in children[rest]:
                    if rest == 0:
                        raise ValueError(f"symbol {symbol} is within tokens and is none")
                    popped += pops[rest]
                    rest = fail[rest]
                pops[child], fail[child] = popped, children[rest][symbol]
        self.pops, self.fail = np.array(pops), np.array(fail)
        edges = sorted((node * SYMBOLS + symbol, child) for node, c in enumerate(children) for symbol, child in c.items())
        self.edges = np.array([e for e, _ in edges], np.int64)
        self.child = np.array([c for _, c in edges], np.int64)

    def counts(self, units: list[bytes]) -> np.ndarray:
        """Number of tokens of each unit; an empty one has none."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        symbols = np.frombuffer(b"".join(units[i] for i in order), np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        symbols[(starts + sizes - 1)[sizes > 0]] += 256
        node, total = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            waiting = np.arange(np.searchsorted(-sizes, -step, "left"))
            while len(waiting):
                at = node[waiting]
                edge = at * SYMBOLS + symbols[starts[waiting] + step]
                place = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
                found = self.edges[place] == edge
                node[waiting[found]] = self.child[place[found]]
                waiting, at = waiting[~found], at[~found]
                if (at == 0).any():
                    raise ValueError("a symbol of the text is no token")
                total[waiting] += self.pops[at]
                node[waiting] = self.fail[at]
        while (left := node > 0).any():
            total[left] += self.pops[node[left]]
            node[left] = self.fail[node[left]]
        out = np.empty(len(units), np.int64)
        out[order] = total
        return out


def vocabulary_tokens(path: str) -> list[tuple[int, ...]]:
    """The tokens of a word-end vocabulary as symbols."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    tokens = []
    for token in vocab:
        last = token.endswith(END_MARK) and len(token) > len(END_MARK)
        symbols = [letters[c] for c in (token.removesuffix(END_MARK) if last else token)]
        if last:
            symbols[-1] += 256
        tokens.append(tuple(symbols))
    return tokens


class WordCounter:
    """Token counts of words between the six ASCII spaces, kept per word up to a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.automaton = Automaton(vocabulary_tokens(path))
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.known: dict[str, int] = {}
        self.chars = 0

    def _learn(self, words: list[str]) -> None:
        joined = self.normalizer.normalize_str(" ".join(words)).split(" ")
        if len(joined) != len(words):  # white space beyond ASCII inside of words
            joined = [self.normalizer.normalize_str(w) for w in words]
        units, counts = [], []
        for word in joined:
            found = [word] if word.isalpha() else UNIT.findall(word)
            units += [u.encode() for u in found]
            counts.append(len(found))
        totals = np.concatenate(([0], np.cumsum(self.automaton.counts(units))))
        ends = np.cumsum(counts)
        sums = totals[ends] - totals[ends - counts]
        self.known.update(zip(words, sums.tolist(), strict=True))
        self.chars += sum(map(len, words))

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        if self.chars > CACHED_CHARS:
            self.known, self.chars = {}, 0
        split = [WORD.findall(t) for t in texts]
        every = [w for words in split for w in words]
        if new := [w for w in dict.fromkeys(every) if w not in self.known]:
            self._learn(new)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        tokens = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        totals, ends = np.concatenate(([0], np.cumsum(tokens))), np.cumsum(sizes)
        return sizes, totals[ends] - totals[ends - sizes]


@lru_cache(maxsize=2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, n_words, n_tokens`` of every row of ``docs``; other columns are left out.

    Words stand between the six ASCII spaces; they are normalised as the vocabulary's tokenizer
    does and cut into units (runs of letters, single digits, runs of other signs, English
    endings after an apostrophe). Of a unit, the longest token is taken again and again from the
    left, where only tokens marked as word ends may reach the unit's end. A null or empty text
    has 0 words and 0 tokens; repeated rows are counted each.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    require(docs, [id_col, text])
    schema = pa.schema([(id_col, to_arrow_type(docs.schema[id_col].dataType)),
                        ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for low, high in _runs(texts):
                words, tokens = counter(path).count(texts[low:high])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low).cast(schema[0].type),
                     pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], schema=schema)

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {id_type}, n_words long, n_tokens long")
