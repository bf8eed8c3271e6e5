"""Quality rules as a cascade in an order measured on a sample.

Every rule is a native expression over the text. The cascade asks the rules one after the other
and leaves a document at the first that rejects it, so the order decides the cost and never the
verdict. The order comes from a bounded sample: the rule that rejects most per second goes first.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteflow.functions.let import let
from noteflow.llm.common import SPACE_CHARS, free_name, words
from noteflow.staging import cut_lineage

WINDOW = 8
SYMBOLS = "[#*$%&|<>]+"
#: Rows of the sample that orders the rules; the verdicts do not depend on it.
SAMPLE_ROWS = 2000
#: Timed runs of a rule over the sample.
RUNS = 3
#: Seconds that a rule costs at least, for the order: times below this are noise.
LEAST_COST = 1e-3


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps a text column to a condition; it is never null for a text without nulls."""

    name: str
    rejects: Callable[[Column], Column]


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(found: Column) -> Column:
    """Code points of an array of words."""
    return F.char_length(F.array_join(found, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")


def dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(lines_with_words(text), dup_lines)


def repeated(found: Column) -> Column:
    """Words of an array in windows of eight that occur twice or more in it.

    Windows are compared by 64-bit hashes, within a text. Without a repeated hash, which one
    pass shows, nothing more is done; else the hashes are sorted with their places, and the
    places that share a hash with a neighbour are added up without counting a word twice.
    """
    hashes = F.transform(found, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)),
        lambda at: F.xxhash64(F.slice(h, at, F.lit(WINDOW))),
    ))

    def covered(keys: Column) -> Column:
        pairs = F.array_sort(F.transform(keys, lambda k, at: F.struct(k.alias("k"), at.alias("at"))))
        places = let(pairs, lambda p: F.array_sort(F.transform(
            F.filter(p, lambda x, i: x["k"].eqNullSafe(F.get(p, i - 1)["k"])
                     | x["k"].eqNullSafe(F.get(p, i + 1)["k"])),
            lambda x: x["at"],
        )))
        return let(places, lambda at: F.aggregate(
            F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda total, x: total + x,
        ))

    count = let(windows, lambda k: F.when(
        F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k)))
    return F.when(F.size(found) > WINDOW, count).otherwise(F.lit(0)).cast("long")


def n_repeat_words(text: Column) -> Column:
    return let(words(text), repeated)


def upper_share(text: Column) -> Column:
    """Share of A-Z among the letters a-z and A-Z; 0 without letters."""
    upper = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    letters = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Za-z]+", ""))
    return F.when(letters > 0, upper / letters).otherwise(0.0)


def few_words(count: Column) -> Column:
    return count < 20


def too_repetitive(repeats: Column, count: Column) -> Column:
    return 100 * repeats > 30 * count


#: The rules of production. The first two are the base, the others the verdict of the method.
RULES = (
    Rule("few_words", lambda t: few_words(n_words(t))),
    Rule("repetition", lambda t: let(words(t), lambda w: too_repetitive(repeated(w), F.size(w)))),
    Rule("symbols", lambda t: 100 * n_symbols(t) > 30 * n_words(t)),
    Rule("repeated_lines", lambda t: let(
        lines_with_words(t), lambda x: 100 * dup_lines(x) > 45 * F.size(x))),
    Rule("word_length", lambda t: let(
        words(t), lambda w: (word_chars(w) < 2 * F.size(w)) | (word_chars(w) > 15 * F.size(w)))),
    Rule("capitals", lambda t: upper_share(t) > 0.7),
)


def measured_order(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text",
                   sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample, highest first; ties keep their order.

    The sample is a seeded Bernoulli draw of ``sample_rows`` rows on average, taken where the rows
    are and written once. Each rule runs over it three times, after a first run that compiles it,
    and the shortest run counts, less that of a rule which only reads the text: what is left is the
    work of the rule, not the start of a job.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    drawn = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).sample(share, 7)
    sample = cut_lineage(drawn, "rule-sample")

    def run(rejects: Callable[[Column], Column]) -> tuple[int, float]:
        count = sample.agg(F.count_if(rejects(F.col("t"))))
        took = []
        for _ in range(1 + RUNS):
            start = time.perf_counter()
            rejected = count.first()[0]
            took.append(time.perf_counter() - start)
        return rejected, min(took[1:])

    idle = run(lambda t: F.octet_length(t) < 0)[1]
    gains = []
    for at, rule in enumerate(rules):
        rejected, took = run(rule.rejects)
        gains.append((-rejected / max(took - idle, LEAST_COST), at))
    return [rules[at] for _, at in sorted(gains)]


def rejected_by(text: Column, order: Sequence[Rule]) -> Column:
    """Name of the first rule of ``order`` that rejects the text, null if none does.

    A CASE is left at its first true branch: later rules are not evaluated.
    """
    t = F.coalesce(text, F.lit(""))
    cascade = F.when(order[0].rejects(t), order[0].name)
    for rule in order[1:]:
        cascade = cascade.when(rule.rejects(t), rule.name)
    return cascade


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns.

    A null or empty text has no words and is rejected; repeated rows are judged alike; an empty
    table stays empty.
    """
    return docs.where(rejected_by(F.col(text), measured_order(docs, rules, text)).isNull())


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Measures and verdict of every row, beside its other columns without the text.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (long),
    ``base_failed`` and ``kept`` (boolean); a column of ``docs`` that has such a name is replaced.
    The base rules are read from the measures; the cascade asks the others in measured order. A
    null or empty text has no words: all measures are 0, and it is not kept.
    """
    base = {"few_words", "repetition"}
    order = [r for r in measured_order(docs, rules, text) if r.name not in base]
    names = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}
    others = [c for c in docs.columns if c.lower() not in names and c != text]
    t, w = free_name(docs, "text_"), free_name(docs, "words_")
    split = docs.select(*others, F.coalesce(F.col(text), F.lit("")).alias(t))
    split = split.withColumn(w, words(F.col(t)))
    measured = split.select(
        *others, t,
        F.size(w).cast("long").alias("n_words"),
        word_chars(F.col(w)).alias("word_chars"),
        n_symbols(F.col(t)).alias("n_symbols"),
        n_dup_lines(F.col(t)).alias("n_dup_lines"),
        repeated(F.col(w)).alias("n_repeat_words"),
    )
    failed = few_words(F.col("n_words")) | too_repetitive(F.col("n_repeat_words"), F.col("n_words"))
    verdict = rejected_by(F.col(t), order).isNull() if order else F.lit(True)
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", F.when(F.col("base_failed"), False).otherwise(verdict)).drop(t)
