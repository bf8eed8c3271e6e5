"""Scorers of language and toxicity learned from labelled rows by one aggregation.

Both count, over all labelled rows, in how many texts of each label a feature occurs, and become
weights in a native expression: naive Bayes over the distinct features of a text. What comes back
from the count is bounded whatever the number of rows. Languages differ in most of their
character trigrams, so those are hashed into a fixed number of buckets. Toxicity hangs on few
words among very many, which would drown in shared buckets: words are counted as they are, and
those that tell most are kept. Weights are whole thousandths, so their sums do not depend on any
order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteflow.functions import constants as K
from noteflow.functions.let import let
from noteflow.operators.scoring import NativeScorer

TRIGRAM_BUCKETS = 4096
#: Words that a toxicity model keeps at most, and what a word must show to be kept: rows, and
#: standard deviations between its toxic rows and those expected of a word that tells nothing.
MOST_WORDS = 512
LEAST_ROWS = 6
LEAST_DEVIATION = 6.0
#: Rows that a feature is taken to have been in, shared among the labels by their rows.
SMOOTHING = 2.0
#: How trigrams are hashed, and what parts words.
TRIGRAM_FACTORS = (40503, 257, 1)
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trigram_buckets(text: Column) -> Column:
    """Distinct buckets of the runs of three code points, A-Z as a-z; none for a shorter text."""
    codes = F.transform(F.split(F.translate(text, UPPER, LOWER), ""), lambda c: F.ascii(c).cast("long"))

    def hashed(code: Column) -> Column:
        first, second, third = (F.lit(f).cast("long") for f in TRIGRAM_FACTORS)
        return F.transform(
            F.sequence(F.lit(0), F.size(code) - 3),
            lambda i: F.pmod(
                F.get(code, i) * first + F.get(code, i + 1) * second + F.get(code, i + 2) * third,
                F.lit(TRIGRAM_BUCKETS).cast("long")).cast("int"))

    return F.when(F.char_length(text) < 3, F.array().cast("array<int>")).otherwise(
        F.array_distinct(let(codes, hashed)))


def scored_words(text: Column) -> Column:
    """Distinct words of letters, digits and characters beyond ASCII, A-Z as a-z."""
    parts = F.split(F.translate(text, UPPER, LOWER), SEPARATORS)
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


@dataclass(frozen=True)
class TrigramModel:
    """``weights[label][bucket]`` and ``prior[label]``, in thousandths of the natural logarithm."""

    labels: tuple[str, ...]
    prior: tuple[int, ...]
    weights: tuple[tuple[int, ...], ...]

    def sums(self, text: Column) -> Column:
        """The sum of each label: ``array<struct<total, rank, label>>``, one entry per label."""

        def total(buckets: Column, at: int) -> Column:
            # Folded into one literal array: no expression per weight.
            weights = F.split(F.lit(",".join(map(str, self.weights[at]))), ",").cast("array<int>")
            return F.aggregate(buckets, F.lit(self.prior[at]).cast("long"), lambda s, b: s + F.get(weights, b))

        def entries(buckets: Column) -> Column:
            return F.array(*[
                F.struct(total(buckets, at).alias("total"), F.lit(-at).alias("rank"), F.lit(label).alias("label"))
                for at, label in enumerate(self.labels)])

        return let(trigram_buckets(text), entries)

    def likeliest(self, text: Column) -> Column:
        """``struct<label, p>``: the likeliest label, of equal ones the first, and its probability."""

        def best(all_: Column) -> Column:
            top = F.array_max(all_)
            odds = F.aggregate(all_, F.lit(0.0), lambda s, e: s + F.exp((e["total"] - top["total"]) / F.lit(1000.0)))
            return F.struct(top["label"].alias("label"), (F.lit(1.0) / odds).alias("p"))

        return let(self.sums(text), best)


@dataclass(frozen=True)
class WordModel:
    """Log odds of toxicity: those of any text and what each word adds, in thousandths."""

    prior: int
    weights: dict[str, int]

    def probability(self, text: Column) -> Column:
        def odds(found: Column) -> Column:
            if not self.weights:
                return F.lit(float(self.prior))
            table = F.create_map(*[F.lit(x) for pair in sorted(self.weights.items()) for x in pair])
            # The set is searched by hash; only what it holds is looked up.
            told = F.filter(found, lambda w: w.isin(sorted(self.weights)))
            return F.aggregate(told, F.lit(self.prior).cast("long"), lambda s, w: s + table[w]).cast("double")

        return F.lit(1.0) / (F.lit(1.0) + F.exp(-let(scored_words(text), odds) / F.lit(1000.0)))


def _thousandths(x: float) -> int:
    return math.floor(1000.0 * math.log(x))


def _labelled(rows: DataFrame, text: str, label: str) -> DataFrame:
    return rows.where(F.col(label).isNotNull()).select(
        F.col(label).alias("label"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def fit_language(rows: DataFrame, text: str, label: str) -> TrigramModel:
    """Learn from all rows with a label; rows without a text count as empty.

    Only counts per label and bucket leave the tasks, and only those reach the driver. Without any
    row the model has no label, and whatever it scores is a failure, which becomes the default of
    the task.
    """
    kept = _labelled(rows, text, label).select(
        F.col("label").cast("string").alias("label"),
        # Bucket -1 counts the rows themselves.
        F.explode(F.concat(F.array(F.lit(-1)), trigram_buckets(F.col("text")))).alias("bucket"))
    counts: dict[str, dict[int, int]] = {}
    for r in kept.groupBy("label", "bucket").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["label"], {})[r["bucket"]] = r["n"]
    labels = tuple(sorted(counts))
    total = sum(c[-1] for c in counts.values())
    return TrigramModel(
        labels, tuple(_thousandths(counts[l][-1] / total) for l in labels),
        tuple(tuple(_thousandths((counts[l].get(b, 0) + SMOOTHING * counts[l][-1] / total) / counts[l][-1])
                    for b in range(TRIGRAM_BUCKETS)) for l in labels))


def fit_toxicity(rows: DataFrame, text: str, label: str, most_words: int = MOST_WORDS) -> WordModel | None:
    """Learn from all rows whose label is 1 (toxic) or another number; None if one kind is missing.

    Words are counted where the rows are before they are shuffled. Of words that tell something, the
    ``most_words`` with the largest deviation reach the driver, of equal ones the first by bytes.
    """
    kept = _labelled(rows, text, label).select((F.col("label") == 1).cast("int").alias("toxic"), "text")
    all_rows, toxic_rows = kept.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic_rows < all_rows:
        return None
    share = toxic_rows / all_rows
    counts = kept.select("toxic", F.explode(scored_words(F.col("text"))).alias("word")).groupBy("word").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("t"))
    deviation = F.abs(F.col("t") - F.col("n") * F.lit(share)) / F.sqrt(F.col("n") * F.lit(share * (1.0 - share)))
    telling = counts.withColumn("deviation", deviation).where(
        (F.col("n") >= LEAST_ROWS) & (F.col("deviation") >= LEAST_DEVIATION))
    found = telling.orderBy(F.desc("deviation"), "word").limit(most_words).collect()
    return WordModel(
        _thousandths(toxic_rows / (all_rows - toxic_rows)),
        {r["word"]: _thousandths(((r["t"] + SMOOTHING * share) / toxic_rows)
                                 / ((r["n"] - r["t"] + SMOOTHING * (1.0 - share)) / (all_rows - toxic_rows)))
         for r in found})


def _ten_thousandths(x: Column) -> Column:
    return F.floor(x * F.lit(10_000.0)) / F.lit(10_000.0)


def language_scorer(model: TrigramModel) -> NativeScorer:
    """The likeliest language, its probability in percent as confidence."""

    def expr(text: Column) -> Column:
        if not model.labels:
            return F.lit(None).cast("array<struct<confidence: double, language: string>>")
        return F.array(let(model.likeliest(text), lambda b: F.struct(
            _ten_thousandths(b["p"] * F.lit(100.0)).alias("confidence"), b["label"].alias("language"))))

    return NativeScorer(expr)


def toxicity_scorer(model: WordModel | None) -> NativeScorer:
    """The probability as ``toxicity``; the rows say nothing of the other scores, which are 0."""

    def expr(text: Column) -> Column:
        if model is None:
            return F.lit(None).cast("map<string, double>")
        return let(_ten_thousandths(model.probability(text)), lambda p: F.create_map(*[
            c for k in K.TOXICITY_LABELS for c in (F.lit(k), p if k == "toxicity" else F.lit(0.0))]))

    return NativeScorer(expr)
