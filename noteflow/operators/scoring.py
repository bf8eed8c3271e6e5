"""The model-score stage: one interface, three kinds of scorer.

Each scorer adds one column ``struct<ok: boolean, data: ..., error: string>``. A NULL input
is not scored at all (that is how gated rows skip a costly model); an empty text fails.
A failure never stops the run: callers put the default of their task in its place.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteflow.functions import constants as K
from noteflow.functions.let import let
from noteflow.staging import cut_lineage

SALTS = 64


def _outcome(ok: Column, data: Column, error: Column) -> Column:
    return F.struct(
        ok.alias("ok"), F.when(ok, data).alias("data"), F.when(~ok, error).alias("error")
    )


@dataclass(frozen=True)
class NativeScorer:
    """A Spark expression; stays inside the JVM. A NULL response is a failure."""

    expr: Callable[[Column], Column]

    def apply(self, df: DataFrame, input_col: str, out: str) -> DataFrame:
        x = F.col(input_col)
        outcome = let(
            F.when(x != "", self.expr(x)),
            lambda data: _outcome(
                data.isNotNull(), data,
                F.when(x == "", "Empty text").when(x.isNotNull(), "scoring failed"),
            ),
        )
        return df.withColumn(out, outcome)


@dataclass(frozen=True)
class ModelScorer:
    """A vectorised Python callable.

    ``load()`` runs once per Python worker task and returns ``score(list[str]) -> list``.
    After a pause, a failing batch is tried again item by item, so that one bad item does not
    take its neighbours along; no item is sent more than ``attempts`` times. Only the input column
    travels to Python, and rows stay in the partitions their source gave them.
    """

    load: Callable[[], Callable[[list[str]], list]]
    schema: str
    attempts: int = K.SCORE_ATTEMPTS
    pause_s: float = K.SCORE_PAUSE_S

    def apply(self, df: DataFrame, input_col: str, out: str) -> DataFrame:
        load, attempts, pause_s = self.load, self.attempts, self.pause_s

        def call(score, texts: list[str]) -> list[tuple]:
            rows: list[tuple] = [(False, None, "")] * len(texts)
            groups = [list(range(len(texts)))]
            for attempt in range(1, attempts + 1):
                failed = []
                for items in groups:
                    try:
                        found = list(score([texts[i] for i in items]))
                        if len(found) != len(items):
                            raise ValueError("the scorer must return one response per item")
                        for i, response in zip(items, found):
                            rows[i] = (True, response, None)
                    except Exception as e:  # noqa: BLE001 - any model failure becomes a default
                        for i in items:
                            rows[i] = (False, None, str(e) or type(e).__name__)
                        failed += items
                if not failed or attempt == attempts:
                    return rows
                time.sleep(pause_s * attempt)
                groups = [[i] for i in failed]
            return rows

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            score = load()
            for texts in batches:
                rows = [(None, None, None)] * len(texts)
                wanted = [i for i, t in enumerate(texts) if t]
                for i, t in enumerate(texts):
                    if t == "":
                        rows[i] = (False, None, "Empty text")
                if wanted:
                    for i, r in zip(wanted, call(score, [texts.iloc[i] for i in wanted])):
                        rows[i] = r
                yield pd.DataFrame(rows, columns=["ok", "data", "error"], dtype=object)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        udf = F.pandas_udf(run, f"struct<ok: boolean, data: {self.schema}, error: string>")
        # Marked so that the optimizer neither repeats nor moves the model call.
        udf = udf.asNondeterministic()
        return df.withColumn(out, udf(F.col(input_col)))


def without_pause(scorer):
    """The same scorer, but it never waits: items are told apart at once, and whoever calls it tries those
    that fail again later."""
    return replace(scorer, pause_s=0.0) if isinstance(scorer, ModelScorer) else scorer


@dataclass(frozen=True)
class TableScorer:
    """A table of precomputed responses ``(key, ok, data)``.

    Of rows with the same key one counts: a good one before a failed one, then the one whose JSON
    text is largest. Rows with a NULL input find nothing; they are spread over all tasks instead of
    meeting in the one of the NULL key.
    """

    table: DataFrame
    key: str = "url"

    def apply(self, df: DataFrame, input_col: str, out: str) -> DataFrame:
        ok = F.coalesce("ok", F.lit(False))
        response = F.struct(ok.alias("ok"), F.col("data").alias("data"))
        best = F.struct(ok, F.to_json(F.struct("data")))
        found = self.table.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(
            F.max_by(response, best).alias("_found")
        ).select(F.col(self.key).alias(input_col), F.lit(0).cast("bigint").alias("_spread"), "_found")
        spread = F.when(F.col(input_col).isNull(), F.xxhash64(F.monotonically_increasing_id()))
        joined = df.withColumn("_spread", F.coalesce(spread, F.lit(0).cast("bigint"))).join(
            found, [input_col, "_spread"], "left")
        error = F.when(F.col("_found").isNotNull(), F.lit("scoring failed")).otherwise(F.lit("no score"))
        good = F.coalesce("_found.ok", F.lit(False))
        outcome = F.when(F.col(input_col).isNotNull(), _outcome(good, F.col("_found.data"), error)).otherwise(
            _outcome(F.lit(None).cast("boolean"), F.col("_found.data"), F.lit(None).cast("string")))
        return joined.withColumn(out, outcome).drop("_found", "_spread")


def score(df: DataFrame, input_col: str, scorer, out: str = "response") -> DataFrame:
    """One call per row."""
    return scorer.apply(df, input_col, out)


def score_once(
    df: DataFrame, input_col: str, scorer, spread_by: Sequence[str], out: str = "response", memory=None
) -> DataFrame:
    """One call per distinct input, joined back to every row that has it.

    ``memory`` holds responses of earlier calls (``streaming.score_memory``): inputs it knows are not
    scored again, and it keeps the good responses of the others.

    One input may be in a third of all rows. Each row gets a salt from ``spread_by``; the
    distinct inputs remember which salts they have, so a rare input is joined through one
    salt and a hot one through up to ``SALTS`` tasks, and nothing is copied needlessly.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)))
    once = salted.groupBy(input_col).agg(F.collect_set("_salt").alias("_salts"))
    if memory is None:
        scored = score(once, input_col, scorer, out)
    else:
        known = memory.known(input_col, out)
        fresh = once if known is None else once.join(known, input_col, "left_anti")
        # Written, so that the model is called once for the memory and the result.
        scored = memory.remember(cut_lineage(score(fresh, input_col, scorer, out), "new-scores"), input_col, out)
        if known is not None:
            scored = scored.unionByName(once.join(known, input_col))
    scored = scored.select(input_col, F.explode("_salts").alias("_salt"), out)
    return salted.join(scored, [input_col, "_salt"]).drop("_salt")


# --- default scorers over word lists -----------------------------------------


def _hits(tokens: Column, words: Sequence[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(list(words))))


def _share(hits: Column, tokens: Column, scale: int) -> Column:
    return F.floor(hits * F.lit(10_000.0 * scale) / F.size(tokens)) / F.lit(10_000.0)


def lexicon_language(text: Column) -> Column:
    """The language with most stop words; confidence is 500 times their share, at most 100."""

    def best(tokens: Column) -> Column:
        return F.greatest(
            *[
                F.struct(
                    _hits(tokens, words).alias("hits"), F.lit(-i).alias("rank"),
                    F.lit(code).alias("code"), F.size(tokens).alias("n"),
                )
                for i, (code, words) in enumerate(sorted(K.STOP_WORDS.items()))
            ]
        )

    def entry(b: Column) -> Column:
        share = F.floor(b["hits"] * F.lit(5_000_000.0) / b["n"]) / F.lit(10_000.0)
        return F.struct(F.least(F.lit(100.0), share).alias("confidence"), b["code"].alias("language"))

    return F.array(let(let(F.split(text, " "), best), entry))


def lexicon_toxicity(text: Column) -> Column:
    def scores(s: Column) -> Column:
        values = {"insult": s / F.lit(2.0), "toxicity": s}
        return F.create_map(
            *[c for k in K.TOXICITY_LABELS for c in (F.lit(k), values.get(k, F.lit(0.0)))]
        )

    return let(F.least(F.lit(1.0), _hits(F.split(text, " "), K.TOXIC_WORDS) / F.lit(5.0)), scores)


def lexicon_sentiment(text: Column) -> Column:
    def found(tokens: Column) -> Column:
        return F.struct(
            _share(_hits(tokens, K.NEGATIVE_WORDS), tokens, 1).alias("negative"),
            _share(_hits(tokens, K.POSITIVE_WORDS), tokens, 1).alias("positive"),
        )

    def scores(s: Column) -> Column:
        return F.struct(
            s["negative"].alias("negative"),
            (F.lit(1.0) - s["negative"] - s["positive"]).alias("neutral"),
            s["positive"].alias("positive"),
        )

    return let(let(F.split(text, " "), found), scores)


def lexicon_topic(text: Column) -> Column:
    def found(tokens: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(label).alias("label"), _share(_hits(tokens, words), tokens, 1).alias("score")
                )
                for label, words in K.TOPIC_WORDS.items()
            ]
        )

    return F.filter(let(F.split(text, " "), found), lambda t: t["score"] > 0)


DEFAULT_SCORERS = {
    "language": NativeScorer(lexicon_language),
    "toxicity": NativeScorer(lexicon_toxicity),
    "sentiment": NativeScorer(lexicon_sentiment),
    "topic": NativeScorer(lexicon_topic),
}
