"""The text tasks of a note, kept as columns of one row so that the text is cleaned once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteflow.functions import rules, text
from noteflow.functions.let import add_once
from noteflow.functions.urls import extract_urls
from noteflow.operators.scoring import DEFAULT_SCORERS, score
from noteflow.schema import FlowOptions


def clean_notes(notes: DataFrame, options: FlowOptions, read: bool = True) -> DataFrame:
    """Adds ``clean`` and ``is_empty``. Where no task reads the text, the optimizer may leave it out."""
    with_urls = notes.withColumn("urls", extract_urls(F.col("content")))
    clean = text.preprocess_text(F.col("content"), F.col("urls"), options.compat_greetings)
    is_empty = text.is_empty_text(F.col("content"), F.col("urls"))
    with_empty = with_urls.withColumn("is_empty", is_empty)
    return (add_once(with_empty, "clean", clean) if read else with_empty.withColumn("clean", clean)).drop("urls")


def _response(df: DataFrame, task: str, input_text: Column, default: Column, run_if: Column,
              options: FlowOptions) -> DataFrame:
    """Adds column ``task``: the response, the default after a failure, NULL if not run.

    Where ``df`` has a column ``failed``, it becomes true if a model failed on a text that is not empty.
    """
    scorer = options.scorers.get(task, DEFAULT_SCORERS[task])
    with_input = add_once(df, "_input", F.when(run_if, input_text))
    scored = score(with_input, "_input", scorer, "_scored")
    ran = F.col("_input").isNotNull()
    response = F.when(ran, F.coalesce(F.col("_scored.data"), default))
    if "failed" in df.columns:
        failed = ran & (F.col("_input") != "") & ~F.coalesce(F.col("_scored.ok"), F.lit(False))
        scored = scored.withColumn("failed", F.col("failed") | F.coalesce(failed, F.lit(False)))
    return add_once(scored, task, response).drop("_input", "_scored")


def detect_language(df: DataFrame, options: FlowOptions) -> DataFrame:
    """Adds ``language`` for texts that are not empty."""
    return _response(
        df, "language", text.language_input(F.col("clean"), options.language_limit),
        rules.default_languages(), ~F.col("is_empty"), options,
    )


def score_toxicity(df: DataFrame, options: FlowOptions) -> DataFrame:
    return _response(
        df, "toxicity", text.truncate_text(F.col("clean"), options.toxicity_limit),
        rules.default_toxicity(), F.col("is_english"), options,
    )


def score_sentiment(df: DataFrame, options: FlowOptions) -> DataFrame:
    return _response(
        df, "sentiment", text.truncate_text(F.col("clean"), options.sentiment_limit),
        rules.default_sentiment(), F.col("is_english"), options,
    )


def score_topic(df: DataFrame, options: FlowOptions) -> DataFrame:
    scored = _response(
        df, "topic", text.truncate_text(F.col("clean"), options.topic_limit),
        rules.default_topics(), F.col("is_english"), options,
    )
    return scored.withColumn("topic", rules.spell_out_ampersand(F.col("topic")))


def classify_text(notes: DataFrame, options: FlowOptions) -> DataFrame:
    """All enabled text tasks; English-only tasks never run without language detection."""
    df = clean_notes(notes, options, read=options.language)
    if not options.language:
        return df.withColumn("is_english", F.lit(False))
    df = detect_language(df, options)
    df = df.withColumn("is_english", rules.english_gate(F.col("language")))
    if options.toxicity:
        df = score_toxicity(df, options)
        df = df.withColumn("is_toxic", rules.toxicity_flag(F.col("toxicity")))
    return late_tasks(df, options)


def late_tasks(df: DataFrame, options: FlowOptions) -> DataFrame:
    """Sentiment and topic of the rows with ``clean`` that are ``is_english``."""
    if options.language and options.sentiment:
        df = score_sentiment(df, options)
    if options.language and options.topic:
        df = score_topic(df, options)
    return df
