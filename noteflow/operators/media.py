"""Adult-content scoring of the media URLs of a note."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflow.functions import rules, tags
from noteflow.functions.urls import extract_urls, media_urls
from noteflow.operators.scoring import score_once
from noteflow.staging import cut_lineage

ROW_KEY = ("id", "arrival_ts", "relay")


def media_occurrences(notes: DataFrame, patterns: Sequence[str] = ()) -> DataFrame:
    """One narrow row per media URL of a note; the text itself goes no further."""
    warned = tags.has_content_warning(F.col("tags"))
    tagged = tags.has_nsfw_hashtag(tags.extract_hashtags(F.col("tags")))
    urls = notes.select(
        *ROW_KEY, F.col("pubkey").alias("author"), "created_at",
        tags.is_activitypub_user(F.col("tags")).alias("is_activitypub_user"),
        warned.alias("has_content_warning"), tagged.alias("has_nsfw_hashtag"),
        extract_urls(F.col("content")).alias("urls"),
    )
    # The outer form keeps the optimizer from extracting the URLs twice, once for a filter.
    pairs = urls.select(
        *[c for c in urls.columns if c != "urls"],
        F.posexplode_outer(media_urls(F.col("urls"), patterns)).alias("pos", "url"),
    )
    return pairs.filter(F.col("pos").isNotNull())


def nsfw_url_records(notes: DataFrame, scorer, patterns: Sequence[str] = (), memory=None) -> DataFrame:
    """Per note with media URLs: its records in URL order, without the URLs that failed.

    ``notes`` are unique by id, arrival and relay. Each distinct URL is scored once. The narrow
    occurrences are written, so that the texts are read and searched once.
    """
    return occurrence_records(cut_lineage(media_occurrences(notes, patterns), "occurrences"), scorer, memory)


def occurrence_records(occurrences: DataFrame, scorer, memory=None) -> DataFrame:
    """The same from the written rows of ``media_occurrences``."""
    scored = score_once(occurrences, "url", scorer, ["id", "arrival_ts"], memory=memory)
    flags = rules.nsfw_url_flags(
        F.col("response.data.neutral"), F.col("has_content_warning"), F.col("has_nsfw_hashtag")
    )
    record = F.struct(
        "id", "author", "is_activitypub_user", "has_content_warning", "has_nsfw_hashtag",
        "flags.probably_nsfw", "flags.high_probably_nsfw", "flags.responsible_nsfw",
        F.col("response.data").alias("data"), "url",
    )
    items = scored.withColumn("flags", flags).withColumn("record", record)
    # A map inside the response cannot be sorted, so the position leads the sort alone.
    positions = F.collect_list(F.when(F.col("response.ok"), F.struct("pos", "record")))
    by_note = items.groupBy(
        *ROW_KEY, "author", "created_at", "has_content_warning", "has_nsfw_hashtag"
    ).agg(positions.alias("found"))
    in_order = F.array_sort(
        "found", lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)
    )
    probable = rules.nsfw_note_flag(F.col("records"))
    return (
        by_note.withColumn("records", F.transform(in_order, lambda r: r["record"]))
        .drop("found")
        .withColumn("probably_nsfw", probable)
        .withColumn(
            "responsible_nsfw",
            rules.responsible(
                F.col("probably_nsfw"), F.col("has_content_warning"), F.col("has_nsfw_hashtag")
            ),
        )
    )
