"""Classification records, topic messages and audit buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteflow.functions import constants as K
from noteflow.functions import text
from noteflow.functions.jsonio import (
    EVENT_MEMBERS, RECORD_MEMBERS, event_id, event_json, json_array, json_bool, json_number,
    json_object, json_string,
)
from noteflow.schema import FlowOptions

RECORD_COLUMNS = ["id", "pubkey", "created_at", "kind", "tags", "content", "sig", "task"]


# --- payloads ----------------------------------------------------------------


def nsfw_payload(records: Column) -> Column:
    def data(d: Column) -> Column:
        scores = F.transform(
            F.map_entries(d["scores"]),
            lambda e: F.concat(json_string(e["key"]), F.lit(":"), json_number(e["value"])),
        )
        label = F.concat(F.lit('"predictedLabel":'), json_string(d["predictedLabel"]))
        return F.concat(F.lit("{"), F.array_join(F.concat(F.coalesce(scores, F.array().cast("array<string>")), F.array(label)), ","), F.lit("}"))

    return json_array(
        F.transform(
            records,
            lambda r: json_object(
                id=json_string(r["id"]),
                author=json_string(r["author"]),
                is_activitypub_user=json_bool(r["is_activitypub_user"]),
                has_content_warning=json_bool(r["has_content_warning"]),
                has_nsfw_hashtag=json_bool(r["has_nsfw_hashtag"]),
                probably_nsfw=json_bool(r["probably_nsfw"]),
                high_probably_nsfw=json_bool(r["high_probably_nsfw"]),
                responsible_nsfw=json_bool(r["responsible_nsfw"]),
                data=data(r["data"]),
                url=json_string(r["url"]),
            ),
        )
    )


def language_payload(languages: Column) -> Column:
    return json_array(
        F.transform(
            languages,
            lambda l: json_object(
                confidence=json_number(l["confidence"]), language=json_string(l["language"])
            ),
        )
    )


def toxicity_payload(scores: Column) -> Column:
    members = F.transform(
        F.map_entries(scores),
        lambda e: F.concat(json_string(e["key"]), F.lit(":"), json_number(e["value"])),
    )
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def sentiment_payload(s: Column) -> Column:
    return json_object(
        negative=json_number(s["negative"]),
        neutral=json_number(s["neutral"]),
        positive=json_number(s["positive"]),
    )


def topic_payload(topics: Column) -> Column:
    return json_array(
        F.transform(
            topics,
            lambda t: json_object(label=json_string(t["label"]), score=json_number(t["score"])),
        )
    )


# --- records -----------------------------------------------------------------


def build_record(df: DataFrame, task: Column, payload: Column, publisher: str,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """One record per row of ``df`` (which has the note's ``id, author, created_at``)."""
    draft = df.select(
        F.lit(publisher).alias("pubkey"),
        "created_at",
        F.lit(K.RECORD_KIND).alias("kind"),
        F.array(
            F.array(F.lit("d"), task), F.array(F.lit("t"), task),
            F.array(F.lit("e"), F.col("id")), F.array(F.lit("p"), F.col("author")),
        ).alias("tags"),
        payload.alias("content"),
        F.lit("").alias("sig"),
        task.alias("task"),
        *keep,
    )
    new_id = event_id(*[F.col(c) for c in ("pubkey", "created_at", "kind", "tags", "content")])
    return draft.withColumn("id", new_id).select(*RECORD_COLUMNS, *keep)


def nsfw_records(media: DataFrame, publisher: str) -> DataFrame:
    """A record for every note with media, also where no URL could be scored."""
    return build_record(
        media, F.lit(K.TASKS["nsfw"]), nsfw_payload(F.col("records")), publisher,
        ("records", "probably_nsfw", "responsible_nsfw"),
    )


def text_records(classified: DataFrame, publisher: str) -> DataFrame:
    """Records of the text tasks: one pass over the notes, one row out per emitted task.

    Language is emitted for every text that is not empty, toxicity only if flagged,
    sentiment and topic for every English text.
    """
    payloads = {
        "language": lambda: language_payload(F.col("language")),
        "toxicity": lambda: F.when(F.col("is_toxic"), toxicity_payload(F.col("toxicity"))),
        "sentiment": lambda: sentiment_payload(F.col("sentiment")),
        "topic": lambda: topic_payload(F.col("topic")),
    }
    emitted = [
        F.when(
            F.col(task).isNotNull(),
            F.struct(F.lit(K.TASKS[task]).alias("task"), payload().alias("payload")),
        )
        for task, payload in payloads.items()
        if task in classified.columns
    ]
    if not emitted:
        emitted = [F.lit(None).cast("struct<task: string, payload: string>")]
    drafts = classified.select(
        "id", F.col("pubkey").alias("author"), "created_at",
        # The outer form keeps the optimizer from cleaning the text again for a filter.
        F.explode_outer(F.array_compact(F.array(*emitted))).alias("draft"),
    ).filter(F.col("draft.payload").isNotNull())
    return build_record(drafts, F.col("draft.task"), F.col("draft.payload"), publisher)


def emission_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("task").agg(F.count(F.lit(1)).alias("emitted"))


# --- side outputs --------------------------------------------------------------


def event_messages(fresh: DataFrame) -> DataFrame:
    return fresh.select(F.lit(K.EVENTS_TOPIC).alias("topic"), event_json().alias("value"))


def nsfw_messages(records: DataFrame) -> DataFrame:
    topic = F.concat(F.col("task"), F.when(F.col("probably_nsfw"), "/1").otherwise("/0"))
    return records.select(topic.alias("topic"), event_json(RECORD_MEMBERS).alias("value"))


def text_messages(records: DataFrame) -> DataFrame:
    return records.select(F.col("task").alias("topic"), event_json(RECORD_MEMBERS).alias("value"))


def nsfw_audit(media: DataFrame) -> DataFrame:
    """Every note with media in one or more buckets, as its list of records."""
    buckets = F.array(
        F.lit("classification"),
        F.when(
            F.col("probably_nsfw") & ~F.col("responsible_nsfw"), "classification_not_responsible_nsfw"
        ),
        F.when(F.col("probably_nsfw"), "classification_probably_nsfw").otherwise(
            "classification_not_probably_nsfw"
        ),
    )
    return media.select(
        F.explode_outer(F.array_compact(buckets)).alias("bucket"),
        nsfw_payload(F.col("records")).alias("value"),
    )


def toxicity_audit(classified: DataFrame, options: FlowOptions) -> DataFrame:
    final_text = text.truncate_text(F.col("clean"), options.toxicity_limit)
    return classified.filter("is_toxic").select(
        F.lit("classification_probably_hate_speech").alias("bucket"),
        json_object(
            id=json_string(F.col("id")), author=json_string(F.col("pubkey")),
            content=json_string(F.col("content")), finalText=json_string(final_text),
            data=toxicity_payload(F.col("toxicity")),
        ).alias("value"),
    )


def invalid_audit(quarantine: DataFrame) -> DataFrame:
    return quarantine.select(
        F.lit("invalid_events").alias("bucket"),
        event_json((*EVENT_MEMBERS, "relay")).alias("value"),
    )
