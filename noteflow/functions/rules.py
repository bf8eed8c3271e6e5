"""Decision rules over classifier responses. NaN never passes a threshold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteflow.functions import constants as K


def at_least(x: Column, threshold: float) -> Column:
    return F.coalesce((x >= threshold) & ~F.isnan(x), F.lit(False))


def responsible(probable: Column, warned: Column, tagged: Column) -> Column:
    return ~probable | warned | tagged


def nsfw_url_flags(neutral: Column, warned: Column, tagged: Column) -> Column:
    p = F.lit(1.0) - neutral
    probable = at_least(p, K.NSFW_PROBABLE)
    return F.struct(
        probable.alias("probably_nsfw"),
        at_least(p, K.NSFW_HIGH).alias("high_probably_nsfw"),
        responsible(probable, warned, tagged).alias("responsible_nsfw"),
    )


def nsfw_note_flag(records: Column, threshold: float = K.NSFW_PROBABLE) -> Column:
    """True if any scored URL reaches the threshold; failed URLs are not in the list."""
    return F.coalesce(
        F.exists(records, lambda r: at_least(F.lit(1.0) - r["data"]["neutral"], threshold)),
        F.lit(False),
    )


def default_languages() -> Column:
    return F.array(
        F.struct(F.lit(0.0).alias("confidence"), F.lit("en").alias("language"))
    )


def english_gate(languages: Column) -> Column:
    return F.coalesce(
        F.exists(
            languages,
            lambda l: (l["language"] == "en") & at_least(l["confidence"], K.ENGLISH_CONFIDENCE),
        ),
        F.lit(False),
    )


def default_toxicity() -> Column:
    return F.create_map(*[F.lit(v) for k in K.TOXICITY_LABELS for v in (k, 0.0)])


def toxicity_flag(scores: Column, threshold: float = K.TOXIC_SCORE) -> Column:
    return F.coalesce(
        F.exists(F.map_values(scores), lambda v: at_least(v, threshold)), F.lit(False)
    )


def toxicity_max(scores: Column) -> Column:
    return F.array_max(F.map_values(scores))


def toxicity_sum(scores: Column) -> Column:
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, v: a + v)
    return F.when(total >= 1, F.lit(K.TOXIC_SUM_CAP)).otherwise(total)


def default_sentiment() -> Column:
    zero = F.lit(0.0)
    return F.struct(zero.alias("negative"), zero.alias("neutral"), zero.alias("positive"))


def default_topics() -> Column:
    return F.array().cast("array<struct<label: string, score: double>>")


def spell_out_ampersand(topics: Column) -> Column:
    """The first ``&`` of each label is written as ``and``."""
    return F.transform(
        topics,
        lambda t: F.struct(
            F.regexp_replace(t["label"], r"(?s)\A([^&]*)&", "$1and").alias("label"),
            t["score"].alias("score"),
        ),
    )
