"""Predicates and extractors over the tags of an event (array<array<string>>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(tag: Column, pos: int) -> Column:
    return F.get(tag, F.lit(pos))


def _any(arr: Column, test) -> Column:
    # `exists` is NULL when a comparison met a NULL and nothing was true.
    return F.coalesce(F.exists(arr, test), F.lit(False))


def extract_hashtags(tags: Column) -> Column:
    named_t = F.filter(tags, lambda t: _at(t, 0) == "t")
    return F.transform(named_t, lambda t: F.coalesce(_at(t, 1), F.lit("undefined")))


def is_activitypub_user(tags: Column) -> Column:
    return _any(
        tags,
        lambda t: (F.size(t) == 3) & (_at(t, 0) == "proxy") & (_at(t, 2) == "activitypub"),
    )


def is_root_post(tags: Column) -> Column:
    return ~_any(tags, lambda t: _at(t, 0) == "e")


def has_content_warning(tags: Column) -> Column:
    return _any(tags, lambda t: _at(t, 0) == "content-warning")


def has_nsfw_hashtag(hashtags: Column) -> Column:
    return _any(hashtags, lambda h: F.lower(h) == "nsfw")
