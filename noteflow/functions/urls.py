"""URL extraction and classification."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteflow.functions import constants as K
from noteflow.functions.let import let


def extract_urls(text: Column) -> Column:
    """Distinct URLs in order of first appearance; a text without ``//`` is not scanned."""
    found = F.regexp_extract_all(F.concat(text, F.lit(" ")), F.lit(K.URL_LINEAR), F.lit(0))
    return F.when(text.contains("//"), F.array_distinct(found)).otherwise(
        F.array().cast("array<string>")
    )


def url_type(url: Column) -> Column:
    path = F.substring_index(url, "?", 1)
    suffix = F.lower(F.regexp_extract(path, r"(\.[^.]*)\z", 1))
    return (
        F.when(suffix == "", "unknown")
        .when(suffix.isin(K.IMAGE_SUFFIXES), "image")
        .when(suffix.isin(K.VIDEO_SUFFIXES), "video")
        .otherwise("link")
    )


def parse_media_pattern(pattern: str) -> str:
    """``/body/flags`` or a bare regex -> one Java regex with its flags inline."""
    m = re.fullmatch(r"/(.+)/([gimy]*)", pattern)
    if not m:
        return pattern
    inline = "".join(f for f in "im" if f in m.group(2))
    return f"(?{inline}){m.group(1)}" if inline else m.group(1)


def matches_media_pattern(url: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | url.rlike(parse_media_pattern(p))
    return hit


def media_urls(urls: Column, patterns: Sequence[str] = ()) -> Column:
    return F.filter(
        urls,
        lambda u: matches_media_pattern(u, patterns) | url_type(u).isin("image", "video"),
    )


# scheme, authority, path and fragment of an absolute URL; its query is left out
ABSOLUTE = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*+)://([^/?#]++)([^?#]*+)(?:\?[^#]*+)?(#.*)?\z"


def clean_url_without_params(url: Column) -> Column:
    """The URL without its query; NULL when it is not an absolute URL with a host.

    Scheme and host become small letters, the port of the scheme goes, an empty path becomes
    ``/``. All other characters stay as they are written.
    """
    scheme, authority, path, fragment = (F.regexp_extract(url, ABSOLUTE, n) for n in range(1, 5))

    def clean(a: Column) -> Column:
        user, host, port = (F.regexp_extract(a, r"(?s)^(.*@)?(.*?)(?::(\d*))?\z", n) for n in (1, 2, 3))
        usual = F.when(F.lower(scheme) == "http", "80").when(F.lower(scheme) == "https", "443").otherwise("")
        return F.when(host != "", F.concat(
            F.lower(scheme), F.lit("://"), user, F.lower(host),
            F.when((port == "") | (port == usual), "").otherwise(F.concat(F.lit(":"), port)),
            F.when(path == "", "/").otherwise(path), fragment,
        ))

    return F.when(url.rlike(ABSOLUTE), let(authority, clean))


def is_image_content_type(content_type: Column) -> Column:
    return content_type.contains("image")
