"""The index over URL patterns against the plain form, and parsing of broker messages."""

import random

import pytest
from pyspark.sql import functions as F

from noteflow.functions.urls import matches_media_pattern
from noteflow.operators.patterns import matching_urls, required_literal


@pytest.mark.parametrize("regex, literal", [
    (r"example\.net", "example.net"), (r"(?i)^HTTPS:\/\/example\.org", "https://example.org"), (r"a|bcdef", ""),
    (r"abc?defgh", "defgh"), (r"abcd*", "abc"), (r"abcd+ef", "abcd"), (r"(abcd|efgh)ij", "ij"), (r"abc{2}de", "ab"),
    (r"ab[^\]x]cdef", "cdef"), (r"\d+abcd\w", "abcd"), (r"x.yz$", "yz"), (r"\Qab.c\E", ""), (r"(?=abcd)x", ""),
    (r"é1234É", "1234"), (r"\x41bcde", ""), (r"abc??de", "ab"), ("", ""),
])
def test_required_literals(regex, literal):
    assert required_literal(regex) == literal


def test_index_equals_the_plain_form(spark):
    rng = random.Random(3)
    hosts = ["img.example.com", "cdn.example.net", "a.b", "EXAMPLE.org", "été.fr"]
    urls = [f"https://{rng.choice(hosts)}/{rng.choice(['p', 'pp', 'x/y'])}{rng.randrange(60)}{rng.choice(['.jpg', '.png', ''])}"
            for _ in range(300)] + ["", "abc", None]
    patterns = [rf"com/p*{n}\.jpg" for n in range(0, 60, 3)] + [
        r"/^https:\/\/example\.ORG/i", r"net/(x|pp)", r"\.png$|y7", r"b/.*5\d", r"été\.fr/p1", "zzzz"]
    df = spark.createDataFrame([(u,) for u in urls + urls[:50]], "url string")
    want = df.where(matches_media_pattern(F.col("url"), patterns)).distinct()
    assert sorted(r.url for r in matching_urls(df, patterns).collect()) == sorted(r.url for r in want.collect())
    assert matching_urls(df.limit(0), patterns).count() == 0
    assert matching_urls(df, ["zzzz"]).count() == 0 and matching_urls(df, []).count() == 0


def test_events_from_broker_rows(spark):
    from noteflow.sources.events import kafka_events

    lines = [
        ('{"id":"a","kind":1,"content":"x","tags":[["t","y"]]}', "relay-a"),
        ('{"id":"b","kind":1,"relay":"own","arrival_ts":"2024-01-02T03:04:05Z"}', "relay-a"),
        ('{"id":"c","kind":7}', "relay-b"), ("not json", "relay-b"), (None, "relay-b"),
    ]
    raw = spark.createDataFrame(lines, "v string, topic string").select(
        F.col("v").cast("binary").alias("value"), "topic", F.lit("2024-05-05 00:00:00").cast("timestamp").alias("timestamp"))
    got = {r.id: r for r in kafka_events(raw).collect()}
    assert sorted(got) == ["a", "b"]
    assert got["a"].relay == "relay-a" and got["a"].arrival_ts.year == 2024 and got["a"].arrival_ts.month == 5
    assert got["b"].relay == "own" and got["b"].arrival_ts.month == 1 and got["a"].tags == [["t", "y"]]
    assert kafka_events(raw, kinds=None).count() == 5
