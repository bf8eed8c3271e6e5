"""Notes written to stop the job: every pattern takes linear time, with the plain one's results."""

import random
import time

from pyspark.sql import functions as F

from noteflow.functions import constants as K
from noteflow.functions import text as T
from noteflow.functions import urls as U

PLAIN_CAMEL = r"((?:#|(?!\A)\G)[a-zA-Z]*?[a-z])(?=[A-Z])(?=[a-zA-Z]*[A-Z][a-z])"
MILLION = 1_000_000
HOSTILE = [
    "http://" + "a." * 100_000 + "com", "http://" + "a." * 100_000 + "c", "//" + "ab." * 100_000,
    "http://" + "aa." * 100_000 + ".x", "x" * (MILLION // 2) + "gg" + "y" * (MILLION // 2), "ngg" * (MILLION // 3),
    "a" * MILLION + " //b", "a" * MILLION + "://b.co", "#" + "aB" * (MILLION // 2), "#" + "a" + "B" * MILLION,
    "#" + "aBBBBB" * (MILLION // 6) + "c", "1" * MILLION, "1" * MILLION + "st", "#a" * (MILLION // 2), "/" * MILLION,
    "://" * (MILLION // 3), "0x" * (MILLION // 2), "nostr:" * (MILLION // 6),
]


def test_hostile_notes_take_linear_time(spark):
    clean = spark.range(1).select(F.lit("warm //up.example.com #upUp gg 1st").alias("t"))
    clean.select(T.preprocess_text(F.col("t")), U.extract_urls(F.col("t"))).collect()
    for note in HOSTILE:
        row = spark.createDataFrame([(note,)], "t string").repartition(1)
        start = time.perf_counter()
        row.select(F.length(T.preprocess_text(F.col("t"))), F.size(U.extract_urls(F.col("t")))).collect()
        assert time.perf_counter() - start < 6, note[:20]


def test_linear_patterns_match_like_the_plain_ones(spark):
    rng = random.Random(11)
    parts = ["//", "http:", "a", "b.", "co", ".", "..", "é", "1", "12", "_", "-", ":80", "/x", "?q", "#", " ", "'", "com", "ab.cd",
             "1.2.3.4", "x:", "n", "i", "gg", "ggers", "gga", "!", "|", "N1gg4", "st", "nd", "aB", "Bc", "B", "#aBc", "z", "K"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(6000)]
    texts += ["see //example.com. Next", "a.b..com //a..com //a.b.c1.x", "//a.com..evil.org", "//ab.c.de1.f", "abc://ab.cd://ef.gh"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    t = F.col("t")
    pairs = {
        "urls": (F.regexp_extract_all(t, F.lit(K.URL), F.lit(0)), F.regexp_extract_all(t, F.lit(K.URL_LINEAR), F.lit(0))),
        "slurs": (F.regexp_replace(t, *K.SLURS[0]), F.regexp_replace(t, *K.SLURS_LINEAR[0])),
        "ordinals": (F.regexp_replace(t, K.ORDINAL, "<$1>"), F.regexp_replace(t, K.ORDINAL_LINEAR, "<$1>")),
        "camel": (F.regexp_replace(t, PLAIN_CAMEL, "$1 "), T.split_camel_hashtags(t)),
    }
    wrong = frame.select("t", *[F.struct(a.alias("plain"), b.alias("linear")).alias(n) for n, (a, b) in pairs.items()])
    for name in pairs:
        assert wrong.where(F.col(f"{name}.plain") != F.col(f"{name}.linear")).select("t", name).head(3) == []


def test_literal_urls(apply):
    given = ["see //example.com. Next", "http://user.example.co.uk:8080/a?b=1), x", "ftp://1.2.3.4/x. y", "//a..com"]
    assert apply(U.extract_urls, given, "string") == [
        ["//example.com"], ["http://user.example.co.uk:8080/a?b=1"], ["ftp://1.2.3.4/x"], []]


def test_clean_url_of_what_the_url_pattern_finds(apply):
    given = ["https://my_host.example.com/x?y=1", "https://bücher.example.de/x?y", "https://Example.com/a|b?x=1#Z",
             "https://e.com/{id}?x", "https://e.com/a%zz?x", "https://e.com?y=a|b#z", "http://u:p@E.com:80", "//e.com/x", "http://", None]
    assert apply(U.clean_url_without_params, given) == [
        "https://my_host.example.com/x", "https://bücher.example.de/x", "https://example.com/a|b#Z", "https://e.com/{id}",
        "https://e.com/a%zz", "https://e.com/#z", "http://u:p@e.com/", None, None, None]
