"""Social notes derived from the driver's tables, for queries and tests.

``posts``: every document, whole, with marks of social text around it. ``notes``: every row
of ``events`` as the arrival of a note; three events in a row are one note from three relays.
The view texts serve Spark and the SQL check alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.functions.jsonio import event_id
from noteflow.schema import NSFW_RESPONSE
from noteflow.staging import even

POSTS = """
SELECT doc_id, CASE doc_id % 8
    WHEN 0 THEN concat(text, ' https://img.example.com/', repeat('p', doc_id % 29),
                       cast(doc_id % 97 AS {S}), '.jpg?w=1')
    WHEN 1 THEN concat('gm friends #WorldSummit ', text)
    WHEN 2 THEN concat(text, ' nostr:npub1qqpz9 sooooo zaps')
    WHEN 3 THEN concat(text, ' 2nd deadbeef00 https://v.example.com/a.mp4',
                       ' https://v.example.com/a.mp4 //cdn.example.org/', repeat('c', doc_id % 31), '.png')
    WHEN 4 THEN concat('Happy morning! zap me https://example.org/page?q=1#top (', text, ')')
    WHEN 5 THEN concat('n1ggah fags, trash idiot 😀❤️ 5️⃣ ', text)
    WHEN 6 THEN concat('don''t “quote” the #artMusic price, gn ', text, ' @note1acdef')
    ELSE text END AS content
FROM {documents}
"""

DRAFTS = """
SELECT e.event_id, {DIV} AS k, {DIV} % (SELECT count(*) FROM {documents}) AS doc_id, e.ts, f.ts AS first_ts, f.user_id AS author,
  concat('wss://relay-', cast(e.event_id % 3 AS {S}), '.example') AS relay
FROM {events} e JOIN {events} f ON f.event_id = e.event_id - e.event_id % 3
"""

NOTES = """
SELECT a.event_id, a.relay, a.ts AS arrival_ts, {SHA} AS pubkey,
  {EPOCH} - (a.k % 20) * 60 AS created_at,
  CASE WHEN a.k % 10 = 9 THEN 7 ELSE 1 END AS kind,
  CASE a.k % 6 WHEN 0 THEN array(array('t', 'NSFW'))
    WHEN 1 THEN array(array('content-warning'))
    WHEN 2 THEN array(array('proxy', 'https://x', 'activitypub'), array('t', 'art'))
    WHEN 3 THEN array(array('e', 'n1'), array('p', 'u1'))
    WHEN 4 THEN array(array('t'))
    ELSE cast(array() AS {TAGS}) END AS tags,
  CASE WHEN a.k % 50 = 13 THEN '  ' ELSE p.content END AS content
FROM {drafts} a JOIN {posts} p ON p.doc_id = a.doc_id
"""

# Some relays deliver damaged copies: a cut author (bad shape) or a changed text (bad hash).
DAMAGED_AUTHOR = "CASE WHEN event_id % 17 = 3 THEN substring(pubkey, 1, 10) ELSE pubkey END"
DAMAGED_CONTENT = "CASE WHEN event_id % 11 = 5 THEN concat(content, '!') ELSE content END"



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = POSTS.replace("{S}", "string")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spark.sql(query, documents=documents)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = spark.sql(
        DRAFTS.replace("{S}", "string").replace("{DIV}", "(e.event_id div 3)"),
        documents=table(spark, sf_dir, "documents"),
        events=table(spark, sf_dir, "events").select("event_id", "ts", "user_id"),
    )
    query = (
        NOTES.replace("{SHA}", "sha2(concat('u', cast(a.author AS string)), 256)")
        .replace("{EPOCH}", "unix_timestamp(a.first_ts)")
        .replace("{TAGS}", "array<array<string>>")
    )
    # Texts are joined and hashed by as many tasks as there are shuffle partitions.
    whole = spark.sql(query, drafts=even(drafts, "doc_id"), posts=even(posts(spark, sf_dir), "doc_id"))
    fields = ("pubkey", "created_at", "kind", "tags", "content")
    return whole.withColumn("id", event_id(*[F.col(c) for c in fields])).select(
        "id",
        F.expr(DAMAGED_AUTHOR).alias("pubkey"),
        "created_at", "kind", "tags",
        F.expr(DAMAGED_CONTENT).alias("content"),
        F.lit("").alias("sig"),
        "relay",
        F.col("arrival_ts").cast("timestamp").alias("arrival_ts"),
    )


def nsfw_response(url: Column) -> Column:
    """What the stand-in model says about a URL; NULL where it fails."""
    size = F.char_length(url)
    neutral = (size * 37 % 101 / F.lit(100.0)).cast("double")
    data = F.struct(
        neutral.alias("neutral"),
        F.create_map(F.lit("neutral"), neutral).alias("scores"),
        F.when(neutral >= 0.5, "neutral").otherwise("sexy").alias("predictedLabel"),
    )
    return F.when(size % 13 != 0, data.cast(NSFW_RESPONSE))


def nsfw_scores(urls: DataFrame) -> DataFrame:
    """The same as a table of precomputed scores, for the distinct ``url`` of a frame."""
    scored = urls.select("url").distinct().withColumn("data", nsfw_response(F.col("url")))
    return scored.select("url", F.col("data").isNotNull().alias("ok"), "data")
