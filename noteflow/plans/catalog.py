"""The registered queries: one per operator, over the driver's tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow import staging
from noteflow.functions import constants as K
from noteflow.functions import rules, tags, text, urls
from noteflow.functions.jsonio import EVENT_MEMBERS, RECORD_MEMBERS, event_json
from noteflow.operators import classify, dedup, ingest, media, patterns, records, trained
from noteflow.operators.scoring import ModelScorer, NativeScorer, TableScorer, score
from noteflow.plans import flow
from noteflow.schema import FlowOptions
from noteflow.staging import new_path
from noteflow.session import state_partitions
from noteflow.sources import events as sources
from noteflow.sources import views
from noteflow.streaming import fold_state
from noteflow.streaming import run as streams
from noteflow.streaming import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MEDIA_PATTERNS = (r"/^HTTPS:\/\/example\.org/gi", r"example\.net")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def millis(name: str = "arrival_ts") -> Column:
    return F.unix_millis(name).alias("arrival_ms")


# --- sources and ingress ------------------------------------------------------


def content_md5() -> Column:
    return F.md5("content").alias("content_md5")


#: No file limit: a micro-batch takes all files that are there.
ALL_FILES = 1_000_000


def _write_json(rows: DataFrame, folder: str) -> None:
    """Compressed JSON lines. Such a file is read by one task, so its rows are bounded."""
    with staging.unsorted_writes(rows.sparkSession):
        rows.write.mode("append").option("maxRecordsPerFile", 100_000).json(
            folder, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", compression="gzip")


def _as_json_files(spark, sf) -> str:
    folder = new_path(spark, "arrivals")
    _write_json(views.notes(spark, sf), folder)
    return folder


@query
def src_events(spark, sf):
    """Events as files of JSON lines, read back by the reader, notes only."""
    read = sources.read_events(spark, _as_json_files(spark, sf))
    return read.select(
        "id", "pubkey", "created_at", F.col("kind").cast("bigint").alias("kind"), "relay", content_md5(),
        F.to_json("tags").alias("tags"), millis(),
    )


@query
def backfill_latest_per_relay(spark, sf):
    newest = ingest.backfill_latest_per_relay(views.notes(spark, sf))
    return newest.select("relay", "id", "created_at", millis())


@query
def multi_relay_union(spark, sf):
    notes = views.notes(spark, sf)
    relays = [f"wss://relay-{i}.example" for i in range(3)]
    parts = {r: notes.filter(F.col("relay") == r).drop("relay") for r in relays}
    return ingest.multi_relay_union(parts).select("id", "relay", content_md5(), millis())


@query
def relay_counts(spark, sf):
    return ingest.relay_counts(views.notes(spark, sf))


@query
def dedup_ttl(spark, sf):
    return dedup.dedup_ttl(views.notes(spark, sf)).select("id", "relay", content_md5(), millis())


@query
def dedup_ttl_by_user(spark, sf):
    """Few users with many events each: the long-chain case."""
    rows = views.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("id"), F.col("event_id").cast("string").alias("relay"),
        F.col("ts").cast("timestamp").alias("arrival_ts"),
    )
    hour = 3600
    return dedup.dedup_ttl(rows, ttl_s=hour).select(F.col("id").alias("user"), millis())


@query
def dedup_ttl_week(spark, sf):
    """A time-to-live far longer than a chunk of time."""
    rows = views.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("id"), F.col("event_id").cast("string").alias("relay"),
        F.col("ts").cast("timestamp").alias("arrival_ts"),
    )
    return dedup.dedup_ttl(rows, ttl_s=7 * 86_400).select(F.col("id").alias("user"), millis())


@query
def signature_quarantine(spark, sf):
    """A verdict on signatures as an input column, in the fold."""
    signed = views.notes(spark, sf).withColumn("sig_ok", F.char_length("content") % 7 != 0)
    good, quarantine = dedup.ingress_fold(signed, sig_ok="sig_ok")
    both = good.withColumn("outcome", F.lit("pass")).unionByName(
        quarantine.withColumn("outcome", F.lit("quarantine"))
    )
    return both.select("outcome", "id", "relay", "sig_ok", millis())


@query
def ingress_fold(spark, sf):
    good, quarantine = dedup.ingress_fold(views.notes(spark, sf))
    both = good.withColumn("outcome", F.lit("pass")).unionByName(
        quarantine.withColumn("outcome", F.lit("quarantine"))
    )
    return both.select("outcome", "id", "relay", content_md5(), millis())


@query
def valid_structure(spark, sf):
    rows = views.notes(spark, sf)
    return rows.select("id", "relay", millis(), ingest.valid_structure().alias("is_valid"))


@query
def integrity_quarantine(spark, sf):
    good, bad = ingest.integrity_split(views.notes(spark, sf))
    both = good.withColumn("quarantined", F.lit(False)).unionByName(
        bad.withColumn("quarantined", F.lit(True))
    )
    return both.select("id", "relay", "quarantined", content_md5(), millis())


@query
def freshness(spark, sf):
    return ingest.freshness(views.notes(spark, sf)).select("id", "relay", "created_at", millis())


@query
def route_by_kind(spark, sf):
    """Kinds as text, some with blanks, signs and trailing letters, some unreadable."""
    as_text = F.expr(
        "CASE created_at % 5 WHEN 0 THEN concat(' ', cast(kind AS string)) "
        "WHEN 1 THEN concat(cast(kind AS string), 'x') WHEN 2 THEN 'x' "
        "ELSE cast(kind AS string) END"
    )
    notes, others = ingest.route_by_kind(views.notes(spark, sf).withColumn("kind", as_text))
    both = notes.withColumn("route", F.lit("note")).unionByName(
        others.withColumn("route", F.lit("other"))
    )
    return both.select("route", "id", "relay", "kind")


@query
def is_empty_text(spark, sf):
    rows = views.notes(spark, sf).withColumn("urls", urls.extract_urls(F.col("content")))
    return rows.select(
        "id", "relay", text.is_empty_text(F.col("content"), F.col("urls")).alias("is_empty")
    )


# --- tags ---------------------------------------------------------------------


def _tag_query(name: str, fn: Callable[[Column], Column]) -> None:
    def run(spark, sf):
        return views.notes(spark, sf).select("id", "relay", fn(F.col("tags")).alias(name))

    QUERIES[name] = run


_tag_query("extract_hashtags", lambda t: F.array_join(tags.extract_hashtags(t), "|"))
_tag_query("is_activitypub_user", tags.is_activitypub_user)
_tag_query("is_root_post", tags.is_root_post)
_tag_query("has_content_warning", tags.has_content_warning)
_tag_query("has_nsfw_hashtag", lambda t: tags.has_nsfw_hashtag(tags.extract_hashtags(t)))


# --- URLs ---------------------------------------------------------------------


def all_urls(spark, sf) -> DataFrame:
    """Every URL of the pages table and every URL inside a post."""
    found = views.posts(spark, sf).select(
        F.explode_outer(urls.extract_urls(F.col("content"))).alias("url")
    )
    pages = views.table(spark, sf, "pages").select("url")
    return found.filter("url IS NOT NULL").union(pages).distinct()


@query
def extract_urls(spark, sf):
    found = views.posts(spark, sf).select("doc_id", urls.extract_urls(F.col("content")).alias("u"))
    return found.select(
        "doc_id", F.array_join("u", " ").alias("urls"), F.size("u").cast("bigint").alias("n_urls")
    )


@query
def url_type(spark, sf):
    return all_urls(spark, sf).select("url", urls.url_type(F.col("url")).alias("url_type"))


@query
def media_url_pattern(spark, sf):
    hit = urls.matches_media_pattern(F.col("url"), MEDIA_PATTERNS)
    return all_urls(spark, sf).select("url", hit.alias("is_match"))


#: Many patterns: pictures with an even number, besides the few above.
MANY_PATTERNS = (*MEDIA_PATTERNS, *(rf"com/p*{n}\.jpg" for n in range(0, 20_000, 2)))


@query
def media_url_pattern_index(spark, sf):
    """Ten thousand patterns, by an index over the literals they require."""
    found = staging.cut_lineage(all_urls(spark, sf), "urls")
    return patterns.matching_urls(found, MANY_PATTERNS)


@query
def media_urls(spark, sf):
    found = urls.media_urls(urls.extract_urls(F.col("content")), MEDIA_PATTERNS)
    return views.posts(spark, sf).select("doc_id", F.array_join(found, " ").alias("media"))


@query
def clean_url(spark, sf):
    """Not a URL of its own (such as ``//host/path``): shown as an empty text."""
    clean = F.coalesce(urls.clean_url_without_params(F.col("url")), F.lit(""))
    return all_urls(spark, sf).select("url", clean.alias("clean"))


@query
def is_image_content_type(spark, sf):
    content_type = F.concat(urls.url_type(F.col("url")), F.lit("/any"))
    return all_urls(spark, sf).select(
        "url", urls.is_image_content_type(content_type).alias("is_image")
    )


# --- text cleaning -------------------------------------------------------------


def _text_query(name: str, fn: Callable[[Column], Column]) -> None:
    def run(spark, sf):
        return views.posts(spark, sf).select("doc_id", fn(F.col("content")).alias("result"))

    QUERIES[name] = run


_text_query("strip_mentions", text.strip_mentions)
_text_query("strip_urls", lambda c: text.strip_urls(c, urls.extract_urls(c)))
_text_query("strip_ordinals", text.strip_ordinals)
_text_query("squeeze_repeats", text.squeeze_repeats)
_text_query("split_camel_hashtags", text.split_camel_hashtags)
_text_query("normalize_slurs", text.normalize_slurs)
_text_query("replace_zap", text.replace_zap)
_text_query("strip_hex", text.strip_hex)
_text_query("strip_punct", text.strip_punct)
_text_query("tokenize_join", text.tokenize_join)
_text_query("normalize_text", text.normalize_text)
_text_query("strip_punct_full", text.strip_punct_full)
_text_query("expand_greetings", text.expand_greetings)
_text_query("collapse_ws", text.collapse_ws)
_text_query("preprocess_text", text.preprocess_text)
_text_query("strip_emoji", text.strip_emoji)
_text_query("truncate_text", lambda c: text.truncate_text(c, K.TEXT_LIMIT))


# --- classification --------------------------------------------------------------


def _counting_model():
    def count_chars(texts: list[str]) -> list[int]:
        if any("@note1" in t for t in texts):
            raise ValueError("the model refuses mentions")
        return [len(t) for t in texts]

    return count_chars


@query
def score_stage(spark, sf):
    """A vectorised Python model that fails on some texts; neighbours keep their scores."""
    model = ModelScorer(_counting_model, "bigint", pause_s=0.0)
    scored = score(views.posts(spark, sf), "content", model)
    return scored.select(
        "doc_id", F.col("response.ok").alias("ok"),
        F.coalesce("response.data", F.lit(-1).cast("bigint")).alias("n_chars"),
        F.coalesce("response.error", F.lit("")).alias("error"),
    )


def _occurrences(spark, sf) -> tuple[DataFrame, TableScorer]:
    """Media URLs of all notes, written once, and the table of their scores."""
    found = staging.cut_lineage(media.media_occurrences(views.notes(spark, sf)), "occurrences")
    return found, TableScorer(views.nsfw_scores(found))


def _staged_notes(spark, sf) -> DataFrame:
    return staging.cut_lineage(views.notes(spark, sf), "notes", compression=staging.TEXTS)


@query
def nsfw_url_records(spark, sf):
    return media.occurrence_records(*_occurrences(spark, sf)).select(
        "id", "relay", records.nsfw_payload(F.col("records")).alias("records")
    )


@query
def nsfw_url_flags(spark, sf):
    occurrences, scorer = _occurrences(spark, sf)
    scored = media.score_once(occurrences, "url", scorer, ["id", "arrival_ts"])
    flags = rules.nsfw_url_flags(
        F.col("response.data.neutral"), F.col("has_content_warning"), F.col("has_nsfw_hashtag")
    )
    return scored.filter("response.ok").withColumn("flags", flags).select(
        "id", "relay", "url", "flags.probably_nsfw", "flags.high_probably_nsfw",
        "flags.responsible_nsfw",
    )


@query
def nsfw_note_flag(spark, sf):
    return media.occurrence_records(*_occurrences(spark, sf)).select(
        "id", "relay", "probably_nsfw", "responsible_nsfw",
        F.size("records").cast("bigint").alias("n_scored"),
    )


def _classified_posts(spark, sf, **tasks) -> DataFrame:
    return classify.classify_text(views.posts(spark, sf), FlowOptions(language=True, **tasks))


@query
def language_input(spark, sf):
    clean = classify.clean_notes(views.posts(spark, sf), FlowOptions())
    return clean.select("doc_id", text.language_input(F.col("clean")).alias("result"))


@query
def language_detect(spark, sf):
    found = _classified_posts(spark, sf).withColumn("best", F.get("language", F.lit(0)))
    return found.select("doc_id", "best.confidence", "best.language")


def _trained_posts(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Cleaned posts, and those that the scorers may learn from: the others are held out."""
    clean = classify.clean_notes(views.posts(spark, sf), FlowOptions()).select(
        "doc_id", "is_empty", text.language_input(F.col("clean")).alias("language_text"),
        text.truncate_text(F.col("clean"), K.TEXT_LIMIT).alias("task_text"))
    clean = staging.cut_lineage(clean, "trained-texts")
    return clean, clean.filter("doc_id % 5 <> 0")


@query
def trained_language(spark, sf):
    """Language by trigram weights learned from the languages of the documents."""
    clean, learn = _trained_posts(spark, sf)
    known = views.table(spark, sf, "documents").select("doc_id", "lang")
    model = trained.fit_language(learn.join(known, "doc_id"), "language_text", "lang")
    found = score(clean.filter("NOT is_empty"), "language_text", trained.language_scorer(model), "_scored")
    best = F.get(F.coalesce(F.col("_scored.data"), rules.default_languages()), F.lit(0))
    return found.select("doc_id", best["confidence"].alias("confidence"), best["language"].alias("language"))


@query
def trained_toxicity(spark, sf):
    """Toxicity by word weights learned from the labels of the documents."""
    clean, learn = _trained_posts(spark, sf)
    known = views.table(spark, sf, "labels").select("doc_id", "toxic")
    model = trained.fit_toxicity(learn.join(known, "doc_id"), "task_text", "toxic")
    found = score(clean.filter("NOT is_empty"), "task_text", trained.toxicity_scorer(model), "_scored")
    scores = F.coalesce(F.col("_scored.data"), rules.default_toxicity())
    return found.select("doc_id", scores["toxicity"].alias("toxicity"), rules.toxicity_flag(scores).alias("is_toxic"))


@query
def english_gate(spark, sf):
    return _classified_posts(spark, sf).select("doc_id", "is_english")


@query
def toxicity_scores(spark, sf):
    found = _classified_posts(spark, sf, toxicity=True)
    scores = [F.col("toxicity")[k].alias(k) for k in K.TOXICITY_LABELS]
    return found.filter("is_english").select("doc_id", *scores)


@query
def toxicity_flag(spark, sf):
    found = _classified_posts(spark, sf, toxicity=True)
    return found.filter("is_english").select("doc_id", "is_toxic")


@query
def toxicity_summary(spark, sf):
    found = _classified_posts(spark, sf, toxicity=True)
    return found.filter("is_english").select(
        "doc_id", rules.toxicity_max(F.col("toxicity")).alias("max_score"),
        rules.toxicity_sum(F.col("toxicity")).alias("sum_score"),
    )


@query
def sentiment(spark, sf):
    found = _classified_posts(spark, sf, sentiment=True)
    return found.filter("is_english").select("doc_id", "sentiment.*")


@query
def topic(spark, sf):
    found = _classified_posts(spark, sf, topic=True)
    return found.filter("is_english").select(
        "doc_id", records.topic_payload(F.col("topic")).alias("topics")
    )


# --- records, sinks and the whole flow -----------------------------------------------


def _all_tasks() -> FlowOptions:
    return FlowOptions.all_tasks(
        scorers={"nsfw": NativeScorer(views.nsfw_response)}, note_delay_ms=0
    )


def _flow(spark, sf) -> flow.FlowResult:
    notes = views.notes(spark, sf)
    return flow.run_flow(notes, _all_tasks())


@query
def classification_records(spark, sf):
    return _flow(spark, sf).records.select(
        "task", "pubkey", "created_at", F.col("kind").cast("bigint").alias("kind"),
        F.to_json("tags").alias("tags"), "content",
    )


@query
def record_id(spark, sf):
    return _flow(spark, sf).records.select("task", "id")


@query
def emission_counts(spark, sf):
    return records.emission_counts(_flow(spark, sf).records)


@query
def topic_messages(spark, sf):
    return _flow(spark, sf).messages.select("topic", "value")


@query
def audit_buckets(spark, sf):
    return _flow(spark, sf).audit.select("bucket", "value")


@query
def task_switches(spark, sf):
    """Records per setting of the switches: what needs a language is not run without it."""
    # No switch changes the ingress: it is run once for all settings.
    fresh, quarantine = flow.run_ingress(views.notes(spark, sf), FlowOptions())
    settings = {
        "none": FlowOptions(),
        "all but language": FlowOptions(toxicity=True, sentiment=True, topic=True),
        "language": FlowOptions(language=True),
        "language, topic": FlowOptions(language=True, topic=True),
        "toxicity, language": FlowOptions(language=True, toxicity=True),
    }
    counts = []
    for name, options in settings.items():
        path = new_path(spark, "switches")
        with staging.scope(spark):  # what a run stages is deleted when its records are counted
            found = records.emission_counts(flow.enrich(fresh, quarantine, options).records)
            found.select(F.lit(name).alias("switches"), "task", "emitted").write.parquet(path)
        counts.append(spark.read.schema("switches string, task string, emitted bigint").parquet(path))
    return reduce(DataFrame.unionByName, counts)


@query
def sink_idempotent(spark, sf):
    """A batch published twice, as after a replay, is there once."""
    out = new_path(spark, "sink")
    found = _flow(spark, sf).records
    for _replay in range(2):
        if not sinks.publish(found, "records", 7, [sinks.file_target(out)]):
            raise RuntimeError("cannot publish")
    return spark.read.parquet(os.path.join(out, "records")).select("task", "id")


@query
def reemit_order(spark, sf):
    """What the sinks hold, numbered in the order it was written."""
    out, order = new_path(spark, "order"), []
    write = sinks.file_target(out)

    def logged(df, output, batch_id):
        write(df, output, batch_id)
        order.append(output)

    sinks.publish_ordered(_flow(spark, sf), 0, [logged], [logged])
    parts = [
        spark.read.parquet(os.path.join(out, output)).agg(
            F.lit(pos).cast("bigint").alias("pos"), F.lit(output).alias("output"),
            F.count(F.lit(1)).alias("rows"),
        )
        for pos, output in enumerate(order)
    ]
    return reduce(DataFrame.union, parts)


@query
def notes_end_to_end(spark, sf):
    """Everything the flow puts out, as one list of (output, key, value)."""
    result = _flow(spark, sf)

    def part(output, df, key, value):
        return df.select(F.lit(output).alias("output"), key.alias("key"), value.alias("value"))

    return (
        part("note", result.notes, F.col("id"), event_json())
        .unionByName(part("other", result.others, F.col("id"), event_json()))
        .unionByName(part("record", result.records, F.col("id"), F.col("content")))
        .unionByName(part("message", result.messages, F.col("topic"), F.col("value")))
        .unionByName(part("quarantine", result.quarantine, F.col("id"), event_json((*EVENT_MEMBERS, "relay"))))
    )


def _as_stream(spark, sf) -> DataFrame:
    return sources.stream_events(spark, _as_json_files(spark, sf), kinds=None, max_files_per_trigger=ALL_FILES)


@query
def relay_counts_stream(spark, sf):
    out, arrivals = new_path(spark, "relay-counts"), _as_stream(spark, sf)
    with state_partitions(spark):
        streams.count_stream(
            arrivals, [sinks.file_target(out)], new_path(spark, "counts"), available_now=True
        ).awaitTermination()
    batches = spark.read.parquet(os.path.join(out, "relay_counts"))
    last = batches.agg(F.max("batch_id")).first()[0]
    return batches.filter(F.col("batch_id") == last).select("relay", "arrivals")


@query
def dedup_ttl_stream(spark, sf):
    """Repeat removal alone, with one time per id as state. The texts stay at rest."""
    out, rows, landing = new_path(spark, "accepted"), new_path(spark, "rows"), _as_json_files(spark, sf)
    arrivals = sources.stream_events(spark, landing, kinds=None, max_files_per_trigger=ALL_FILES)
    streams.stage_stream(arrivals, rows, new_path(spark, "staged"), available_now=True).awaitTermination()
    staging.drop(spark, landing)  # taken: nothing reads these files again
    streams.use_rocksdb(spark)
    with state_partitions(spark):
        streams.repeats_stream(
            spark, rows, ingest.with_arrival(arrivals).schema, new_path(spark, "state"), [sinks.file_target(out)], check=False, available_now=True
        ).awaitTermination()
    staging.drop(spark, rows)
    return spark.read.parquet(os.path.join(out, "accepted")).select("id", "relay", content_md5(), millis())


def _ingress_columns(found: DataFrame, *more: str) -> DataFrame:
    return found.select("outcome", "id", "relay", content_md5(), millis(), *more)


def _in_files(spark, rows: DataFrame, part: Column, parts: int, state: str, out: str, **how) -> None:
    """``ingress_stream`` over JSON files, run each time a part of the rows has come: a micro-batch for each part,
    of as many files as its rows need. A part is held once: what was written on, or taken, is deleted."""
    folder, parted = new_path(spark, "arrivals"), new_path(spark, "notes")
    with staging.unsorted_writes(spark):
        rows.withColumn("_part", part).write.partitionBy("_part").option("compression", staging.TEXTS).parquet(parted)
    for n in range(parts):
        left = spark.read.schema(rows.withColumn("_part", part).schema).parquet(parted)
        _write_json(left.filter(F.col("_part") == n).drop("_part"), folder)
        staging.drop(spark, os.path.join(parted, f"_part={n}"))
        streams.ingress_stream(
            sources.stream_events(spark, folder, kinds=None, max_files_per_trigger=ALL_FILES), state,
            [sinks.file_target(out)], available_now=True, **how,
        ).awaitTermination()
        staging.drop(spark, folder)


def _third(rows: DataFrame) -> Column:
    """0, 1 or 2 by arrival time."""
    first, last = rows.agg(F.unix_millis(F.min("arrival_ts")), F.unix_millis(F.max("arrival_ts"))).first()
    return F.least(F.lit(2), F.floor((F.unix_millis("arrival_ts") - first) * 3 / max(1, last - first)))


@query
def ingress_fold_stream(spark, sf):
    """Repeats and checks over three micro-batches in time order, narrow columns folded against state."""
    out, notes = new_path(spark, "ingress"), views.notes(spark, sf)
    _in_files(spark, notes, _third(notes), 3, new_path(spark, "state"), out)
    return _ingress_columns(spark.read.parquet(os.path.join(out, "ingress")))


@query
def ingress_hand_over(spark, sf):
    """A batch over the first third of the arrivals, a stream from its state over the others."""
    out, state, notes = new_path(spark, "ingress"), new_path(spark, "state"), _staged_notes(spark, sf)
    part = _third(notes)
    store = fold_state.FoldStore(spark, streams.state_folder(state))
    good, bad = fold_state.hand_over(notes.filter(part == 0), store)
    _in_files(spark, notes.filter(part > 0), part - 1, 2, state, out)
    before = good.withColumn("outcome", F.lit("pass")).unionByName(bad.withColumn("outcome", F.lit("quarantine")))
    after = spark.read.parquet(os.path.join(out, "ingress"))
    return _ingress_columns(before).unionByName(_ingress_columns(after))


@query
def ingress_late_arrivals(spark, sf):
    """Arrivals in any order: the changelog of three micro-batches, summed up."""
    out, notes = new_path(spark, "ingress"), views.notes(spark, sf)
    anywhere = F.pmod(F.xxhash64("id", "relay", "arrival_ts"), F.lit(3))
    _in_files(spark, notes, anywhere, 3, new_path(spark, "state"), out, changes=True)
    changes = spark.read.parquet(os.path.join(out, "ingress_changes"))
    # Digests of the texts are moved, not the texts.
    summed = _ingress_columns(changes, "arrival_ts", "op").groupBy("outcome", "id", "relay", "content_md5", "arrival_ts", "arrival_ms").agg(
        F.sum("op").alias("n"))
    return summed.filter("n > 0").select(
        "outcome", "id", "relay", "content_md5", "arrival_ms", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy")
    ).drop("copy")


@query
def notes_stream_end_to_end(spark, sf):
    """The same flow as a stream over JSON files: rows per output."""
    out, arrivals = new_path(spark, "stream"), _as_stream(spark, sf)
    with state_partitions(spark):
        streams.flow_stream(
            arrivals, _all_tasks(), new_path(spark, "state"),
            [sinks.file_target(out)], [sinks.file_target(out)], available_now=True,
        ).awaitTermination()

    def rows(output, key, value, name=None):
        df = spark.read.parquet(os.path.join(out, output))
        return df.select(F.lit(name or output).alias("output"), key.alias("key"), F.md5(value).alias("value_md5"))

    record = F.concat(F.col("id"), event_json(RECORD_MEMBERS))
    return (
        rows("records_gating", F.col("id"), record)
        .unionByName(rows("records_later", F.col("id"), record))
        .unionByName(rows("notes", F.col("id"), event_json((*EVENT_MEMBERS, "relay"))))
        .unionByName(rows("others", F.col("id"), event_json((*EVENT_MEMBERS, "relay"))))
        .unionByName(rows("messages_events", F.col("topic"), F.col("value"), "messages"))
        .unionByName(rows("messages_gating", F.col("topic"), F.col("value"), "messages"))
        .unionByName(rows("messages_later", F.col("topic"), F.col("value"), "messages"))
        .unionByName(rows("audit", F.col("bucket"), F.col("value")))
    )


@query
def flagged_by_language(spark, sf):
    """The short flow: clean, detect, gate, flag, count."""
    found = _classified_posts(spark, sf, toxicity=True)
    best = F.get("language", F.lit(0))["language"]
    flagged = F.coalesce(F.col("is_toxic"), F.lit(False))
    return found.groupBy(best.alias("language"), flagged.alias("flagged")).agg(
        F.count(F.lit(1)).alias("n")
    )
