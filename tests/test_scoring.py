import pytest
from pyspark.sql import functions as F

from noteflow.functions import constants as K
from noteflow.operators import classify, media
from noteflow.operators.scoring import ModelScorer, NativeScorer, TableScorer, score, score_once
from noteflow.schema import FlowOptions


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")


def test_model_failures_stay_with_their_items(spark):
    def load():
        def run(batch):
            if any("bad" in t for t in batch):
                raise ValueError("no")
            return [len(t) for t in batch]

        return run

    df = score(texts(spark, ["aa", "bad", "", None, "cccc"]), "x", ModelScorer(load, "int", pause_s=0.0))
    got = {r.i: r.response for r in df.collect()}
    assert [got[i].data for i in range(5)] == [2, None, None, None, 4]
    assert [got[i].ok for i in range(5)] == [True, False, False, None, True]
    assert got[1].error == "no" and got[2].error == "Empty text"


def test_model_is_tried_again(spark):
    def load():
        calls = []

        def run(batch):
            calls.append(1)
            if len(calls) == 1:
                raise ValueError("first try")
            return [{"label": t, "score": 0.5} for t in batch]

        return run

    model = ModelScorer(load, "struct<label: string, score: double>", pause_s=0.0)
    got = score(texts(spark, ["a"]).coalesce(1), "x", model).first().response
    assert got.ok and got.data.label == "a"


def test_model_is_called_once_per_row(spark):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def run(batch):
            seen.add(len(batch))
            return [0.9] * len(batch)

        return run

    df = score(texts(spark, ["a", "b", "c"]), "x", ModelScorer(load, "double"))
    kept = df.filter("response.ok").withColumn("y", F.col("response.data") * 2).filter("y > 1")
    assert kept.count() == 3
    assert seen.value == 3


def test_one_call_per_distinct_input_with_a_hot_one(spark):
    rows = [(i, "hot" if i % 3 else f"u{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, url string")
    seen = spark.sparkContext.accumulator(0)

    def load():
        def run(batch):
            seen.add(len(batch))
            return [len(t) for t in batch]

        return run

    got = score_once(df, "url", ModelScorer(load, "int"), ["i"])
    assert got.filter("response.data = length(url)").count() == 3000
    assert seen.value == 1001


def test_table_scorer(spark):
    table = spark.createDataFrame([("a", True, 0.5), ("b", False, 0.1)], "url string, ok boolean, data double")
    got = {r.x: r.response for r in score(texts(spark, ["a", "b", "c"]), "x", TableScorer(table)).collect()}
    assert got["a"].ok and got["a"].data == 0.5
    assert not got["b"].ok and got["b"].data is None
    assert got["c"].error == "no score"


def test_gated_rows_reach_no_model(spark):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def run(batch):
            seen.add(len(batch))
            return [{k: 0.9 for k in K.TOXICITY_LABELS}] * len(batch)

        return run

    notes = texts(spark, ["the and of to", "le les des une", "   "]).select(
        F.col("i").cast("string").alias("id"), F.col("x").alias("content")
    )
    options = FlowOptions(
        language=True, toxicity=True, scorers={"toxicity": ModelScorer(load, "map<string,double>"), "nsfw": None}
    )
    got = {r.id: r for r in classify.classify_text(notes, options).filter("is_toxic OR true").collect()}
    assert seen.value == 1
    assert got["0"].is_english and got["0"].is_toxic
    assert not got["1"].is_english and got["1"].toxicity is None
    assert got["2"].is_empty and got["2"].language is None


def test_defaults_after_failures(spark):
    def load():
        def run(batch):
            raise RuntimeError("down")

        return run

    notes = texts(spark, ["hello there"]).select(F.lit("n").alias("id"), F.col("x").alias("content"))
    broken = ModelScorer(load, "array<struct<confidence: double, language: string>>", pause_s=0.0)
    options = FlowOptions(language=True, sentiment=True, topic=True, scorers={"language": broken})
    row = classify.classify_text(notes, options).first()
    assert [tuple(l) for l in row.language] == [(0.0, "en")] and not row.is_english
    sure = NativeScorer(lambda x: F.array(F.struct(F.lit(99.0).alias("confidence"), F.lit("en").alias("language"))))
    nothing = NativeScorer(lambda x: F.lit(None).cast("struct<negative: double, neutral: double, positive: double>"))
    no_topic = NativeScorer(lambda x: F.lit(None).cast("array<struct<label: string, score: double>>"))
    options = FlowOptions(
        language=True, sentiment=True, topic=True,
        scorers={"language": sure, "sentiment": nothing, "topic": no_topic},
    )
    row = classify.classify_text(notes, options).first()
    assert tuple(row.sentiment) == (0.0, 0.0, 0.0) and row.topic == []


def test_text_is_cleaned_once(spark):
    notes = texts(spark, ["a"]).select(F.lit("n").alias("id"), F.col("x").alias("content"))
    df = classify.classify_text(notes, FlowOptions.all_tasks(scorers={"nsfw": None})).filter("is_english")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("nprofile1") == 1


def test_failed_urls_are_left_out_in_order(spark):
    content = "https://a.co/1.jpg https://a.co/22.jpg https://a.co/333.png https://a.co/page"
    notes = spark.createDataFrame(
        [("n", "p", 1, [["t", "Nsfw"]], content, "r")],
        "id string, pubkey string, created_at bigint, tags array<array<string>>, content string, relay string",
    ).withColumn("arrival_ts", F.lit("2024-01-01").cast("timestamp"))
    neutral = F.when(~F.col("url").contains("22"), F.lit(0.1))
    table = notes.select(F.explode(F.split("content", " ")).alias("url")).select(
        "url", neutral.isNotNull().alias("ok"),
        F.struct(
            neutral.alias("neutral"), F.create_map(F.lit("neutral"), neutral).alias("scores"),
            F.lit("x").alias("predictedLabel"),
        ).alias("data"),
    )
    row = media.nsfw_url_records(notes, TableScorer(table)).first()
    assert [r.url[-6:] for r in row.records] == ["/1.jpg", "33.png"]
    assert row.probably_nsfw and row.responsible_nsfw
    assert all(r.high_probably_nsfw and r.responsible_nsfw for r in row.records)


def test_options():
    with pytest.raises(ValueError):
        FlowOptions(language_limit=-1)
    with pytest.raises(ValueError):
        FlowOptions(nsfw=True)
    assert not any([FlowOptions().nsfw, FlowOptions().language, FlowOptions().topic])


def test_options_from_settings():
    settings = {
        "ENABLE_LANGUAGE_DETECTION": "true", "ENABLE_TOPIC_CLASSIFICATION": "TRUE",
        "LANGUAGE_DETECTOR_TRUNCATE_LENGTH": "500 chars", "TOPIC_CLASSIFICATION_TRUNCATE_LENGTH": "",
        "ALLOW_EVENTS_NOT_OLDER_THAN_MINUTES": "20",
        "IMAGE_URL_PATTERN_0": "host1.tld", "IMAGE_URL_PATTERN_1": "/IMG/i",
    }
    options = FlowOptions.from_settings(settings, note_delay_ms=5)
    assert options.language and not options.topic and not options.nsfw
    assert (options.language_limit, options.topic_limit) == (500, 350)
    assert (options.fresh_minutes, options.note_delay_ms) == (20, 5)
    assert options.media_patterns == ("host1.tld", "/IMG/i")
    for wrong in ("x", "-1"):
        with pytest.raises(ValueError):
            FlowOptions.from_settings({"LANGUAGE_DETECTOR_TRUNCATE_LENGTH": wrong})


def test_no_item_is_sent_more_than_twice(spark):
    sent = spark.sparkContext.accumulator(0)

    def load():
        def run(batch):
            sent.add(len(batch))
            raise ValueError("down")

        return run

    got = score(texts(spark, ["a", "b", "c"]).coalesce(1), "x", ModelScorer(load, "int", pause_s=0.0)).collect()
    assert all(not r.response.ok and r.response.error == "down" for r in got) and sent.value == 6


def test_table_scorer_keeps_the_rows(spark):
    table = spark.createDataFrame([("a", True, 1), ("a", True, 3), ("a", False, 9), ("b", False, 2), (None, True, 5)],
                                  "url string, ok boolean, data int")
    df = texts(spark, ["a", "a", "b", "c", None, None])
    got = {r.i: r.response for r in score(df, "x", TableScorer(table)).collect()}
    assert len(got) == 6 == score(df, "x", TableScorer(table)).count()
    assert [(got[i].ok, got[i].data, got[i].error) for i in range(4)] == [
        (True, 3, None), (True, 3, None), (False, None, "scoring failed"), (False, None, "no score")]
    assert got[4].ok is None is got[5].ok
