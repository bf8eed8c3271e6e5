import hashlib
import json
import math

from pyspark.sql import functions as F

from noteflow.functions import jsonio, rules
from noteflow.operators import records
from noteflow.schema import LANGUAGES, SENTIMENT, TAGS, TOPICS, TOXICITY


def flags(spark, neutral, warned=False, tagged=False):
    got = spark.range(1).select(
        rules.nsfw_url_flags(F.lit(neutral).cast("double"), F.lit(warned), F.lit(tagged))
    ).first()[0]
    return got.probably_nsfw, got.high_probably_nsfw, got.responsible_nsfw


def test_nsfw_flags(spark):
    assert flags(spark, 0.25) == (True, False, False)
    assert flags(spark, 0.26) == (False, False, True)
    assert flags(spark, 0.15) == (True, True, False)
    assert flags(spark, math.nan) == (False, False, True)
    assert flags(spark, None) == (False, False, True)
    assert flags(spark, 0.1, warned=True) == (True, True, True)
    assert flags(spark, 0.1, tagged=True) == (True, True, True)
    assert flags(spark, 0.9998550415039062) == (False, False, True)


def test_english_gate(apply):
    rows = [
        [(50.0, "en")], [(49.9, "en")], [(99.0, "fr"), (50.0, "en")], [(0.0, "en")],
        [(math.nan, "en")], [], None,
    ]
    assert apply(rules.english_gate, rows, LANGUAGES) == [True, False, True, False, False, False, False]


def test_toxicity(apply):
    rows = [{"a": 0.2, "b": 0.0}, {"a": 0.19}, {"a": 0.0}, {"a": math.nan}, {"a": 0.7, "b": 0.6}]
    assert apply(rules.toxicity_flag, rows, TOXICITY) == [True, False, False, False, True]
    assert apply(rules.toxicity_max, rows, TOXICITY)[4] == 0.7
    assert apply(rules.toxicity_sum, rows, TOXICITY)[4] == 0.99999999999
    assert apply(rules.toxicity_sum, rows, TOXICITY)[0] == 0.2


def test_ampersand(apply):
    got = apply(rules.spell_out_ampersand, [[("a & b & c", 0.5), ("x", 0.1)]], TOPICS)[0]
    assert [(t.label, t.score) for t in got] == [("a and b & c", 0.5), ("x", 0.1)]


def test_json_numbers(apply):
    given = [0.0, -0.0, 1.0, 0.5, 1.8745902252703672e-06, 7.46770019759424e-05, 0.9998550415039062,
             1.8e-7, 1e-7, 1e21, 1.5e22, 33.33, 123456.789, math.nan, math.inf, None, -0.25, 100.0]
    assert apply(jsonio.json_number, given, "double") == [
        "0", "0", "1", "0.5", "0.0000018745902252703672", "0.0000746770019759424",
        "0.9998550415039062", "1.8e-7", "1e-7", "1e+21", "1.5e+22", "33.33", "123456.789", "null",
        "null", "null", "-0.25", "100",
    ]


def test_json_strings_and_event_id(spark):
    content = 'a"b\\c\n\r\t\b\f\x01\x1f/é😀 '
    tags = [["t", 'x"y'], [], ["p", content]]
    canonical = json.dumps([0, "ab", 17, 1, tags, content], separators=(",", ":"), ensure_ascii=False)
    df = spark.createDataFrame(
        [("ab", 17, 1, tags, content)], f"pubkey string, created_at bigint, kind int, tags {TAGS}, content string"
    )
    fields = [F.col(c) for c in df.columns]
    text, digest = df.select(jsonio.canonical_event(*fields), jsonio.event_id(*fields)).first()
    assert text == canonical
    assert digest == hashlib.sha256(canonical.encode()).hexdigest()


def test_json_of_fields_inside_arrays(spark):
    rows = F.transform(
        F.array(F.struct(F.lit('x"1').alias("a_long_name"), F.lit(None).cast("string").alias("none"))),
        lambda r: F.concat_ws("|", jsonio.json_string(r["a_long_name"]), jsonio.json_string(r["none"])),
    )
    assert spark.range(1).select(rows).first()[0] == ['"x\\"1"']


def test_payloads(apply):
    assert apply(records.language_payload, [[(0.0, "en")], []], LANGUAGES) == [
        '[{"confidence":0,"language":"en"}]', "[]",
    ]
    assert apply(records.sentiment_payload, [(0.1, 0.0, 1.0)], SENTIMENT) == [
        '{"negative":0.1,"neutral":0,"positive":1}'
    ]
    assert apply(records.topic_payload, [[("a and b", 0.25)], []], TOPICS) == [
        '[{"label":"a and b","score":0.25}]', "[]",
    ]
    assert apply(records.toxicity_payload, [{"insult": 0.2}, {"threat": 0.0}], TOXICITY) == [
        '{"insult":0.2}', '{"threat":0}',
    ]


def test_published_example_of_an_nsfw_record(spark):
    """The one documented output: neutral 0.99985 is safe, and the JSON text is byte for byte."""
    note, author = "58bd02d8", "5fd00492"
    url = "https://image.example/b543.jpg"
    data = {"hentai": 0.0000018745902252703672, "neutral": 0.9998550415039062,
            "pornography": 0.0000746770019759424, "sexy": 0.00006828152254456654}
    scores = F.create_map(*[F.lit(v) for kv in data.items() for v in kv])
    flagged = rules.nsfw_url_flags(F.lit(data["neutral"]), F.lit(False), F.lit(False))
    record = F.struct(
        F.lit(note).alias("id"), F.lit(author).alias("author"),
        *[F.lit(False).alias(n) for n in ("is_activitypub_user", "has_content_warning", "has_nsfw_hashtag")],
        flagged["probably_nsfw"].alias("probably_nsfw"),
        flagged["high_probably_nsfw"].alias("high_probably_nsfw"),
        flagged["responsible_nsfw"].alias("responsible_nsfw"),
        F.struct(
            F.lit(data["neutral"]).alias("neutral"), scores.alias("scores"),
            F.lit("neutral").alias("predictedLabel"),
        ).alias("data"),
        F.lit(url).alias("url"),
    )
    got = spark.range(1).select(records.nsfw_payload(F.array(record))).first()[0]
    assert got == (
        f'[{{"id":"{note}","author":"{author}","is_activitypub_user":false,"has_content_warning":false,'
        '"has_nsfw_hashtag":false,"probably_nsfw":false,"high_probably_nsfw":false,"responsible_nsfw":true,'
        '"data":{"hentai":0.0000018745902252703672,"neutral":0.9998550415039062,'
        '"pornography":0.0000746770019759424,"sexy":0.00006828152254456654,"predictedLabel":"neutral"},'
        f'"url":"{url}"}}]'
    )


def test_numbers_up_to_the_exponent(apply):
    from noteflow.functions.jsonio import json_number

    given = [1e15, 1e18, 2.0**60, 123456789012345680000.0, 1e21, 1.8e21, 1e23, 2e23, 1e300, 1.8e-7, 1e15 + 0.5, -1e18]
    assert apply(json_number, given, "double") == [
        "1000000000000000", "1000000000000000000", "1152921504606847000", "123456789012345680000", "1e+21", "1.8e+21",
        "1e+23", "2e+23", "1e+300", "1.8e-7", "1000000000000000.5", "-1000000000000000000"]


def test_payload_of_empty_scores(spark):
    from pyspark.sql import functions as F

    from noteflow.operators.records import nsfw_payload

    row = spark.sql("""SELECT array(named_struct('id', 'i', 'author', 'a', 'is_activitypub_user', false,
      'has_content_warning', false, 'has_nsfw_hashtag', false, 'probably_nsfw', false, 'high_probably_nsfw', false,
      'responsible_nsfw', false, 'url', 'u', 'data', named_struct('neutral', 0.5D,
      'scores', cast(map() AS map<string,double>), 'predictedLabel', 'x'))) AS r""")
    assert '"data":{"predictedLabel":"x"}' in row.select(nsfw_payload(F.col("r"))).first()[0]
