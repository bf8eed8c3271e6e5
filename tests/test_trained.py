"""Learned scorers: held-out rows beside the word lists, and odd rows."""

import pytest
from pyspark.sql import functions as F

from noteflow.functions import constants as K
from noteflow.functions import text
from noteflow.operators import classify, trained
from noteflow.operators.scoring import NativeScorer, lexicon_language, lexicon_toxicity, score
from noteflow.schema import FlowOptions
from noteflow.sources import views
from noteflow.staging import cut_lineage

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def rows(spark):
    clean = classify.clean_notes(views.posts(spark, SF), FlowOptions()).filter("NOT is_empty").select(
        "doc_id", text.language_input(F.col("clean")).alias("language_text"),
        text.truncate_text(F.col("clean"), K.TEXT_LIMIT).alias("task_text"))
    known = views.table(spark, SF, "documents").select("doc_id", "lang")
    labels = views.table(spark, SF, "labels").select("doc_id", "toxic")
    return cut_lineage(clean.join(known, "doc_id").join(labels, "doc_id", "left"), "trained-test")


def test_languages_of_held_out_rows(rows):
    model = trained.fit_language(rows.filter("doc_id % 5 <> 0"), "language_text", "lang")

    def share_right(scorer):
        found = score(rows.filter("doc_id % 5 = 0"), "language_text", scorer, "r")
        right = F.get("r.data", F.lit(0))["language"] == F.col("lang")
        return found.agg(F.avg(F.coalesce(right, F.lit(False)).cast("int"))).first()[0]

    assert share_right(trained.language_scorer(model)) >= 0.99
    assert share_right(trained.language_scorer(model)) > share_right(NativeScorer(lexicon_language))


def test_toxicity_of_held_out_rows(rows):
    model = trained.fit_toxicity(rows.filter("doc_id % 5 <> 0"), "task_text", "toxic")
    assert {"moron", "stupid", "worthless"} <= set(model.weights)

    def found_and_false(scorer):
        scored = score(rows.filter("doc_id % 5 = 0 AND toxic IS NOT NULL"), "task_text", scorer, "r")
        told = F.coalesce(F.col("r.data")["toxicity"] >= K.TOXIC_SCORE, F.lit(False)).cast("int")
        shares = {r[0]: r[1] for r in scored.groupBy("toxic").agg(F.avg(told)).collect()}
        return shares[1], shares[0]

    found, false = found_and_false(trained.toxicity_scorer(model))
    by_list, false_by_list = found_and_false(NativeScorer(lexicon_toxicity))
    assert found >= by_list - 0.1 and false < false_by_list / 2
    assert found >= 0.4 and false <= 0.05  # toxic words often stand behind the cut of the text


def test_odd_rows(spark):
    given = [("en", "the cat and the dog"), ("fr", "le chat et çà"), ("fr", None), ("en", ""), (None, "x y z"),
             ("en", "😀 the 😀"), ("en", "ab"), ("fr", "le " * 50_000)]
    rows = spark.createDataFrame(given, "lang string, t string")
    model = trained.fit_language(rows, "t", "lang")
    assert model.labels == ("en", "fr")
    assert model.prior == (trained._thousandths(4 / 7), trained._thousandths(3 / 7))
    scored = score(rows, "t", trained.language_scorer(model), "r").collect()
    got = {r["t"]: r["r"] for r in scored}
    assert got["the cat and the dog"].data[0].language == "en" and got["le chat et çà"].data[0].language == "fr"
    assert got[None].data is None and got[""].ok is False and got["ab"].ok
    none = trained.fit_language(rows.limit(0), "t", "lang")
    assert none.labels == ()
    assert [r["r"].ok for r in score(rows.filter("t = 'ab'"), "t", trained.language_scorer(none), "r").collect()] == [False]


def test_buckets_against_brute_force(spark, apply):
    values = ["", "a", "abc", "ABCabc", "né😀x\n", "İx y"]

    def brute(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        return {sum(f * ord(c) for f, c in zip(trained.TRIGRAM_FACTORS, low[i:i + 3])) % trained.TRIGRAM_BUCKETS
                for i in range(len(low) - 2)}

    assert [set(x) for x in apply(trained.trigram_buckets, values)] == [brute(v) for v in values]


def test_telling_words_of_small_tables(spark):
    given = [(1, f"bad Awful You{i}") for i in range(12)] + [
        (0, f"good word{i} bad" if i == 0 else f"good word{i}") for i in range(80)]
    rows = spark.createDataFrame([*given, (None, "bad"), (0, None)], "toxic int, t string")
    model = trained.fit_toxicity(rows, "t", "toxic")
    assert set(model.weights) == {"awful", "bad"} and min(model.weights.values()) > 0
    scored = score(rows, "t", trained.toxicity_scorer(model), "r").collect()
    assert all(r["r"].data["toxicity"] > 0.5 for r in scored if r["t"] and r["t"].startswith("bad"))
    assert all(r["r"].data["toxicity"] < 0.2 for r in scored if r["t"] and r["t"].startswith("good word1"))
    assert set(trained.fit_toxicity(rows, "t", "toxic", most_words=1).weights) == {"awful"}
    for missing in (rows.limit(0), rows.filter("toxic = 1")):
        assert trained.fit_toxicity(missing, "t", "toxic") is None
    failed = score(rows, "t", trained.toxicity_scorer(None), "r").filter("t = 'bad'").collect()
    assert [r["r"].ok for r in failed] == [False]
