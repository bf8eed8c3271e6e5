"""Whole rows stay where they are; files that one task reads are bounded."""

import glob
import os

from pyspark.sql import functions as F

from noteflow.functions import text
from noteflow.operators import dedup, ingest
from noteflow.plans import catalog
from noteflow.streaming.dedup_state import FixedTtl
from tests.test_ingest_dedup import events


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some(spark):
    return events(spark, [(f"n{i % 7}", 60_000 * i, f"r{i % 3}", ["good", "bad", "forged"][i % 3]) for i in range(90)])


def test_outcome_goes_to_the_rows_as_bits(spark, monkeypatch):
    """The plan shuffles no whole rows, and the shuffle used beyond the bound gives the same ones."""
    good, bad = dedup.ingress_fold(some(spark))
    assert "hashpartitioning(row_no" not in plan(good) + plan(bad)
    got = [sorted(map(repr, df.collect())) for df in (good, bad)]
    monkeypatch.setattr(dedup, "WORDS", 0)
    shuffled = dedup.ingress_fold(some(spark))
    assert "hashpartitioning(row_no" in plan(shuffled[0])
    assert [sorted(map(repr, df.collect())) for df in shuffled] == got and got[0] and got[1]


def test_words_and_bits_tell_all_numbers_apart(spark):
    numbers = [0, 1, 63, 64, (1 << 33) - 1, 1 << 33, (1 << 62) + 5, -1, -64]
    word, bit = dedup.word_and_bit(F.col("n"))
    found = spark.createDataFrame([(n,) for n in numbers], "n bigint").select(word, bit).collect()
    assert len(set(found)) == len(numbers) and all(b != 0 for _, b in found)


def test_json_files_are_compressed_and_not_one(spark, tmp_path):
    rows = some(spark).repartition(3)
    catalog._write_json(rows, str(tmp_path / "in"))
    files = glob.glob(str(tmp_path / "in" / "part-*"))
    assert len(files) == 3 and all(f.endswith(".json.gz") for f in files)


def test_a_part_of_the_rows_is_one_micro_batch_of_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "_write_json", lambda rows, folder: write(rows.repartition(3), folder))
    write, out = _WRITE, str(tmp_path / "out")
    rows = some(spark)
    catalog._in_files(spark, rows, F.pmod(F.xxhash64("id"), F.lit(2)), 2, str(tmp_path / "state"), out)
    assert sorted(os.listdir(f"{out}/ingress")) == ["batch_id=0", "batch_id=1"]
    good, bad = dedup.ingress_fold(rows)
    assert spark.read.parquet(f"{out}/ingress").count() == good.count() + bad.count()


_WRITE = catalog._write_json


def test_verdicts_are_worked_out_once(spark):
    good, bad = ingest.integrity_split(some(spark))
    assert "sha2" not in plan(good) + plan(bad)
    assert good.count() == 30 and bad.count() == 30


def test_first_arrivals_of_a_millisecond():
    row = lambda ts, relay, forged: (ts, relay, 0, forged, True, "")
    rows = [row(1, "a", True), row(1, "b", False), row(1, "c", False), row(1, "d", True), row(2, "a", False)]
    assert FixedTtl._firsts(rows) == [rows[0], rows[1], rows[3], rows[4]]


def test_slur_guards_and_ascii_path(apply):
    assert apply(text.normalize_slurs, ["xN!GGers bigger", "fags suggest", "CUNT."]) == [
        "niggers  bigger", "faggot suggest", "cunt "]
    mixed = ["a`b, 1c  d\n", "A\tB`", "é`b, 1c", " `, "]
    assert apply(text._break_fold_strip, mixed) == apply(text._break_fold_strip_any, mixed)
