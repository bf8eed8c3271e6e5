"""License phrases and notices, found by votes of word pairs along diagonals.

Every pair of neighbouring words of every text is hashed and joined to the places of the same pair
in a small fixed table of templates. A hit at word p of the text and word q of the template votes
for the diagonal p - q, where the template would start. Votes are summed per diagonal as bit sets
of template places, one for every 63 places of a template of any length, so a vote counts once;
neighbouring diagonals of a notice (words put in or left out) are merged, and the spans are
verified by their words and their share of the template.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.llm.common import free_name

# Phrases of which every place counts, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices that may differ in a few words, and their labels.
NOTICES = {
    "all rights reserved": "all-rights-reserved",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under cc by nc": "cc-by-nc",
    "this work is licensed under the gnu general public license version": "gpl-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the"
    " gnu general public license as published by the free software foundation": "gpl-notice",
    "gnu lesser general public license": "lgpl",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and"
    " associated documentation files the software to deal in the software without restriction": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted"
    " provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}
#: Share of its word pairs that a notice must show, and how far apart diagonals are merged.
SHARE = 0.8
NEAR = 2
#: In long templates the same word pairs come again and again. Of a template of 50 or more pairs, a
#: diagonal with less than this share of its places is chance, and diagonals are merged farther apart.
LONG_SHARE = 0.02
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Marks the one row that each text sends through the join without a hit.
NO_HIT = -1
BITS = 63


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    exact: bool


TEMPLATES = tuple(
    [Template(tuple(p.split()), label, True) for p, label in PHRASES.items()]
    + [Template(tuple(p.split()), label, False) for p, label in NOTICES.items()])


def scan_words(text: Column) -> Column:
    """Words of letters a-z, digits and all characters beyond ASCII, with A-Z as a-z.

    ``lower`` also changes letters beyond ASCII, which no template has; the one such sign whose
    small letter is ASCII (the Kelvin sign) is put out of the way before.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é")))
    return F.filter(F.split(plain, SEPARATORS, -1), lambda w: w != "")


def _template_pairs(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    rows = [(NO_HIT, NO_HIT, 0, "", "", 0, True, "")]
    for number, t in enumerate(templates):
        if len(t.words) < 2:
            raise ValueError(f"a template has 2 words at least: {t.words}")
        rows += [(number, at, 1 << at % BITS, t.words[at], t.words[at + 1], len(t.words) - 1, t.exact, t.label)
                 for at in range(len(t.words) - 1)]
    frame = spark.createDataFrame(
        rows, "template int, q int, bit long, w1 string, w2 string, pairs int, exact boolean, label string")
    return frame.withColumn("key", F.xxhash64("w1", "w2"))


def license_spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """``id, th, n_words, copies, template, label, exact, first, last, share``.

    One row per span that a template covers: words ``first`` to ``last`` of the text (from 0),
    with the share of the template's word pairs found there; and one row with template -1 for
    every text. ``th`` is a hash of the text; ``copies`` is the number of equal rows. The templates
    are a setting, broadcast with a row per word; they have two words or more, up to whole licenses.
    """
    pairs = _template_pairs(docs.sparkSession, templates)
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"),
                        scan_words(F.col(text)).alias("ws"))
    keys = F.transform("ws", lambda w, p: F.xxhash64(w, F.get("ws", p + 1)))
    none = F.array(F.xxhash64(F.lit(""), F.lit("")))
    # The row without a hit comes first, so places in the text count from -1.
    sent = split.select("id", "th", "ws", F.posexplode(F.concat(none, keys)).alias("p", "k"))
    sent = sent.withColumn("p", F.col("p") - 1)
    same = (F.col("p") == NO_HIT) & (F.col("template") == NO_HIT) | (
        (F.get("ws", F.col("p")) == F.col("w1")) & (F.get("ws", F.col("p") + 1) == F.col("w2")))
    hits = sent.join(F.broadcast(pairs), (F.col("k") == F.col("key")) & same)
    votes = hits.select("id", "th", F.size("ws").cast("long").alias("n_words"), "template", "label", "exact", "pairs",
                        (F.col("p") - F.col("q")).alias("diagonal"), F.floor(F.col("q") / BITS).alias("block"), "bit", "p")
    # Equal rows meet before the shuffle; all that follows is within an id, text and template, so one
    # more shuffle of the few lines serves every window and group.
    span = ["id", "th", "n_words", "template", "label", "exact", "pairs"]
    lines = votes.groupBy(*span, "diagonal", "block").agg(
        F.bit_or("bit").alias("bits"), F.min("p").alias("first"), F.max("p").alias("last"), F.count("*").alias("copies"))
    lines = lines.repartition("id", "th", "template")
    placed = F.sum(F.bit_count("bits")).over(Window.partitionBy("id", "th", "template", "diagonal"))
    lines = lines.withColumn("placed", placed).where(F.col("placed") >= LONG_SHARE * F.col("pairs"))
    own = Window.partitionBy("id", "th", "template").orderBy("diagonal", "block")
    step = F.col("diagonal") - F.lag("diagonal").over(own)
    near = F.greatest(F.lit(NEAR), F.floor(LONG_SHARE * F.col("pairs")))
    far = step.isNull() | (step > near) | (step > 0) & (F.col("exact") | (F.col("pairs") <= NEAR))
    merged = lines.withColumn("new", far.cast("int")).withColumn("span", F.sum("new").over(own))
    places = merged.groupBy(*span, "span", "block").agg(
        F.bit_or("bits").alias("bits"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.max("copies").alias("copies"))
    spans = places.groupBy(*span, "span").agg(
        F.sum(F.bit_count("bits")).alias("found"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.max("copies").alias("copies"))
    share = F.col("found") / F.greatest(F.col("pairs"), F.lit(1))
    good = (F.col("template") == NO_HIT) | F.when(F.col("exact"), share == 1.0).otherwise(
        (share >= SHARE) & (F.col("last") - F.col("first") < 2 * F.col("pairs")))
    return spans.withColumn("share", share).where(good).select(
        "id", "th", "n_words", "copies", "template", "label", "exact",
        F.col("first").cast("long").alias("first"), (F.col("last") + 1).cast("long").alias("last"), "share")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_words, n_base, first_word, last_word, base_labels,
    labels, score``.

    The exact templates are the base: ``n_base`` counts their places, ``first_word`` and
    ``last_word`` are the smallest and largest start (null without any). Labels are distinct,
    sorted and joined by commas, "" without any; ``score`` is the largest share of a template in a
    span that holds, 0 without any. A null or empty text has no words. Repeated rows give repeated
    rows; rows without an id are scanned like others. Other columns do not matter.
    """
    spans = license_spans(docs, templates, id_col, text)
    hit = F.col("template") != NO_HIT
    base = hit & F.col("exact")

    def labels(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    found = spans.groupBy("id", "th", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(hit).alias("labels"),
        F.coalesce(F.max(F.when(hit, F.col("share"))), F.lit(0.0)).alias("score"),
        F.max(F.when(~hit, F.col("copies"))).alias("rows"))
    name = free_name(found, "copy")
    each = found.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
                       "base_labels", "labels", "score")
