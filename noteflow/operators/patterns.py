"""Many URL patterns at once, by an index over the literals they require.

A pattern that needs some literal can only match a URL that contains each of its grams. For each
pattern the gram that fewest URLs have leads to its candidates, by a join; only those are matched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflow.functions.urls import matches_media_pattern, parse_media_pattern

#: Characters of a gram.
GRAM = 4
PLAIN_ESCAPES = frozenset(r"\.[]{}()*+?^$|/-#&=~%@:!,;'\"<>_ ")


def required_literal(regex: str) -> str:
    """Small letters that every match of ``regex`` contains in a row (of any case), the longest such run.

    Empty where none is known: alternatives, groups and classes are not looked into, and
    non-ASCII characters, whose case may depend on more than the character, end a run.
    """
    if regex.startswith(("(?i)", "(?m)", "(?im)", "(?mi)")):
        regex = regex[regex.index(")") + 1:]
    if "\\Q" in regex or "(?" in regex:
        return ""
    runs, run, at, depth, quantified = [], [], 0, 0, False

    def end():
        runs.append("".join(run))
        run.clear()

    while at < len(regex):
        c = regex[at]
        at += 1
        if c == "\\" and at < len(regex):
            c, at = regex[at], at + 1
            literal = c in PLAIN_ESCAPES
            if not literal and c in "xucpPk0":
                return ""
        elif c == "[":
            end()
            at += regex[at:at + 1] == "^"
            at += regex[at:at + 1] == "]"
            while at < len(regex) and regex[at] != "]":
                if regex[at] in "[&":
                    return ""
                at += 1 + (regex[at] == "\\")
            at += 1
            continue
        elif c in "()":
            end()
            depth += 1 if c == "(" else -1
            continue
        elif c == "|":
            if depth == 0:
                return ""
            continue
        elif c in "*?{":
            if run and not quantified:
                run.pop()
            end()
            if c == "{":
                at = regex.find("}", at) + 1 or len(regex)
            quantified = True
            continue
        elif c == "+":
            end()
            quantified = True
            continue
        else:
            literal = c not in ".^$"
        quantified = False
        if literal and depth == 0 and c.isascii():
            run.append(c.lower())
        else:
            end()
    end()
    return max(runs, key=len)


def _grams(text):
    """The distinct grams of a text."""
    places = F.sequence(F.lit(1), F.char_length(text) - (GRAM - 1))
    some = F.array_distinct(F.transform(places, lambda at: F.substring(text, at, GRAM)))
    return F.when(F.char_length(text) >= GRAM, some)


def matching_urls(urls: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """The distinct ``url`` of a frame that match one of the patterns, as ``matches_media_pattern`` says.

    Patterns that require no literal of ``GRAM`` characters are tried on every URL; of the others, each URL
    meets those whose rarest gram it has. The same URLs come out whichever way a pattern goes.
    """
    spark = urls.sparkSession
    distinct = urls.select("url").where(F.col("url").isNotNull()).distinct()
    literals = {p: required_literal(parse_media_pattern(p)) for p in dict.fromkeys(patterns)}
    plain = [p for p, literal in literals.items() if len(literal) < GRAM]
    indexed = [(n, parse_media_pattern(p), literal) for n, (p, literal) in enumerate(literals.items()) if len(literal) >= GRAM]
    found = distinct.where(matches_media_pattern(F.col("url"), plain)) if plain else distinct.limit(0)
    if not indexed:
        return found
    rules = spark.createDataFrame(indexed, "rule int, regex string, literal string")
    needed = rules.select("rule", "regex", "literal", F.explode(_grams(F.col("literal"))).alias("gram"))
    held = distinct.select("url", F.explode(_grams(F.lower("url"))).alias("gram"))
    held = held.join(needed.select("gram").distinct(), "gram", "left_semi")
    # A pattern with a gram that no URL has matches none.
    known = needed.join(held.groupBy("gram").agg(F.count("*").alias("urls")), "gram", "left")
    rarest = known.groupBy("rule", "regex", "literal").agg(
        F.min_by("gram", F.coalesce("urls", F.lit(0))).alias("gram"))
    hits = held.join(rarest, "gram").where(F.lower("url").contains(F.col("literal")) & F.expr("url RLIKE regex"))
    return found.union(hits.select("url")).distinct()
