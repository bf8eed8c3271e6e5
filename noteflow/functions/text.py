"""The text-cleaning steps, each one native column expression, and their composition."""

from __future__ import annotations

import operator
import re
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteflow.functions import constants as K
from noteflow.functions.let import let
from noteflow.functions.urls import extract_urls


def strip_mentions(text: Column) -> Column:
    # The look-ahead only turns most positions away early; a mention starts with n or @.
    return F.regexp_replace(text, "(?=[nN@])" + K.MENTION, " ")


def strip_urls(text: Column, urls: Column) -> Column:
    """Blank out each URL literally, in list order: a prefix of a later URL leaves its rest."""
    return F.aggregate(urls, text, lambda acc, u: F.replace(acc, u, F.lit(" ")))


def strip_ordinals(text: Column) -> Column:
    return F.regexp_replace(text, K.ORDINAL_LINEAR, "")


def squeeze_repeats(text: Column) -> Column:
    """Three or more equal letters, in any case, become the first two of the run."""
    return F.regexp_replace(text, r"([a-zA-Z])(?i:(\1)\1+)", "$1$2")


def split_camel_hashtags(text: Column) -> Column:
    """Space out ``#CamelCase``. ``\\G`` carries on inside one hashtag, whatever its length.

    The last look-ahead stops at the next pair of a capital and a small letter, which lies before
    the next boundary: all of them together read the hashtag once.
    """
    boundary = r"((?:#|(?!\A)\G)[a-zA-Z]*?[a-z])(?=[A-Z])(?=[a-zA-Z]*?[A-Z][a-z])"
    return F.regexp_replace(text, boundary, "$1 ")


def normalize_slurs(text: Column) -> Column:
    for (pattern, canonical), parts in zip(K.SLURS_LINEAR, K.SLUR_PARTS, strict=True):
        # A pattern that tries every word is worth running on few texts only.
        text = _when(text, lambda t, p=parts: _mentions_any(t, *p),
                     lambda t, p=pattern, c=canonical: F.regexp_replace(t, p, c))
    return text


def replace_zap(text: Column) -> Column:
    return F.regexp_replace(text, K.ZAP, "tip")


def strip_hex(text: Column) -> Column:
    return F.regexp_replace(text, K.HEX_RUN, " ")


def strip_punct(text: Column) -> Column:
    return F.regexp_replace(text, K.PUNCT, " ")


def tokenize_join(text: Column) -> Column:
    """Split at breaks, drop empty pieces, join by one space: a break is never a piece."""
    return F.trim(F.regexp_replace(text, K.TOKEN_BREAK, " "))


@lru_cache(maxsize=None)
def _fold_table() -> tuple[str, str, str]:
    """(letters, their bases, marks): canonical decomposition without the marks U+0300..U+036F."""
    letters, bases = [], []
    for cp in [*range(0xC0, 0x0300), *range(0x0370, 0x2000)]:
        nfd = unicodedata.normalize("NFD", chr(cp))
        base = "".join(c for c in nfd if not 0x0300 <= ord(c) <= 0x036F)
        if len(base) == 1 and base != chr(cp):
            letters.append(chr(cp))
            bases.append(base)
    marks = "".join(chr(cp) for cp in range(0x0300, 0x0370))
    return "".join(letters), "".join(bases), marks


def normalize_text(text: Column) -> Column:
    """Fold accents away and lower-case. ASCII text skips the table."""
    letters, bases, marks = _fold_table()
    folded = _when(
        text, lambda t: t.rlike(r"[^\x00-\x7F]"), lambda t: F.translate(t, letters + marks, bases)
    )
    return F.lower(folded)


def strip_punct_full(text: Column) -> Column:
    return F.regexp_replace(text, K.PUNCT_FULL, "")


def expand_greetings(text: Column, compat: bool = True) -> Column:
    """``compat`` eats the blank beside the word and also fires inside words."""
    for word, phrase in K.GREETINGS:
        if compat:
            pattern = f"[{K.SPACE}]{word}|{word}[{K.SPACE}]"
        else:
            pattern = rf"\b{word}\b"
        text = F.regexp_replace(text, pattern, phrase)
    return text


def collapse_ws(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, f"[{K.SPACE}]+", " ")))


def strip_emoji(text: Column) -> Column:
    # The look-ahead turns plain letters away before the long list of ranges is tried.
    near = r"(?=[#*0-9\x{A9}\x{AE}\x{203C}-\x{3299}\x{E000}-\x{F8FF}\x{1F004}-\x{1FAF8}])"
    return F.regexp_replace(text, near + K.EMOJI, "")


def truncate_text(text: Column, n: int) -> Column:
    """A text of more than ``n`` code points keeps ``n - 1``; ``n <= 0`` switches it off."""
    if n <= 0:
        return text
    return F.when(F.char_length(text) > n, F.substring(text, 1, n - 1)).otherwise(text)


def is_empty_text(content: Column, urls: Column) -> Column:
    return ~content.rlike(f"[^{K.SPACE}]") & (F.size(urls) == 0)


def _when(text: Column, guard, step) -> Column:
    """Run ``step`` only on texts the cheap ``guard`` lets through; others pass as they are."""
    return let(text, lambda t: F.when(guard(t), step(t)).otherwise(t))


def _single_blanks(text: Column) -> Column:
    return _when(text, lambda t: t.contains("  "), lambda t: F.regexp_replace(t, " {2,}", " "))


def _mentions_any(text: Column, *parts: str) -> Column:
    def found(low: Column) -> Column:
        return reduce(operator.or_, [low.contains(p) for p in parts])

    return let(F.lower(text), found)


@lru_cache(maxsize=None)
def _clean_table() -> tuple[str, str]:
    """One table for the steps from ``strip_punct`` to ``strip_punct_full``.

    Breaks become blanks and letters their bases. What is only to go after the blanks have
    been collapsed becomes ``#``: every real ``#`` is a break, so none other is left.
    """
    letters, bases, marks = _fold_table()
    stripped = re.compile(K.PUNCT_FULL)
    table = {c: "#" if stripped.match(b) else b for c, b in zip(letters, bases)}
    table.update(dict.fromkeys(marks + "“”’`", "#"))
    table.update(dict.fromkeys(K.BREAKS, " "))
    return "".join(table), "".join(table.values())


def _break_fold_strip(text: Column) -> Column:
    """``strip_punct``, ``tokenize_join``, ``normalize_text`` and ``strip_punct_full``."""
    return let(text, lambda t: F.when(_is_ascii(t), _break_strip_ascii(t)).otherwise(_break_fold_strip_any(t)))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _break_strip_ascii(text: Column) -> Column:
    """ASCII has no accents to fold: its breaks are one small class."""
    breaks = "".join(rf"\x{ord(c):02X}" for c in K.BREAKS if c < "\x80")
    x = F.trim(F.regexp_replace(text, f"[{breaks}]+", " "))
    return F.lower(F.replace(x, F.lit("`"), F.lit("")))


def _break_fold_strip_any(text: Column) -> Column:
    source, target = _clean_table()
    x = _single_blanks(F.translate(text, source, target))
    return F.lower(
        _when(F.trim(x), lambda t: t.contains("#"), lambda t: F.replace(t, F.lit("#"), F.lit("")))
    )


def _greet(text: Column, compat: bool) -> Column:
    """``expand_greetings`` where plain blanks are the only white space."""
    for word, phrase in K.GREETINGS:
        if compat:
            near = lambda t, w=word: t.contains(" " + w) | t.contains(w + " ")
            step = lambda t, w=word, p=phrase: F.regexp_replace(t, f" {w}|{w} ", p)
        else:
            near = lambda t, w=word: t.contains(w)
            step = lambda t, w=word, p=phrase: F.regexp_replace(t, rf"\b{w}\b", p)
        text = _when(text, near, step)
    return text


def preprocess_text(text: Column, urls: Column | None = None, compat: bool = True) -> Column:
    """All cleaning steps in order.

    Equal to chaining the single steps (the tests hold the two side by side). Steps that are
    seldom needed are guarded by a plain byte search, and neighbouring steps over the same
    characters share one pass.
    """
    if urls is None:
        urls = extract_urls(text)
    # Every mention has a 1 after its prefix.
    x = strip_urls(_when(text, lambda t: t.contains("1"), strip_mentions), urls)
    x = squeeze_repeats(strip_ordinals(x))
    x = _when(x, lambda t: t.contains("#"), split_camel_hashtags)
    x = _when(x, lambda t: _mentions_any(t, "gg", "fag", "cunt"), normalize_slurs)
    x = strip_hex(_when(x, lambda t: _mentions_any(t, "zap"), replace_zap))
    x = _greet(_break_fold_strip(x), compat)
    # Stripped quotes and greetings may leave blanks in a row.
    return F.trim(_single_blanks(x))


def chain_steps(text: Column, compat: bool = True) -> Column:
    """The cleaning steps one after the other, as they are defined."""
    x = strip_urls(strip_mentions(text), extract_urls(text))
    for step in (
        strip_ordinals, squeeze_repeats, split_camel_hashtags, normalize_slurs, replace_zap,
        strip_hex, strip_punct, tokenize_join, normalize_text, strip_punct_full,
    ):
        x = step(x)
    return collapse_ws(expand_greetings(x, compat))


def language_input(clean: Column, limit: int = K.TEXT_LIMIT) -> Column:
    """Input of language detection: cleaned text, emoji out, blanks collapsed, cut."""
    # A cleaned text has no other white space than single blanks.
    plain = _when(clean, lambda t: ~_is_ascii(t) | t.rlike("[#*0-9]"), strip_emoji)
    return truncate_text(F.trim(_single_blanks(plain)), limit)
