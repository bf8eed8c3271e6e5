"""JSON text as browsers write it: the record id is a hash over these exact bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteflow.functions.let import let

# Short escapes; every other control character becomes \u00xx.
SHORT_ESCAPES = [
    ("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\t", "\\t"),
    ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r"),
]
LONG_ESCAPES = [
    (chr(c), f"\\u{c:04x}") for c in range(0x20) if chr(c) not in "\b\t\n\f\r"
]


def _replace_all(text: Column, pairs) -> Column:
    for raw, escaped in pairs:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def json_string(text: Column) -> Column:
    """``to_json`` escapes in one pass and alike, but for the case of ``\\u00xx``."""

    def member(obj: Column) -> Column:  # {"a":"..."} without the frame, cut by bytes
        return F.substring(obj.cast("binary"), F.lit(6), F.octet_length(obj) - 6).cast("string")

    def escaped(value: Column) -> Column:
        by_hand = _replace_all(_replace_all(text, SHORT_ESCAPES), LONG_ESCAPES)
        return F.when(
            value.contains("\\u00"), F.concat(F.lit('"'), by_hand, F.lit('"'))
        ).otherwise(value)

    value = let(F.to_json(F.named_struct(F.lit("a"), text)), member)
    return F.when(text.isNotNull(), let(value, escaped))


def _shortest(d: Column) -> Column:
    """``1.8e+21``: the least digits that read back as ``d``; 17 always do, 15 mostly."""
    forms = [F.format_string(f"%.{digits - 1}e", d) for digits in (15, 16, 17)]
    short = F.when(forms[0].cast("double") == d, forms[0]).when(forms[1].cast("double") == d, forms[1])
    return F.regexp_replace(short.otherwise(forms[2]), r"\.?0*e", "e")


def json_number(x: Column) -> Column:
    """Decimal text as browsers write it: ``0``, ``50``, ``0.0000018``, ``1.8e-7``; ``null`` if not
    finite. Below 1e21 there is no exponent, and from 1e-6 on."""
    x = x.cast("double")

    def text(d: Column) -> Column:
        size = F.abs(d)
        plain = F.regexp_replace(
            d.cast("string").cast("decimal(38,16)").cast("string"), r"\.?0+\z", ""
        )
        small = F.regexp_replace(
            d.cast("string").cast("decimal(38,34)").cast("string"), r"\.?0+\z", ""
        )
        scientific = F.regexp_replace(_shortest(d), r"e([+-])0+(?=\d)", "e$1")
        return (
            F.when(d.isNull() | F.isnan(d) | (size == float("inf")), "null")
            .when(d == 0, "0")
            .when((d == F.floor(d)) & (size < 1e15), d.cast("bigint").cast("string"))
            .when((size >= 1e-6) & (size < 1), small)
            .when((size >= 1) & (size < 1e15), plain)
            .when((size >= 1e15) & (size < 1e21) & (d == F.rint(d)), _shortest(d).cast("decimal(38,0)").cast("string"))
            .when((size >= 1e15) & (size < 1e21), F.regexp_replace(_shortest(d).cast("decimal(38,8)").cast("string"), r"\.?0+\z", ""))
            .otherwise(scientific)
        )

    return let(x, text)


def json_bool(flag: Column) -> Column:
    return F.when(flag, "true").when(~flag, "false").otherwise("null")


def json_array(items: Column) -> Column:
    """A JSON array from an array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def json_object(**members: Column) -> Column:
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_tags(tags: Column) -> Column:
    return json_array(
        F.transform(
            tags,
            lambda t: json_array(
                F.transform(t, lambda v: F.coalesce(json_string(v), F.lit("null")))
            ),
        )
    )


def canonical_event(pubkey, created_at, kind, tags, content) -> Column:
    """``[0,pubkey,created_at,kind,tags,content]``, the text an event id is the SHA-256 of."""
    return F.concat(
        F.lit("[0,"), json_string(pubkey), F.lit(","), created_at.cast("string"), F.lit(","),
        kind.cast("string"), F.lit(","), json_tags(tags), F.lit(","), json_string(content),
        F.lit("]"),
    )


def event_id(pubkey, created_at, kind, tags, content) -> Column:
    return F.sha2(canonical_event(pubkey, created_at, kind, tags, content), 256)


# The order of members in an event that passes through, and in a record.
EVENT_MEMBERS = ("id", "pubkey", "created_at", "kind", "tags", "content", "sig")
RECORD_MEMBERS = ("id", "pubkey", "kind", "created_at", "tags", "content", "sig")


def event_json(members=EVENT_MEMBERS) -> Column:
    """A whole event as JSON text."""
    writers = {
        "created_at": lambda c: c.cast("string"),
        "kind": lambda c: c.cast("string"),
        "tags": json_tags,
        "sig": lambda c: F.coalesce(json_string(c), F.lit('""')),
    }
    return json_object(**{m: writers.get(m, json_string)(F.col(m)) for m in members})
