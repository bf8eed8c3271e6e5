"""The same results in SQL, for the driver's side-by-side check."""

from __future__ import annotations

import string

from noteflow.functions import constants as K
from noteflow.functions.jsonio import SHORT_ESCAPES
from noteflow.operators import trained as T
from noteflow.sources import views

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return "(" + ", ".join(q(w) for w in items) + ")"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def js_str(x: str) -> str:
    for raw, escaped in SHORT_ESCAPES:
        raw_sql = q(raw) if raw.isprintable() else f"chr({ord(raw)})"
        x = f"replace({x}, {raw_sql}, {q(escaped)})"
    return f"concat('\"', {x}, '\"')"


def js_num(x: str) -> str:
    return f"regexp_replace(cast({x} AS varchar), '\\.0$', '')"


def js_bool(x: str) -> str:
    return f"CASE WHEN {x} THEN 'true' ELSE 'false' END"


def js_obj(**members: str) -> str:
    parts = ", ',', ".join(f"'\"{k}\":', {v}" for k, v in members.items())
    return f"concat('{{', {parts}, '}}')"


def canonical(pubkey="pubkey", created_at="created_at", kind="kind", tags="tags", content="content"):
    return (
        f"concat('[0,', {js_str(pubkey)}, ',', {created_at}, ',', {kind}, ',', "
        f"cast(to_json({tags}) AS varchar), ',', {js_str(content)}, ']')"
    )


def event_json(relay: bool = False, record: bool = False) -> str:
    members = dict(
        id=js_str("id"), pubkey=js_str("pubkey"), created_at="created_at", kind="kind",
        tags="cast(to_json(tags) AS varchar)", content=js_str("content"), sig="'\"\"'",
    )
    if record:
        names = ("id", "pubkey", "kind", "created_at", "tags", "content", "sig")
        members = {m: members[m] for m in names}
    if relay:
        members["relay"] = js_str("relay")
    return js_obj(**members)


# --- shared relations ------------------------------------------------------------

SPACE = f"[{K.SPACE}]"
POSTS = views.POSTS.replace("{S}", "varchar").replace("{documents}", "documents")
DRAFTS = (
    views.DRAFTS.replace("{S}", "varchar").replace("{DIV}", "(e.event_id // 3)")
    .replace("{events}", "events").replace("{documents}", "documents")
)
WHOLE = (
    views.NOTES.replace("{SHA}", "sha256(concat('u', cast(a.author AS varchar)))")
    .replace("{EPOCH}", "cast(floor(epoch(a.first_ts)) AS bigint)")
    .replace("{TAGS}", "varchar[][]").replace("array(", "list_value(")
    .replace("{drafts}", "drafts").replace("{posts}", "posts")
)
NOTES = f"""SELECT sha256({canonical()}) AS id, {views.DAMAGED_AUTHOR} AS pubkey, created_at, kind,
  tags, {views.DAMAGED_CONTENT} AS content, relay, epoch_us(arrival_ts) // 1000 AS arrival_ms FROM whole"""
CHECKED = f"""SELECT *, regexp_matches(pubkey, '^[a-f0-9]{{64}}$') AS is_valid,
  regexp_matches(pubkey, '^[a-f0-9]{{64}}$') AND id <> sha256({canonical()}) AS forged FROM notes"""
WITH_POSTS = f"WITH RECURSIVE posts AS MATERIALIZED ({POSTS})"
WITH_NOTES = (
    f"{WITH_POSTS}, drafts AS ({DRAFTS}), whole AS ({WHOLE}), notes AS MATERIALIZED ({NOTES})"
)


def fold_ctes(source: str, key: str, ts: str, tie: str, ttl_ms: int, extra: str,
              valid="true", forged="false") -> str:
    """The rule walked arrival by arrival, per key."""
    blocked = f"(f.last IS NOT NULL AND o.ts - f.last <= {ttl_ms})"
    return f"""ordered AS MATERIALIZED (SELECT {key} AS key, {ts} AS ts, {valid} AS ok, {forged} AS bad, {extra},
    row_number() OVER (PARTITION BY {key} ORDER BY {ts}, {tie}) AS rn FROM {source}),
  fold AS (
    SELECT key, rn, CASE WHEN bad THEN 'quarantine' WHEN ok THEN 'pass' ELSE 'drop' END AS outcome,
      CASE WHEN bad THEN NULL ELSE ts END AS last FROM ordered WHERE rn = 1
    UNION ALL
    SELECT o.key, o.rn, CASE WHEN {blocked} THEN 'drop' WHEN o.bad THEN 'quarantine'
        WHEN o.ok THEN 'pass' ELSE 'drop' END,
      CASE WHEN {blocked} OR o.bad THEN f.last ELSE o.ts END
    FROM fold f JOIN ordered o ON o.key = f.key AND o.rn = f.rn + 1),
  judged AS MATERIALIZED (SELECT o.*, f.outcome FROM ordered o JOIN fold f ON f.key = o.key AND f.rn = o.rn)"""


def url_list(x: str) -> str:
    every = f"regexp_extract_all(concat({x}, ' '), {q(K.URL)})"
    return f"list_filter({every}, lambda u, i: list_position({every}, u) = i)"


def strip_urls(x: str, found: str) -> str:
    return f"list_reduce(list_prepend({x}, {found}), lambda a, u: replace(a, u, ' '))"


def squeeze(x: str) -> str:
    for c in string.ascii_lowercase:
        x = sub(x, f"(?i)({c}{c}){c}+", r"\1")
    return x


def split_camel(x: str) -> str:
    spaced = sub("i", "([a-z])([A-Z])", r"\1 \2")
    spans = f"regexp_extract_all({x}, '#[a-zA-Z]*[A-Z][a-z]+')"
    return f"list_reduce(list_prepend({x}, {spans}), lambda a, i: replace(a, i, {spaced}))"


def slurs(x: str) -> str:
    for pattern, canonical_form in K.SLURS:
        x = sub(x, pattern, canonical_form)
    return x


def greetings(x: str) -> str:
    for word, phrase in K.GREETINGS:
        x = sub(x, f"{SPACE}{word}|{word}{SPACE}", phrase)
    return x


def collapse(x: str) -> str:
    return f"lower(trim({sub(x, SPACE + '+', ' ')}))"


def tokenize(x: str) -> str:
    pieces = f"list_filter(regexp_split_to_array({x}, {q(K.TOKEN_BREAK)}), lambda t: t <> '')"
    return f"array_to_string({pieces}, ' ')"


def truncate(x: str, n: int = K.TEXT_LIMIT) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n - 1}) ELSE {x} END"


def url_suffix(u: str) -> str:
    return f"lower(regexp_extract(split_part({u}, '?', 1), '(\\.[^.]*)$', 1))"


def url_type(u: str) -> str:
    s = url_suffix(u)
    return (
        f"CASE WHEN {s} = '' THEN 'unknown' WHEN {s} IN {words(K.IMAGE_SUFFIXES)} THEN 'image' "
        f"WHEN {s} IN {words(K.VIDEO_SUFFIXES)} THEN 'video' ELSE 'link' END"
    )


# strip_accents drops every mark; these two are no accents, so they step aside meanwhile.
OTHER_MARKS, STAND_INS = "\ufe0f\u20e3", "\ue000\ue001"


def fold_accents(x: str) -> str:
    aside = f"translate({x}, {q(OTHER_MARKS)}, {q(STAND_INS)})"
    return f"translate(strip_accents({aside}), {q(STAND_INS)}, {q(OTHER_MARKS)})"


CHAIN = [
    ("strip_mentions", lambda x: sub(x, K.MENTION, " ")),
    ("strip_urls", None),
    ("strip_ordinals", lambda x: sub(x, K.ORDINAL, "")),
    ("squeeze_repeats", squeeze),
    ("split_camel_hashtags", split_camel),
    ("normalize_slurs", slurs),
    ("replace_zap", lambda x: sub(x, K.ZAP, "tip")),
    ("strip_hex", lambda x: sub(x, K.HEX_RUN, " ")),
    ("strip_punct", lambda x: sub(x, K.PUNCT, " ")),
    ("tokenize_join", tokenize),
    ("normalize_text", lambda x: f"lower({fold_accents(x)})"),
    ("strip_punct_full", lambda x: sub(x, K.PUNCT_FULL, "")),
    ("expand_greetings", greetings),
    ("collapse_ws", collapse),
]


def chain_ctes(source: str) -> str:
    """``source`` (with ``content``) through every cleaning step; the last one is ``cleaned``."""
    ctes = [f"c0 AS MATERIALIZED (SELECT *, content AS t, {url_list('content')} AS urls FROM {source})"]
    for i, (_, step) in enumerate(CHAIN, 1):
        body = step("t") if step else strip_urls("t", "urls")
        ctes.append(f"c{i} AS MATERIALIZED (SELECT * REPLACE ({body} AS t) FROM c{i - 1})")
    empty = f"{sub('content', SPACE + '+', '')} = '' AND len(urls) = 0"
    ctes.append(f"cleaned AS (SELECT * EXCLUDE (t, urls), t AS clean, {empty} AS is_empty FROM c{len(CHAIN)})")
    return ", ".join(ctes)


def hits(tokens: str, items) -> str:
    return f"len(list_filter({tokens}, lambda w: w IN {words(items)}))"


def share(h: str, tokens: str, scale: int) -> str:
    return f"floor({h} * cast({10_000 * scale} AS double) / len({tokens})) / cast(10000 AS double)"


def text_ctes(source: str) -> str:
    """Cleaning and all four text tasks with the default scorers."""
    blank = f"trim({sub(sub('clean', K.EMOJI, ''), SPACE + '+', ' ')})"
    langs = sorted(K.STOP_WORDS)
    counts = ", ".join(f"{hits('lt', K.STOP_WORDS[c])} AS h_{c}" for c in langs)
    best = "CASE "
    for i, c in enumerate(langs[:-1]):
        best += "WHEN " + " AND ".join(f"h_{c} >= h_{d}" for d in langs[i + 1:]) + f" THEN '{c}' "
    best += f"ELSE '{langs[-1]}' END"
    top = "greatest(" + ", ".join(f"h_{c}" for c in langs) + ")"
    s = f"least(cast(1 AS double), {hits('tt', K.TOXIC_WORDS)} / cast(5 AS double))"
    topics = ", ".join(
        f"{share(hits('tt', w), 'tt', 1)} AS topic_{i}" for i, w in enumerate(K.TOPIC_WORDS.values())
    )
    one = "cast(1 AS double)"
    return f"""{chain_ctes(source)},
  l0 AS (SELECT *, {truncate(blank)} AS language_text, {truncate('clean')} AS task_text FROM cleaned),
  l1 AS (SELECT *, string_split(language_text, ' ') AS lt, string_split(task_text, ' ') AS tt FROM l0),
  l2 AS (SELECT *, {counts} FROM l1),
  l3 AS (SELECT *, CASE WHEN is_empty THEN NULL WHEN language_text = '' THEN 'en' ELSE {best} END AS language,
    CASE WHEN is_empty THEN NULL WHEN language_text = '' THEN cast(0 AS double)
      ELSE least(cast(100 AS double), {share(top, 'lt', 500)}) END AS confidence FROM l2),
  l4 AS (SELECT *, coalesce(language = 'en' AND confidence >= 50, false) AS is_english FROM l3),
  l5 AS (SELECT *, CASE WHEN task_text = '' THEN cast(0 AS double) ELSE {s} END AS tox,
    CASE WHEN task_text = '' THEN cast(0 AS double) ELSE {share(hits('tt', K.NEGATIVE_WORDS), 'tt', 1)} END AS negative,
    CASE WHEN task_text = '' THEN cast(0 AS double) ELSE {share(hits('tt', K.POSITIVE_WORDS), 'tt', 1)} END AS positive,
    {topics} FROM l4),
  classified AS MATERIALIZED (SELECT *,
    CASE WHEN task_text = '' THEN cast(0 AS double) ELSE {one} - negative - positive END AS neutral,
    tox / cast(2 AS double) AS insult, tox >= 0.2 AS is_toxic FROM l5)"""


TOXICITY_JSON = js_obj(**{
    k: js_num({"insult": "insult", "toxicity": "tox"}.get(k, "cast(0 AS double)")) for k in K.TOXICITY_LABELS
})
LANGUAGE_JSON = f"concat('[', {js_obj(confidence=js_num('confidence'), language=js_str('language'))}, ']')"
SENTIMENT_JSON = js_obj(**{k: js_num(k) for k in ("negative", "neutral", "positive")})
_topics = ", ".join(
    f"CASE WHEN topic_{i} > 0 THEN "
    + js_obj(label=js_str(q(label.replace("&", "and", 1))), score=js_num(f"topic_{i}")) + " END"
    for i, label in enumerate(K.TOPIC_WORDS)
)
TOPIC_JSON = f"concat('[', concat_ws(',', {_topics}), ']')"


# Media URLs and their scores, from the notes in ``source``.
def media_ctes(source: str) -> str:
    warned = "len(list_filter(tags, lambda t: t[1] = 'content-warning')) > 0"
    tagged = "len(list_filter(tags, lambda t: t[1] = 't' AND lower(t[2]) = 'nsfw')) > 0"
    activitypub = "len(list_filter(tags, lambda t: len(t) = 3 AND t[1] = 'proxy' AND t[3] = 'activitypub')) > 0"
    kind = url_type("url")
    data = js_obj(neutral=js_num("neutral"), predictedLabel="CASE WHEN neutral >= 0.5 THEN '\"neutral\"' ELSE '\"sexy\"' END")
    record = js_obj(
        id=js_str("id"), author=js_str("pubkey"), is_activitypub_user=js_bool("ap"),
        has_content_warning=js_bool("cw"), has_nsfw_hashtag=js_bool("tag"),
        probably_nsfw=js_bool("probably_nsfw"), high_probably_nsfw=js_bool("high_probably_nsfw"),
        responsible_nsfw=js_bool("responsible_nsfw"), data=data, url=js_str("url"),
    )
    return f"""m0 AS MATERIALIZED (SELECT id, relay, pubkey, created_at, arrival_ms, {warned} AS cw, {tagged} AS tag,
    {activitypub} AS ap, {url_list('content')} AS urls FROM {source}),
  m1 AS (SELECT * EXCLUDE (urls), unnest(urls) AS url, generate_subscripts(urls, 1) AS pos FROM m0),
  m2 AS (SELECT *, cast((length(url) * 37 % 101) / 100.0 AS double) AS neutral, NOT (length(url) % 13 = 0) AS ok
    FROM m1 WHERE {kind} IN ('image', 'video')),
  m3 AS (SELECT *, cast(1 AS double) - neutral >= 0.75 AS probably_nsfw,
    cast(1 AS double) - neutral >= 0.85 AS high_probably_nsfw FROM m2),
  occurrences AS MATERIALIZED (SELECT *, NOT probably_nsfw OR cw OR tag AS responsible_nsfw FROM m3),
  media AS MATERIALIZED (SELECT id, relay, pubkey, created_at, arrival_ms, cw, tag,
    concat('[', coalesce(string_agg({record}, ',' ORDER BY pos) FILTER (WHERE ok), ''), ']') AS records,
    count(*) FILTER (WHERE ok) AS n_scored,
    coalesce(bool_or(probably_nsfw) FILTER (WHERE ok), false) AS probable
    FROM occurrences GROUP BY ALL)"""


# --- ingress ------------------------------------------------------------------------


def on_notes(name: str, select: str, more: str = "") -> None:
    ORACLE[name] = f"{WITH_NOTES}{', ' + more if more else ''} {select}"


def on_posts(name: str, select: str, more: str = "") -> None:
    ORACLE[name] = f"{WITH_POSTS}{', ' + more if more else ''} {select}"


on_notes("src_events", """SELECT id, pubkey, created_at, cast(kind AS bigint) AS kind, relay,
  md5(content) AS content_md5, cast(to_json(tags) AS varchar) AS tags, arrival_ms FROM notes WHERE kind = 1""")
on_notes("backfill_latest_per_relay", f"""SELECT relay, id, created_at, arrival_ms FROM notes
  QUALIFY row_number() OVER (PARTITION BY relay ORDER BY created_at DESC, id, arrival_ms) <= {K.BACKFILL_PER_RELAY}""")
on_notes("multi_relay_union", "SELECT id, relay, md5(content) AS content_md5, arrival_ms FROM notes")
on_notes("relay_counts", "SELECT relay, count(*) AS arrivals FROM notes GROUP BY relay")
on_notes("relay_counts_stream", "SELECT relay, count(*) AS arrivals FROM notes GROUP BY relay")
TTL_MS = K.DEDUP_TTL_S * 1000
on_notes(
    "dedup_ttl", "SELECT key AS id, relay, md5(content) AS content_md5, ts AS arrival_ms FROM judged WHERE outcome = 'pass'",
    fold_ctes("notes", "id", "arrival_ms", "relay", TTL_MS, "relay, content"),
)
ORACLE["dedup_ttl_stream"] = ORACLE["dedup_ttl"]
ORACLE["dedup_ttl_by_user"] = (
    "WITH RECURSIVE " + fold_ctes("events", "user_id", "epoch_us(ts) // 1000", "event_id", 3_600_000, "event_id")
    + """ SELECT cast(key AS varchar) AS "user", ts AS arrival_ms FROM judged WHERE outcome = 'pass'"""
)
ORACLE["dedup_ttl_week"] = ORACLE["dedup_ttl_by_user"].replace("3600000", "604800000")
INGRESS = (
    f"checked AS MATERIALIZED ({CHECKED}), "
    + fold_ctes(
        "checked", "id", "arrival_ms", "relay", TTL_MS,
        "id, pubkey, created_at, kind, tags, content, relay, arrival_ms", "is_valid", "forged",
    )
)
on_notes("signature_quarantine",
         "SELECT outcome, id, relay, length(content) % 7 <> 0 AS sig_ok, arrival_ms FROM judged WHERE outcome <> 'drop'",
         INGRESS.replace(f"checked AS MATERIALIZED ({CHECKED})", f"""checked AS MATERIALIZED (
           SELECT * REPLACE (is_valid AND (forged OR length(content) % 7 = 0) AS forged) FROM ({CHECKED}))"""))
on_notes("ingress_fold",
         "SELECT outcome, id, relay, md5(content) AS content_md5, arrival_ms FROM judged WHERE outcome <> 'drop'", INGRESS)
on_notes("valid_structure", "SELECT id, relay, arrival_ms, is_valid FROM checked", f"checked AS ({CHECKED})")
on_notes("integrity_quarantine",
         "SELECT id, relay, forged AS quarantined, md5(content) AS content_md5, arrival_ms FROM checked WHERE is_valid",
         f"checked AS ({CHECKED})")
FRESH = f"created_at >= floor((arrival_ms - {K.FRESH_MINUTES * 60_000}) / 1000)"
on_notes("freshness", f"SELECT id, relay, created_at, arrival_ms FROM notes WHERE {FRESH}")
on_notes("route_by_kind", """SELECT CASE WHEN coalesce(try_cast(regexp_extract(kind, '^\\s*([+-]?\\d+)', 1) AS int) = 1, false)
    THEN 'note' ELSE 'other' END AS route, id, relay, kind
  FROM (SELECT * REPLACE (CASE created_at % 5 WHEN 0 THEN concat(' ', cast(kind AS varchar))
    WHEN 1 THEN concat(cast(kind AS varchar), 'x') WHEN 2 THEN 'x' ELSE cast(kind AS varchar) END AS kind) FROM notes)""")
on_notes("is_empty_text", f"""SELECT id, relay, {sub('content', SPACE + '+', '')} = ''
  AND len(regexp_extract_all(concat(content, ' '), {q(K.URL)})) = 0 AS is_empty FROM notes""")

# --- tags -----------------------------------------------------------------------------

HASHTAGS = "list_transform(list_filter(tags, lambda t: t[1] = 't'), lambda t: coalesce(t[2], 'undefined'))"


def any_tag(test: str) -> str:
    return f"len(list_filter(tags, lambda t: {test})) > 0"


for _name, _expr in {
    "extract_hashtags": f"coalesce(array_to_string({HASHTAGS}, '|'), '')",
    "is_activitypub_user": any_tag("len(t) = 3 AND t[1] = 'proxy' AND t[3] = 'activitypub'"),
    "is_root_post": f"NOT ({any_tag(chr(116) + '[1] = ' + q('e'))})",
    "has_content_warning": any_tag("t[1] = 'content-warning'"),
    "has_nsfw_hashtag": f"len(list_filter({HASHTAGS}, lambda h: lower(h) = 'nsfw')) > 0",
}.items():
    on_notes(_name, f"SELECT id, relay, {_expr} AS {_name} FROM notes")

# --- URLs -----------------------------------------------------------------------------

ALL_URLS = f"""urls AS MATERIALIZED (SELECT unnest({url_list('content')}) AS url FROM posts
  UNION SELECT url FROM pages)"""
on_posts("extract_urls", f"""SELECT doc_id, array_to_string(u, ' ') AS urls, len(u) AS n_urls
  FROM (SELECT doc_id, {url_list('content')} AS u FROM posts)""")
on_posts("url_type", f"SELECT url, {url_type('url')} AS url_type FROM urls", ALL_URLS)
PATTERN_HIT = "regexp_matches({u}, '(?i)^HTTPS://example\\.org') OR regexp_matches({u}, 'example\\.net')"
on_posts("media_url_pattern", f"SELECT url, {PATTERN_HIT.format(u='url')} AS is_match FROM urls", ALL_URLS)
on_posts("media_url_pattern_index", f"""SELECT url FROM urls WHERE {PATTERN_HIT.format(u='url')}
    OR TRY_CAST(regexp_extract(url, 'com/p*(0|[1-9][0-9]*)\\.jpg', 1) AS BIGINT) % 2 = 0""", ALL_URLS)
_is_media = f"{PATTERN_HIT.format(u='u')} OR ({url_type('u')}) IN ('image', 'video')"
on_posts("media_urls", f"""SELECT doc_id, array_to_string(list_filter({url_list('content')},
  lambda u: {_is_media}), ' ') AS media FROM posts""")
on_posts("clean_url", r"""SELECT url, CASE WHEN m.scheme <> '' THEN concat(lower(m.scheme), '://', lower(m.host),
    CASE WHEN m.path = '' THEN '/' ELSE m.path END, m.ref) ELSE '' END AS clean
  FROM (SELECT url, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?[^#]*)?(#.*)?$',
    ['scheme', 'host', 'path', 'ref']) AS m FROM urls)""", ALL_URLS)
on_posts("is_image_content_type",
         f"SELECT url, contains(concat({url_type('url')}, '/any'), 'image') AS is_image FROM urls", ALL_URLS)

# --- text cleaning ----------------------------------------------------------------------

for _name, _step in CHAIN:
    _body = _step("content") if _step else strip_urls("content", url_list("content"))
    on_posts(_name, f"SELECT doc_id, {_body} AS result FROM posts")
on_posts("strip_emoji", f"SELECT doc_id, {sub('content', K.EMOJI, '')} AS result FROM posts")
on_posts("truncate_text", f"SELECT doc_id, {truncate('content')} AS result FROM posts")
on_posts("preprocess_text", "SELECT doc_id, clean AS result FROM cleaned", chain_ctes("posts"))

# --- classification -----------------------------------------------------------------------

on_posts("score_stage", """SELECT doc_id, NOT contains(content, '@note1') AS ok,
  CASE WHEN contains(content, '@note1') THEN -1 ELSE length(content) END AS n_chars,
  CASE WHEN contains(content, '@note1') THEN 'the model refuses mentions' ELSE '' END AS error FROM posts""")
on_notes("nsfw_url_records", "SELECT id, relay, records FROM media", media_ctes("notes"))
on_notes("nsfw_url_flags", """SELECT id, relay, url, probably_nsfw, high_probably_nsfw, responsible_nsfw
  FROM occurrences WHERE ok""", media_ctes("notes"))
on_notes("nsfw_note_flag", """SELECT id, relay, probable AS probably_nsfw,
  NOT probable OR cw OR tag AS responsible_nsfw, n_scored FROM media""", media_ctes("notes"))
TEXT = text_ctes("posts")
on_posts("language_input", "SELECT doc_id, language_text AS result FROM classified", TEXT)
on_posts("language_detect", "SELECT doc_id, confidence, language FROM classified", TEXT)
_lowered = f"translate({{}}, '{T.UPPER}', '{T.LOWER}')"
_first, _second, _third = T.TRIGRAM_FACTORS
on_posts("trained_language", f"""SELECT doc_id,
    CASE WHEN language_text = '' THEN cast(0 AS double) ELSE floor(1 / odds * cast(100 AS double) * cast(10000 AS double)) / cast(10000 AS double) END AS confidence,
    CASE WHEN language_text = '' THEN 'en' ELSE lang END AS language
  FROM ranked WHERE place = 1""", TEXT + f""",
  codes AS (SELECT doc_id, is_empty, language_text, list_transform(range(1, length(language_text) + 1),
    lambda i: cast(unicode(substr({_lowered.format('language_text')}, i, 1)) AS BIGINT)) AS c FROM classified),
  grams AS (SELECT doc_id, is_empty, language_text, list_distinct(list_transform(range(1, len(c) - 1),
    lambda i: (c[i] * {_first} + c[i + 1] * {_second} + c[i + 2] * {_third}) % {T.TRIGRAM_BUCKETS})) AS f FROM codes),
  learn AS (SELECT g.doc_id, f, d.lang FROM grams g JOIN documents d USING (doc_id) WHERE g.doc_id % 5 <> 0 AND d.lang IS NOT NULL),
  label_rows AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS total FROM learn GROUP BY lang),
  seen AS (SELECT lang, b, count(*) AS n FROM (SELECT lang, unnest(f) AS b FROM learn) GROUP BY lang, b),
  weights AS (SELECT l.lang, r.b, floor(1000 * ln((coalesce(s.n, 0) + cast({T.SMOOTHING} AS double) * l.n / l.total) / l.n)) AS w
    FROM label_rows l CROSS JOIN (SELECT unnest(range({T.TRIGRAM_BUCKETS})) AS b) r
    LEFT JOIN seen s ON s.lang = l.lang AND s.b = r.b),
  told AS (SELECT doc_id, lang, sum(w) AS w FROM (SELECT doc_id, unnest(f) AS b FROM grams) JOIN weights USING (b)
    GROUP BY doc_id, lang),
  summed AS (SELECT g.doc_id, g.language_text, l.lang,
      floor(1000 * ln(cast(l.n AS double) / l.total)) + coalesce(t.w, 0) AS total
    FROM grams g CROSS JOIN label_rows l LEFT JOIN told t ON t.doc_id = g.doc_id AND t.lang = l.lang WHERE NOT g.is_empty),
  topped AS (SELECT *, max(total) OVER (PARTITION BY doc_id) AS top,
    row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, lang) AS place FROM summed),
  ranked AS (SELECT *, sum(exp((total - top) / 1000)) OVER (PARTITION BY doc_id) AS odds FROM topped)""")
on_posts("trained_toxicity", f"""SELECT doc_id, toxicity, toxicity >= {K.TOXIC_SCORE} AS is_toxic FROM (
  SELECT doc_id, CASE WHEN task_text = '' THEN cast(0 AS double) ELSE floor(1 / (1 + exp(-(
    floor(1000 * ln(cast(tox AS double) / (n - tox))) + coalesce(w, 0)) / 1000)) * cast(10000 AS double)) / cast(10000 AS double)
    END AS toxicity
  FROM words LEFT JOIN told USING (doc_id) CROSS JOIN label_rows WHERE NOT is_empty)""", TEXT + f""",
  words AS (SELECT doc_id, is_empty, task_text, list_distinct(list_filter(
    string_split_regex({_lowered.format('task_text')}, {q(T.SEPARATORS)}), lambda w: w <> '')) AS f FROM classified),
  learn AS (SELECT w.doc_id, f, cast(l.toxic = 1 AS int) AS toxic FROM words w JOIN labels l USING (doc_id)
    WHERE w.doc_id % 5 <> 0 AND l.toxic IS NOT NULL),
  label_rows AS (SELECT count(*) AS n, sum(toxic) AS tox, sum(toxic) / cast(count(*) AS double) AS share FROM learn),
  seen AS (SELECT word, count(*) AS n, sum(toxic) AS t FROM (SELECT toxic, unnest(f) AS word FROM learn) GROUP BY word),
  kept AS (SELECT word, s.n, s.t, l.n AS rows_, l.tox, share,
      abs(s.t - s.n * share) / sqrt(s.n * (share * (1 - share))) AS deviation
    FROM seen s CROSS JOIN label_rows l WHERE s.n >= {T.LEAST_ROWS}
    QUALIFY deviation >= {T.LEAST_DEVIATION} AND row_number() OVER (
      PARTITION BY deviation >= {T.LEAST_DEVIATION} ORDER BY deviation DESC, word) <= {T.MOST_WORDS}),
  weights AS (SELECT word, floor(1000 * ln(((t + cast({T.SMOOTHING} AS double) * share) / tox)
    / ((n - t + cast({T.SMOOTHING} AS double) * (1 - share)) / (rows_ - tox)))) AS w FROM kept),
  told AS (SELECT doc_id, sum(w) AS w FROM (SELECT doc_id, unnest(f) AS word FROM words) JOIN weights USING (word)
    GROUP BY doc_id)""")
on_posts("english_gate", "SELECT doc_id, is_english FROM classified", TEXT)
_scores = ", ".join(
    f"{ {'insult': 'insult', 'toxicity': 'tox'}.get(k, 'cast(0 AS double)') } AS {k}" for k in K.TOXICITY_LABELS
)
on_posts("toxicity_scores", f"SELECT doc_id, {_scores} FROM classified WHERE is_english", TEXT)
on_posts("toxicity_flag", "SELECT doc_id, is_toxic FROM classified WHERE is_english", TEXT)
on_posts("toxicity_summary", f"""SELECT doc_id, greatest(tox, insult) AS max_score,
  CASE WHEN insult + tox >= 1 THEN cast({K.TOXIC_SUM_CAP} AS double) ELSE insult + tox END AS sum_score
  FROM classified WHERE is_english""", TEXT)
on_posts("sentiment", "SELECT doc_id, negative, neutral, positive FROM classified WHERE is_english", TEXT)
on_posts("topic", f"SELECT doc_id, {TOPIC_JSON} AS topics FROM classified WHERE is_english", TEXT)
on_posts("flagged_by_language", """SELECT language, is_english AND is_toxic AS flagged, count(*) AS n
  FROM classified GROUP BY ALL""", TEXT)

# --- records, sinks and the whole flow --------------------------------------------------------


def record(task: str, payload: str, source: str) -> str:
    name = K.TASKS[task]
    return f"""SELECT '{name}' AS task, id AS note_id, '{"0" * 64}' AS pubkey, created_at, {K.RECORD_KIND} AS kind,
      [['d', '{name}'], ['t', '{name}'], ['e', id], ['p', pubkey]] AS tags, {payload} AS content, """ + source


FLOW = f"""{INGRESS},
  fresh AS MATERIALIZED (SELECT id, pubkey, created_at, kind, tags, content, relay, arrival_ms
    FROM judged WHERE outcome = 'pass' AND {FRESH}),
  kind_one AS (SELECT * FROM fresh WHERE kind = 1), {text_ctes('kind_one')}, {media_ctes('kind_one')},
  drafts_out AS (
    {record('nsfw', 'records', 'probable, n_scored FROM media')}
    UNION ALL {record('language', LANGUAGE_JSON, 'NULL, NULL FROM classified WHERE NOT is_empty')}
    UNION ALL {record('toxicity', TOXICITY_JSON, 'NULL, NULL FROM classified WHERE is_english AND is_toxic')}
    UNION ALL {record('sentiment', SENTIMENT_JSON, 'NULL, NULL FROM classified WHERE is_english')}
    UNION ALL {record('topic', TOPIC_JSON, 'NULL, NULL FROM classified WHERE is_english')}),
  every_record AS MATERIALIZED (SELECT sha256({canonical()}) AS id, * FROM drafts_out),
  records AS (SELECT * FROM every_record WHERE coalesce(n_scored, 1) > 0),
  messages AS (SELECT '{K.EVENTS_TOPIC}' AS topic, {event_json()} AS value FROM fresh
    UNION ALL SELECT concat(task, CASE WHEN probable THEN '/1' WHEN NOT probable THEN '/0' ELSE '' END),
      {event_json(record=True)} FROM every_record),
  audit AS (
    SELECT 'classification' AS bucket, records AS value FROM media
    UNION ALL SELECT 'classification_not_responsible_nsfw', records FROM media WHERE probable AND NOT cw AND NOT tag
    UNION ALL SELECT CASE WHEN probable THEN 'classification_probably_nsfw'
      ELSE 'classification_not_probably_nsfw' END, records FROM media
    UNION ALL SELECT 'classification_probably_hate_speech', {js_obj(
        id=js_str('id'), author=js_str('pubkey'), content=js_str('content'),
        finalText=js_str('task_text'), data=TOXICITY_JSON)} FROM classified WHERE is_english AND is_toxic
    UNION ALL SELECT 'invalid_events', {event_json(True)} FROM judged WHERE outcome = 'quarantine')"""

on_notes("classification_records", """SELECT task, pubkey, created_at, cast(kind AS bigint) AS kind,
  cast(to_json(tags) AS varchar) AS tags, content FROM records""", FLOW)
on_notes("record_id", "SELECT task, id FROM records", FLOW)
on_notes("emission_counts", "SELECT task, count(*) AS emitted FROM records GROUP BY task", FLOW)
on_notes("sink_idempotent", "SELECT task, id FROM records", FLOW)
on_notes("task_switches", " UNION ALL ".join(
    f"SELECT '{name}' AS switches, task, count(*) AS emitted FROM records WHERE task IN {words(K.TASKS[t] for t in tasks)} GROUP BY task"
    for name, tasks in {"language": ["language"], "language, topic": ["language", "topic"],
                        "toxicity, language": ["language", "toxicity"]}.items()), FLOW)
on_notes("topic_messages", "SELECT topic, value FROM messages", FLOW)
on_notes("audit_buckets", "SELECT bucket, value FROM audit", FLOW)
_late = words([K.TASKS["sentiment"], K.TASKS["topic"]])
_events, _late_topic = f"topic = '{K.EVENTS_TOPIC}'", f"topic IN {_late}"
on_notes("reemit_order", f"""SELECT cast(0 AS bigint) AS pos, 'messages_events' AS output, count(*) AS rows FROM messages WHERE {_events}
  UNION ALL SELECT 1, 'records_gating', count(*) FROM records WHERE task NOT IN {_late}
  UNION ALL SELECT 2, 'others', count(*) FROM fresh WHERE kind <> 1
  UNION ALL SELECT 3, 'notes', count(*) FROM kind_one
  UNION ALL SELECT 4, 'messages_gating', count(*) FROM messages WHERE NOT {_events} AND NOT {_late_topic}
  UNION ALL SELECT 5, 'audit', count(*) FROM audit
  UNION ALL SELECT 6, 'records_later', count(*) FROM records WHERE task IN {_late}
  UNION ALL SELECT 7, 'messages_later', count(*) FROM messages WHERE {_late_topic}""", FLOW)
on_notes("notes_end_to_end", f"""SELECT 'note' AS output, id AS key, {event_json()} AS value FROM kind_one
  UNION ALL SELECT 'other', id, {event_json()} FROM fresh WHERE kind <> 1
  UNION ALL SELECT 'record', id, content FROM records
  UNION ALL SELECT 'message', topic, value FROM messages
  UNION ALL SELECT 'quarantine', id, {event_json(True)} FROM judged WHERE outcome = 'quarantine'""", FLOW)
on_notes("notes_stream_end_to_end", f"""SELECT CASE WHEN task IN {_late} THEN 'records_later' ELSE 'records_gating' END AS output,
    id AS key, md5(concat(id, {event_json(record=True)})) AS value_md5 FROM records
  UNION ALL SELECT 'notes', id, md5({event_json(True)}) FROM kind_one
  UNION ALL SELECT 'others', id, md5({event_json(True)}) FROM fresh WHERE kind <> 1
  UNION ALL SELECT 'messages', topic, md5(value) FROM messages
  UNION ALL SELECT 'audit', bucket, md5(value) FROM audit""", FLOW)

# However arrivals come, in whatever micro-batches, the outcome is that of one batch over all.
for _name in ("ingress_fold_stream", "ingress_hand_over", "ingress_late_arrivals"):
    ORACLE[_name] = ORACLE["ingress_fold"]
