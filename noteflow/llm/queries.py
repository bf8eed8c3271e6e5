"""The registered queries of the operators and, where SQL can express them, their SQL.

Every query reads its whole table, by the operator of its name with production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.llm import exact_dedup, html_text, license_scan, line_dedup, merkle, mixing, ngram_join, packing, prefix_trie, quality, sharding, token_counts, warc
from noteflow.llm.common import table
from noteflow.llm.labelled_pages import labelled_pages
from noteflow.llm.tokenizer_files import tokenizer_file
from noteflow.staging import new_path

QUERIES = {}
ORACLE = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = mixing.mix(table(spark, sf_dir, "documents"))
    # Repeated rows are documents of their own: their row keeps them apart.
    return entries.groupBy("doc_id", "source", "size", "source_size", "target", "row").agg(
        F.sum("taken").alias("taken")).drop("row")


ORACLE["op1_weighted_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2 * CAST(source_size AS DOUBLE) AS cap,
    CAST(CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3
      WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight
  FROM s),
l AS (
  SELECT *, (1.5 * sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER ahead, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0)) AS until
  FROM w
  WINDOW ahead AS (ORDER BY cap / weight, source IS NULL, encode(source)
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN v IS NULL THEN cap ELSE least(cap, weight * v) END AS target
  FROM (SELECT *, max(CASE WHEN cap / weight > until THEN until END) OVER () AS v FROM l)),
q AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(sum(d.size) OVER (
    PARTITION BY d.source ORDER BY md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '?')), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS served
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT q.*, served + n * source_size AS finish FROM q CROSS JOIN (VALUES (0), (1)) AS epoch(n))
SELECT doc_id, source, size, source_size, target, CAST(sum(greatest(0, least(size,
  CAST(floor(target) AS BIGINT) - (finish - size)))) AS BIGINT) AS taken
FROM e GROUP BY doc_id, source, size, source_size, target
"""


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_repeats(table(spark, sf_dir, "documents"))


ORACLE["op2_exact_dedup"] = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)
"""


@query
def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


# Base 32 in SQL: each digit is five of the 160 bits, read from the hexadecimal form.
ORACLE["op3_warc_round_trip"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS n, sha1(t) AS x FROM p),
d AS (
  SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(x, 1 + CAST((i // 4) * 5 AS INTEGER), 5))
      AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS digest
  FROM h),
r AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS response FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM r
"""


@query
def op4_greedy_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("word_bpe_49k.json")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path)


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), k=4, percent=85)


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("word_bpe_49k.json")
    return packing.packed_documents(table(spark, sf_dir, "documents"), path)


@query
def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded_sizes(table(spark, sf_dir, "documents"), 16, new_path(spark, "slot-map"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), html_text.train(labelled_pages()))


@query
def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs)


ORACLE["op9_quality_cascade"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
k AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS h FROM g),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS n FROM k) WHERE n > 1),
c AS (
  SELECT doc_id, sum(least(8, coalesce(after - i, 8))) AS n
  FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM r) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS upper,
    length(t) - length(regexp_replace(t, '[A-Za-z]+', '', 'g')) AS letters
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 45 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR (letters > 0 AND upper > 0.7 * letters)) AS kept
FROM b
"""


@query
def op10_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    rows = ", ".join(
        f"({n}, {len(t.words) - 1}, {str(t.exact).upper()}, '{t.label}', {q}, '{t.words[q]}', '{t.words[q + 1]}')"
        for n, t in enumerate(license_scan.TEMPLATES) for q in range(len(t.words) - 1))
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
t(template, pairs, exact, label, q, w1, w2) AS (VALUES {rows}),
g AS (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM w),
v AS (
  SELECT DISTINCT doc_id, template, pairs, exact, label, q, i - 1 AS p
  FROM g JOIN t ON words[i] = w1 AND words[i + 1] = w2),
d AS (
  SELECT *, p - q AS diagonal FROM v),
n AS (
  SELECT doc_id, template, diagonal, any_value(pairs) AS pairs, any_value(exact) AS exact FROM d
  GROUP BY doc_id, template, diagonal),
f AS (
  SELECT *, CASE WHEN exact OR pairs <= {license_scan.NEAR} OR coalesce(diagonal - lag(diagonal) OVER own, 999)
      > {license_scan.NEAR} THEN 1 ELSE 0 END AS new
  FROM n WINDOW own AS (PARTITION BY doc_id, template ORDER BY diagonal)),
s AS (SELECT doc_id, template, diagonal, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM f),
x AS (
  SELECT d.doc_id, d.template, any_value(d.exact) AS exact, any_value(label) AS label, min(p) AS first_p,
    count(DISTINCT q) / any_value(pairs) AS share, max(p) - min(p) < 2 * any_value(pairs) AS short
  FROM d JOIN s ON d.doc_id = s.doc_id AND d.template = s.template AND d.diagonal = s.diagonal
  GROUP BY d.doc_id, d.template, s.span),
y AS (SELECT * FROM x WHERE CASE WHEN exact THEN share = 1 ELSE share >= {license_scan.SHARE} AND short END),
a AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(first_p) FILTER (exact) AS first_word,
    max(first_p) FILTER (exact) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (exact)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
  FROM y GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM w LEFT JOIN a ON w.doc_id = a.doc_id
"""


ORACLE["op10_license_diagonals"] = _license_sql()


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op11_line_dedup"] = r"""
WITH l AS (
  SELECT d, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n
  FROM (SELECT row_number() OVER () AS d, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT d) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY d
"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), "
            "lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], "
            "lambda c, z: xor(c >> 1, 3988292384::BIGINT * (c & 1)))), 4294967295)")


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return prefix_trie.prefix_nodes(prefix_trie.rebuilt(prefix_trie.ordered_turns(turns)))


ORACLE["op12_prefix_trie"] = rf"""
WITH o AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS chars, substr(sha256(concat(octet_length(encode(coalesce(role, ''))), ':',
    coalesce(role, ''), coalesce(text, ''))), 1, 32) AS tid FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({{'t': tid, 'c': chars}} ORDER BY turn NULLS FIRST, tid) AS turns, conv_id - conv_id % 100 AS base,
    {crc32_sql("conv_id::VARCHAR")} % 6 AS h
  FROM o GROUP BY conv_id),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM c LEFT JOIN c b ON b.conv_id = c.base),
s AS (SELECT conv_id, list_transform(turns, lambda t: t.t) AS tids, turns FROM r),
p AS (SELECT conv_id, turns, tids, unnest(range(0, len(tids) + 1)) AS d FROM s),
n AS (
  SELECT array_to_string(tids[1:d], '') AS path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    any_value(tids[1:d]) AS tids, any_value(array_to_string(tids[1:d - 1], '')) AS parent, any_value(turns[d].c) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(tids)), '')) AS ends
  FROM p GROUP BY path, d),
k AS (SELECT parent, count(*) AS n FROM n WHERE d > 0 GROUP BY parent),
w AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, (n_convs - 1) * coalesce(chars, 0) AS own
  FROM n LEFT JOIN k ON k.parent = n.path),
a AS (SELECT array_to_string(tids[1:e], '') AS path, n_children, own
  FROM (SELECT tids, n_children, own, unnest(range(0, d + 1)) AS e FROM w)),
t AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM a GROUP BY path)
SELECT w.conv_id, w.d AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, t.n_leaves,
  CAST(t.saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN t ON t.path = w.path LEFT JOIN w q ON w.d > 0 AND q.path = w.parent
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_leaves(table(spark, sf_dir, "documents"))


def _merkle_sql(levels: int = 6, upper: int = 4) -> str:
    """Trees of up to 16 to the power of ``levels`` rows and ``upper`` sources."""
    def part(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode({c}::VARCHAR)), ':', {c}) END"

    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    out = [f"""WITH t AS (
  SELECT *, {head} AS head, CASE WHEN doc_id IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % 5 = 0
    THEN translate(text, {letters}) ELSE text END AS changed FROM documents),
h AS (SELECT *, sha256(head || {part("text")}) AS leaf, sha256(head || {part("changed")}) AS tampered FROM t),
r AS (SELECT source, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS s, n
  FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)),
n0 AS (
  SELECT doc_id, leaf, tampered, s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, n AS w,
    leaf AS digest
  FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source)"""]
    climb = "SELECT doc_id, leaf, s, i, w, tampered AS fold, '' AS proof FROM n0"

    def step(nodes: str, runs: str, climb: str, kept: str) -> str:
        left, right = "array_to_string(c[1:i % 16], '')", "array_to_string(c[i % 16 + 2:], '')"
        return f"""SELECT {kept}, i // 16 AS i, (w + 15) // 16 AS w,
    CASE WHEN w > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold,
    CASE WHEN w > 1 THEN proof || {left} || {right} ELSE proof END AS proof
  FROM ({climb}) x LEFT JOIN (SELECT s AS cs, j, c FROM {runs}) y ON x.s = cs AND x.i // 16 = j AND w > 1"""

    def climbed(name: str, count: int, climb: str, kept: str) -> str:
        for k in range(count):
            nodes, runs = f"{name}{k}", f"{name}r{k}"
            out.append(f"{runs} AS (SELECT s, i // 16 AS j, list(digest ORDER BY i) AS c, max(w) AS w FROM {nodes} WHERE w > 1 GROUP BY s, i // 16)")
            out.append(f"{name}{k + 1} AS (SELECT s, j AS i, (w + 15) // 16 AS w, sha256(array_to_string(c, '')) AS digest FROM {runs} "
                       f"UNION ALL SELECT s, i, w, digest FROM {nodes} WHERE w = 1)")
            out.append(f"{name}c{k} AS ({step(nodes, runs, climb, kept)})")
            climb = f"SELECT * FROM {name}c{k}"
        return climb

    below = climbed("n", levels, climb, "doc_id, leaf, s")
    out.append(f"u0 AS (SELECT 0 AS s, s AS i, (SELECT count(*) FROM r) AS w, digest FROM n{levels})")
    start = f"SELECT doc_id, leaf, s AS own, 0 AS s, s AS i, (SELECT count(*) FROM r) AS w, fold, proof FROM ({below}) b"
    above = climbed("u", upper, start, "doc_id, leaf, own, s")
    return ",\n".join(out) + f"""
SELECT doc_id, leaf, n.digest AS subroot, u.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
  fold = u.digest AS verified
FROM ({above}) x JOIN n{levels} n ON x.own = n.s JOIN u{upper} u ON u.i = 0
"""


ORACLE["op13_merkle_manifest"] = _merkle_sql()
