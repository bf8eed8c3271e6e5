"""Web archives (WARC 1.0): records written by Spark, and read back from any byte range.

Files are split by bytes, so a task starts in the middle of a file and sees the record magic, but
not whether it begins a record or lies inside of a payload. Each occurrence is a candidate, whose
header, if there is one, says where its successor begins. Pointer jumping from the start of each
file then keeps the candidates that the chain of records reaches: links are doubled until they
leave the file, so the rounds follow the logarithm of the records of a file. A chain that does not
end at the end of its file is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.llm.common import narrow_join
from noteflow.staging import Rounds, cut_lineage, new_path

MAGIC = "WARC/1.0\r\n"
BLANK = "\r\n\r\n"
#: Digits of base 32 as Spark's conv writes them, and in the alphabet of digests.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: eight times 20 bits are four digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * n, 5), 16, 32), 4, "0") for n in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _header(name: str, value: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[\r\n]+", " ")
    return F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n"))


def _urn(id_col: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(">"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html",
               date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """One record per row, in files below ``path``, by Spark's own writer.

    The payload is the page in UTF-8 (null: empty) after an HTTP head. Of equal payloads of at
    least ``least_bytes``, the row with the largest id is a response and the others revisit it,
    without payload; rows with that same id are all responses. A row without an id counts as
    smaller than all others and keeps no id. Line ends in a URL become spaces.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), text.alias("payload"),
                        base32_sha1(text.cast("binary")).alias("digest"), F.octet_length(text).alias("bytes"))
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(
        F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1")
    groups = cut_lineage(groups.select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "response"), "payload-groups")
    joined = narrow_join(rows, groups, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    revisit = F.col("d").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(BLANK))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    refers = F.when(revisit, _header("WARC-Refers-To", _urn(F.col("response")))).otherwise(F.lit(""))
    record = F.concat(
        F.lit(MAGIC), _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _urn(F.col("id"))), _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), refers,
        _header("Content-Type", F.lit("application/http;msgtype=response")),
        F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(BLANK), F.col("block"))
    joined.withColumn("block", block).select(record.alias("value")).write.option("lineSep", BLANK).text(path)


def _field(head: Column, name: str, value: str = r"([^\r\n]*?)") -> Column:
    return F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*{value}[ \t]*(?:\r\n|$)", 1)


def _head(value: Column) -> Column:
    return F.substring_index(value, BLANK, 1)


def candidate_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Written: ``file, block, m, value``, what follows each magic up to the next one.

    ``block`` is the first byte of the split that a task read and ``m`` grows within it.
    """
    read = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("m"), F.col("value").cast("binary").alias("value"))
    out = new_path(spark, "warc-chunks")
    read.write.option("compression", "zstd").parquet(out)
    return spark.read.schema(read.schema).parquet(out)


def _located(chunks: DataFrame) -> DataFrame:
    """``file, block, m, index, start, size, after, need`` of every chunk, written.

    ``start`` is the offset of the chunk's magic; ``after`` that of the successor, null where no
    record header follows; ``need`` is the number of bytes of header and block. Offsets are sums
    of sizes: of the blocks before, and of the chunks before in a block.
    """
    value = F.col("value").cast("string")
    head = _head(value)
    length = F.when(F.octet_length(head) < F.octet_length(value), _field(head, "Content-Length", r"(\d{1,18})"))
    sizes = chunks.select("file", "block", "m", F.octet_length("value").cast("long").alias("size"),
                          (F.octet_length(head) + len(BLANK) + F.when(length != "", length).cast("long")).alias("need"))
    sizes = cut_lineage(sizes, "warc-sizes")
    unit = F.col("size") + len(MAGIC)
    blocks = sizes.groupBy("file", "block").agg(F.sum(unit).alias("bytes"), F.count("*").alias("n"))
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("file").alias("f"), F.col("block").alias("b"),
                           F.coalesce(F.sum("bytes").over(past), F.lit(0)).alias("bytes"),
                           F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n"))
    run = Window.partitionBy("file", "block").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("low", F.coalesce(F.sum(unit).over(run), F.lit(0))).withColumn(
        "number", F.row_number().over(Window.partitionBy("file", "block").orderBy("m")))
    placed = inside.join(blocks, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    # The first chunk of a file lies before the first magic.
    start = F.col("bytes") + F.col("low") - len(MAGIC)
    return cut_lineage(placed.select(
        "file", "block", "m", (F.col("n") + F.col("number")).alias("index"), start.alias("start"), "size",
        (start + len(MAGIC) + F.col("need") + len(BLANK)).alias("after"), "need"), "warc-offsets")


def reachable(links: DataFrame) -> DataFrame:
    """``file, start`` of the records that the chain from offset 0 of each file reaches.

    ``links`` has ``file, start, after`` per candidate. In each round the reached set follows the
    links once, which doubles it, and the links are joined with themselves. What the round before
    last wrote is deleted.
    """
    rounds = Rounds(links.sparkSession)
    jumps = links.select("file", "start", "after")
    nodes = links.select(F.col("file").alias("f"), F.col("start").alias("s"))
    jumps = rounds.cut(jumps.join(nodes, (F.col("file") == F.col("f")) & (F.col("after") == F.col("s"))).select(
        "file", "start", "after"), "warc-jumps")
    reached = links.where("start = 0").select("file", "start")
    while True:
        step = reached.join(jumps, ["file", "start"]).select("file", F.col("after").alias("start"))
        grown = rounds.cut(step, "warc-reached")
        if not grown.head(1):
            return reached
        reached = rounds.cut(reached.unionByName(grown), "warc-reached")
        further = jumps.select(F.col("file").alias("f"), F.col("start").alias("s"), F.col("after").alias("to"))
        jumps = rounds.cut(jumps.join(further, (F.col("file") == F.col("f")) & (F.col("after") == F.col("s"))).select(
            "file", "start", F.col("to").alias("after")), "warc-jumps")
        rounds.turn()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files below ``path``: ``file, offset, type, record_id, target_uri, digest,
    refers_to, http_length, payload``.

    ``payload`` is what follows the HTTP head (binary), ``http_length`` the length that head names,
    null without one. Raises ``ValueError`` if the chain of records of a file breaks off.
    """
    chunks = candidate_chunks(spark, path)
    spots = _located(chunks)
    found = cut_lineage(reachable(spots.where("after IS NOT NULL AND start >= 0")), "warc-records")
    records = spots.join(found.select(F.col("file").alias("rf"), F.col("start").alias("rs")),
                         (F.col("file") == F.col("rf")) & (F.col("start") == F.col("rs"))).drop("rf", "rs")
    records = cut_lineage(records, "warc-spots")
    _whole(spots, records)

    # Whole records lie in one chunk. All other chunks are left out, or put together again.
    key = ["file", "block", "m"]
    single = records.where("need <= size").select(*key)
    rest = cut_lineage(spots.select(*key).join(single, key, "left_anti").select(
        F.col("file").alias("xf"), F.col("block").alias("xb"), F.col("m").alias("xm")), "warc-rest")

    def at(chunk: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return narrow_join(chunk, keys, (F.col("file") == F.col("xf")) & (F.col("block") == F.col("xb"))
                           & (F.col("m") == F.col("xm")), how)

    whole = at(chunks, rest, "left_anti").select(F.col("file"), F.col("block"), F.col("m"), "value")
    spread = cut_lineage(_parts(spots, records), "warc-parts")
    texts = at(chunks, spread, "inner").groupBy("rf", "record").agg(
        F.array_sort(F.collect_list(F.struct("part", F.col("value").cast("string").alias("value")))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC)
    first = spread.where("part = record").select(
        F.col("rf").alias("of"), F.col("record").alias("at"), "xf", "xb", "xm")
    texts = texts.join(first, (F.col("rf") == F.col("of")) & (F.col("record") == F.col("at"))).select(
        F.col("xf").alias("file"), F.col("xb").alias("block"), F.col("xm").alias("m"), joined.cast("binary").alias("value"))
    return _parsed(whole.unionByName(texts))


def _whole(spots: DataFrame, records: DataFrame) -> None:
    """Every file's chain of records must end where the file ends."""
    ends = spots.groupBy("file").agg(F.max(F.col("start") + len(MAGIC) + F.col("size")).alias("end"))
    last = records.groupBy(F.col("file").alias("f")).agg(F.max("after").alias("last"))
    broken = ends.where("end > 0").join(last, F.col("file") == F.col("f"), "left").where(
        F.col("last").isNull() | (F.col("last") != F.col("end"))).select("file").limit(3).collect()
    if broken:
        raise ValueError(f"the chain of records breaks off in {[r[0] for r in broken]}")


def _parts(spots: DataFrame, records: DataFrame) -> DataFrame:
    """The chunks ``part`` (with their keys ``xf, xb, xm``) of records with the magic inside."""
    split = records.where("need > size").select("file", "index", "after")
    following = records.select(F.col("file").alias("nf"), F.col("start").alias("ns"), F.col("index").alias("until"))
    split = split.join(following, (F.col("file") == F.col("nf")) & (F.col("after") == F.col("ns")), "left")
    counts = spots.groupBy(F.col("file").alias("cf")).agg((F.max("index") + 1).alias("beyond"))
    split = split.join(counts, F.col("file") == F.col("cf"))
    each = split.select(F.col("file").alias("rf"), F.col("index").alias("record"), F.explode(
        F.sequence(F.col("index"), F.coalesce("until", "beyond") - 1)).alias("part"))
    places = spots.select(F.col("file").alias("xf"), F.col("block").alias("xb"), F.col("m").alias("xm"), "index")
    return each.join(places, (F.col("rf") == F.col("xf")) & (F.col("part") == F.col("index"))).drop("index")


def _parsed(records: DataFrame) -> DataFrame:
    value = F.col("value").cast("string")
    head = _head(value)
    length = _field(head, "Content-Length", r"(\d{1,18})").cast("int")
    block = F.substring(F.col("value"), F.octet_length(head) + len(BLANK) + 1, length)
    named = records.select("file", "value", head.alias("head"), block.alias("body")).withColumn(
        "http", _head(F.col("body").cast("string")))
    offset = F.octet_length("http") + len(BLANK) + 1
    return named.select(
        "file", _field(F.col("head"), "WARC-Type").alias("type"),
        _field(F.col("head"), "WARC-Record-ID", "<([^>]*)>").alias("record_id"),
        _field(F.col("head"), "WARC-Target-URI").alias("target_uri"),
        _field(F.col("head"), "WARC-Payload-Digest").alias("digest"),
        _field(F.col("head"), "WARC-Refers-To", "<([^>]*)>").alias("refers_to"),
        _field(F.col("http"), "Content-Length", r"(\d{1,18})").cast("long").alias("http_length"),
        F.substring(F.col("body"), offset, F.greatest(F.lit(0), F.octet_length("body") - offset + 1)).alias("payload"))


def page_id(urn: Column, dtype: str = "long") -> Column:
    """The page id in a record id of ``write_warc``; null where the page had none."""
    found = F.regexp_extract(urn, "^urn:page:(.*)$", 1)
    return F.when(found != "", found.cast(dtype))


def page_records(pages: DataFrame, path: str, id_col: str = "page_id") -> DataFrame:
    """Write ``pages`` to archives below ``path``, read those back, and return a row per page:
    ``id_col, payload_bytes, payload_digest, record_type, refers_to``.

    Bytes and digest of a response are those of the payload read; a revisit names those of the
    full payload in its heads. An empty table writes no record and gives no row.
    """
    spark = pages.sparkSession
    dtype = pages.schema[id_col].dataType.simpleString()
    write_warc(pages, path, id_col)
    if not pages.head(1):
        return pages.limit(0).select(
            F.col(id_col), F.lit(0).cast("long").alias("payload_bytes"), F.lit("").alias("payload_digest"),
            F.lit("").alias("record_type"), F.col(id_col).alias("refers_to"))
    read = read_warc(spark, path)
    response = F.col("type") == "response"
    return read.select(
        page_id(F.col("record_id"), dtype).alias(id_col),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("payload"))).otherwise(
            F.regexp_extract("digest", "^sha1:(.*)$", 1)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(~response, page_id(F.col("refers_to"), dtype)).alias("refers_to"))
