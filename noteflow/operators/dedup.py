"""Repeat removal with a fixed time-to-live, exact in batch.

The rule: an arrival blocks later arrivals of its id for ``ttl`` from its own time; blocked
arrivals do not extend the block. Which arrivals are accepted is a chain, each link being
the first arrival more than ``ttl`` after the one before, so one id is sequential by nature.
It is cut as follows, since one id may hold a third of all rows:

1. arrivals of an id in the same millisecond (the clock of the rule) collapse to one, with
   map-side combine;
2. an id is cut into chunks of time, no longer than ``CHUNK_MS`` whatever the ttl, so a group is
   bounded by the clock, not by the rows; each chunk works out, for whatever arrival was
   accepted last before it, what is accepted last when it ends (a short step table, as chains
   from different entries soon merge); only chunks whose arrivals block beyond their end need one;
3. a chunk that no other reaches needs no table: what it accepts last is known. Where chunks reach
   one another, tables of up to ``FAN`` chunks are composed into one, those again, and so on: a tree,
   of which the few tables at the top are passed through in order and give the parts below their
   entries, down to the chunks; many ids share a task, which holds one table at a time;
4. the chunks then accept their arrivals independently of each other.

All of this moves ids and times only; the outcome goes to the whole rows at the end, a bit for each.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteflow.functions import constants as K
from noteflow.operators.ingest import intact, valid_structure, with_arrival
from noteflow.staging import TEXTS, cut_lineage, even

# A chunk is at most as long, so it holds at most as many milliseconds.
CHUNK_MS = 3_600_000
CHUNK_TTLS = 12
# Step tables that are composed into one, and those that one task passes through, on average.
FAN = 4096
TASK_ROWS = 20_000
SALTS = 64
# Words of 64 row numbers that may be sent to every task: some 100 MB.
WORDS = 4_000_000


def step_table(times: np.ndarray, ttl: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """``(upto, leave)``: entering with ``s <= upto[i]`` (first such i) leaves ``leave[i]``.

    ``times`` ascend strictly from ``start``, entries lie before it. An entry above the last
    ``upto`` blocks the whole chunk and leaves it unchanged.
    """
    n = len(times)
    following = np.searchsorted(times, times + ttl, side="right")
    last = np.where(following < n, following, np.arange(n))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    # No entry reaches past the first arrival at or after start + ttl.
    m = int(np.searchsorted(times, start + ttl, side="left")) + 1
    upto, leave = times[:m] - ttl - 1, times[last[:m]]
    keep = np.append(leave[1:] != leave[:-1], True)
    return upto[keep], leave[keep]


def _steps(ttl: int, chunk_ms: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tables = [
                step_table(np.asarray(t, dtype=np.int64), ttl, chunk * chunk_ms)
                for t, chunk in zip(pdf["times"], pdf["chunk"])
            ]
            yield pd.DataFrame({
                "key": pdf["key"], "part": pdf["chunk"],
                "upto": [t[0] for t in tables], "leave": [t[1] for t in tables],
            })

    return run


def compose(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The step table of two stretches of time in a row."""
    upto, leave = one
    at = np.searchsorted(two[0], leave, side="left")
    through = np.where(at < len(two[0]), two[1][np.minimum(at, len(two[0]) - 1)], leave)
    beyond = two[0] > upto[-1]
    upto, leave = np.append(upto, two[0][beyond]), np.append(through, two[1][beyond])
    keep = np.append(leave[1:] != leave[:-1], True)
    return upto[keep], leave[keep]


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One table for the parts of an id in one group; rows come sorted by id, group and part."""
    here, table = None, None

    def row(here, table):
        return (here[0], here[1], *table)

    for pdf in batches:
        out = []
        for key, group, upto, leave in zip(pdf["key"], pdf["group"], pdf["upto"], pdf["leave"]):
            part = np.asarray(upto, np.int64), np.asarray(leave, np.int64)
            if (key, group) == here:
                table = compose(table, part)
                continue
            if here is not None:
                out.append(row(here, table))
            here, table = (key, group), part
        yield pd.DataFrame(out, columns=["key", "part", "upto", "leave"])
    if here is not None:
        yield pd.DataFrame([row(here, table)], columns=["key", "part", "upto", "leave"])


def _passed(ttl: int, width: int):
    """Through the parts of an id in one group, from the group's entry: the entries of parts.

    Rows come sorted by id, group and part; only the last part and its state are held. An entry
    is given to each part from one with a table up to the next, as far as it blocks.
    """

    def beyond(key, part, last, following) -> list[tuple]:
        reach = (last + ttl) // width
        return [(key, near, last) for near in
                range(part + 1, int(reach if following is None else min(reach, following)) + 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = before = None
        for pdf in batches:
            out = []
            rows = zip(pdf["key"], pdf["group"], map(int, pdf["part"]), pdf["upto"], pdf["leave"], pdf["entry"])
            for key, group, part, upto, leave, entry in rows:
                same = (key, group) == here
                if before is not None:
                    out += beyond(*before, part if same else None)
                if same:
                    last = before[2]
                else:
                    here, last = (key, group), None if pd.isna(entry) else int(entry)
                    if last is not None and last + ttl >= part * width:
                        out.append((key, part, last))
                if last is None or last + ttl < part * width:
                    last = int(leave[0])
                else:
                    at = int(np.searchsorted(upto, last, side="left"))
                    last = int(leave[at]) if at < len(upto) else last
                before = (key, part, last)
            yield pd.DataFrame(out, columns=["key", "part", "entry"])
        if before is not None:
            yield pd.DataFrame(beyond(*before, None), columns=["key", "part", "entry"])

    return run


TABLES = "key string, part bigint, upto array<bigint>, leave array<bigint>"
ENTRIES = "key string, part bigint, entry bigint"


def _sorted_groups(tables: DataFrame, rows: int) -> DataFrame:
    """Whole groups per task, sorted, many to a task: as many tasks as the rows need."""
    tasks = max(1, -(-rows // TASK_ROWS))
    return tables.repartition(tasks, "key", "group").sortWithinPartitions("key", "group", "part")


def _entries(tables: DataFrame, ttl: int, width: int, span: int, rows: int) -> DataFrame:
    """``key, part, entry``: the last accepted arrival before a part, where it may block there.

    ``span`` is the number of parts from the first to the last of all ids, ``rows`` that of tables.
    """
    if span > FAN:
        grouped = tables.withColumn("group", F.floor(F.col("part") / FAN))
        above = cut_lineage(_sorted_groups(grouped, rows).mapInPandas(_composed, TABLES), "step-tables")
        entries = _entries(above, ttl, width * FAN, span // FAN + 1, rows // FAN + 1)
        entries = entries.select(F.col("key").alias("k"), F.col("part").alias("g"), "entry")
        grouped = grouped.join(entries, (F.col("key") == F.col("k")) & (F.col("group") == F.col("g")), "left").drop("k", "g")
    else:  # the top: all parts of an id together
        grouped = tables.withColumn("group", F.lit(0).cast("bigint")).withColumn("entry", F.lit(None).cast("bigint"))
    found = _sorted_groups(grouped, rows).mapInPandas(_passed(ttl, width), ENTRIES)
    # Two groups may name the entry of one part: the later arrival is the last one.
    return found.groupBy("key", "part").agg(F.max("entry").alias("entry"))


def _chunk_entries(runs: DataFrame, ttl_ms: int, chunk_ms: int) -> DataFrame:
    """``key, chunk, entry`` of the chunks that an arrival of an earlier chunk may block.

    Only a chunk with arrivals in its last ttl can block beyond its end. Most of those have no such
    neighbour within reach: what they accept last does not depend on others and is worked out
    by the fold itself. Only stretches of chunks that reach one another are passed through in order.
    """
    accept = _accept(ttl_ms)
    ended = F.aggregate("times", F.lit(None).cast("bigint"), lambda s, t: F.when(accept(s, t), t).otherwise(s))
    opened = runs.select("key", "chunk", F.array_max("times").alias("top"), ended.alias("last")).filter(
        F.col("top") + ttl_ms >= (F.col("chunk") + 1) * chunk_ms)
    own = Window.partitionBy("key").orderBy("chunk")
    reached = F.coalesce(F.lag("top").over(own) + ttl_ms >= F.col("chunk") * chunk_ms, F.lit(False))
    reaches = F.coalesce(F.col("top") + ttl_ms >= F.lead("chunk").over(own) * chunk_ms, F.lit(False))
    opened = cut_lineage(opened.select("key", "chunk", "last", (reached | reaches).alias("linked")), "open-chunks")

    until = F.floor((F.col("last") + ttl_ms) / chunk_ms)
    alone = opened.filter(~F.col("linked") & (until > F.col("chunk")))
    entries = alone.select("key", F.explode(F.sequence(F.col("chunk") + 1, until)).alias("chunk"), F.col("last").alias("entry"))
    first, last, count = opened.filter("linked").agg(F.min("chunk"), F.max("chunk"), F.count("*")).first()
    if not count:
        return entries
    # Parts count from the first chunk, times from its beginning.
    linked = opened.filter("linked").select("key", "chunk")
    moved = runs.join(linked, ["key", "chunk"]).select(
        "key", (F.col("chunk") - first).alias("chunk"),
        F.transform("times", lambda t: t - first * chunk_ms).alias("times"))
    tables = cut_lineage(moved.mapInPandas(_steps(ttl_ms, chunk_ms), TABLES), "step-tables")
    passed = _entries(tables, ttl_ms, chunk_ms, last - first + 1, count).select(
        "key", (F.col("part") + first).alias("chunk"), (F.col("entry") + first * chunk_ms).alias("entry"))
    return entries.unionByName(passed)


def _accept(ttl_ms: int):
    """Whether a time is accepted after the last accepted one."""
    return lambda last, t: last.isNull() | (t - last > ttl_ms)


def accepted_times(arrivals: DataFrame, ttl_ms: int, chunk_ms: int | None = None) -> DataFrame:
    """The accepted ``(key, ts)``, each once, among rows of ``key string, ts bigint`` in ms.

    ``chunk_ms`` is the length of a chunk, at most ``CHUNK_MS`` by default.
    """
    chunk_ms = chunk_ms or min(CHUNK_TTLS * ttl_ms, CHUNK_MS)
    # A set of milliseconds is bounded by the length of the chunk, before and after the shuffle.
    # It is written once for the two that read it: the tables and the accepting.
    known = arrivals.filter("key IS NOT NULL AND ts IS NOT NULL")
    runs = cut_lineage(known.groupBy("key", F.floor(F.col("ts") / chunk_ms).alias("chunk")).agg(
        F.array_sort(F.collect_set("ts")).alias("times")
    ), "chunks")
    joined = runs.join(_chunk_entries(runs, ttl_ms, chunk_ms), ["key", "chunk"], "left")
    start = F.struct(
        F.col("entry").alias("last"), F.array().cast("array<bigint>").alias("kept")
    )
    free = _accept(ttl_ms)
    accept = lambda s, t: F.when(
        free(s["last"], t),
        F.struct(t.alias("last"), F.concat(s["kept"], F.array(t)).alias("kept")),
    ).otherwise(s)
    return joined.select("key", F.explode(F.aggregate("times", start, accept)["kept"]).alias("ts"))


def _stage(
    events: DataFrame, key: str, ts: str, row_id: str | None, **verdicts: Column
) -> tuple[DataFrame, DataFrame]:
    """(arrivals, rows): narrow columns to decide on, and whole rows, both with ``row_no``.

    The number is unique and stable: it tells exact copies apart and joins without hot keys.
    It is ``row_id`` if the source has one; then only the narrow columns are written, and the
    rows are read again from the source. Otherwise the write of the whole rows fixes it.
    """
    relay = F.col("relay") if "relay" in events.columns else F.lit("")
    number = F.col(row_id) if row_id else F.monotonically_increasing_id()
    columns = [
        F.coalesce(F.col(key), F.lit("undefined")).alias("key"),
        F.unix_millis(F.coalesce(F.col(ts), F.current_timestamp())).alias("ts"),
        F.struct(
            F.coalesce(relay, F.lit("")).alias("relay"),
            F.xxhash64(*[c for c in events.columns if c != row_id]).alias("copy"),
            number.alias("row_no"),
        ).alias("order"),
        *[v.alias(name) for name, v in verdicts.items()],
    ]
    by = ("forged",) if "forged" in verdicts else ()
    if row_id:
        rows = events.select(number.alias("row_no"), F.struct(*events.columns).alias("row"))
        return cut_lineage(events.select(*columns), "arrivals", by), rows
    written = cut_lineage(
        events.select(*columns, F.struct(*events.columns).alias("row")), "arrivals", by, TEXTS
    )
    rows = written.select(F.col("order.row_no").alias("row_no"), "row", *by)
    return written.drop("row"), rows


def _accepted(arrivals: DataFrame, ttl_ms: int, *keep: str, past: DataFrame | None = None) -> DataFrame:
    """Accepted arrivals as ``key, ts, order`` and ``keep``; only narrow columns are moved.

    ``past`` holds ``key, ts`` accepted before: no arrival within a ttl of them is.
    """
    first = arrivals.groupBy("key", "ts").agg(F.min(F.struct("order", *keep)).alias("first"))
    if past is None:
        times = accepted_times(arrivals.select("key", "ts"), ttl_ms)
    else:
        first = cut_lineage(_unblocked(first, past, ttl_ms), "unblocked")
        times = accepted_times(first.select("key", "ts"), ttl_ms)
    # Not a semi join: that would be moved below the aggregate, and copies would travel.
    return first.join(times, ["key", "ts"]).select("key", "ts", "first.*")


def _unblocked(arrivals: DataFrame, past: DataFrame, ttl_ms: int) -> DataFrame:
    """Arrivals further than a ttl from all ``past`` ones. Those lie more than a ttl apart, so a slot of
    time holds one at most, and a hot id is spread over its slots."""
    slot = lambda t: F.floor(t / (ttl_ms + 1))
    near = past.select(F.col("key").alias("k"), F.col("ts").alias("t"), F.explode(F.array(
        *[slot(F.col("ts")) + n for n in (-1, 0, 1)])).alias("near"))
    return arrivals.join(near, (F.col("key") == F.col("k")) & (slot(F.col("ts")) == F.col("near"))
                         & (F.abs(F.col("ts") - F.col("t")) <= ttl_ms), "left_anti")


def _free(forged: DataFrame, blocking: DataFrame, ttl_ms: int) -> DataFrame:
    """Forged arrivals that no accepted one (``key, ts, order``) before them blocks.

    Accepted arrivals lie more than a ttl apart: at most one per slot of that width, and
    only those of the same or the previous slot can block. One forged event may have very
    many copies, so they are spread by salts, and the blocks go to the salts in use.
    """
    slot = lambda t: F.floor(t / ttl_ms)
    forged = forged.withColumn("slot", slot(F.col("ts")))
    wanted = forged.select("key", "slot", "salt").distinct()
    blocks = (
        blocking.select(
            "key", F.col("ts").alias("b_ts"), F.col("order").alias("b_order"),
            F.explode(F.array(slot(F.col("ts")), slot(F.col("ts")) + 1)).alias("slot"),
        )
        .join(wanted, ["key", "slot"])
        .alias("b")
    )
    hit = (
        (F.col("f.key") == F.col("b.key")) & (F.col("f.slot") == F.col("b.slot"))
        & (F.col("f.salt") == F.col("b.salt")) & (F.col("ts") - F.col("b_ts") <= ttl_ms)
        & (F.struct("b_ts", "b_order") < F.struct("ts", "order"))
    )
    return forged.alias("f").join(blocks, hit, "left_anti").drop("slot")


def stage_arrivals(events: DataFrame, sig_ok: str | None = None, row_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(arrivals, rows) of the ingress: the arrivals also have the verdicts ``valid`` and ``forged``."""
    valid = valid_structure()
    return _stage(
        with_arrival(events), "id", "arrival_ts", row_id,
        valid=valid,
        # The hash is only needed, hence only computed, for well-shaped events.
        forged=F.when(valid, ~intact(sig_ok)).otherwise(False),
        salt=F.pmod(F.spark_partition_id(), F.lit(SALTS)),
    )


def fold_arrivals(arrivals: DataFrame, ttl_ms: int, past: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocking, free) of staged arrivals: those accepted, written, also badly shaped ones, and the
    forged ones that none of them blocks. ``past`` holds ``key, ts, order`` accepted before."""
    honest = arrivals.filter(~F.col("forged"))
    blocking = cut_lineage(_accepted(honest, ttl_ms, "valid", past=past), "blocking")
    known = blocking.select("key", "ts", "order")
    return blocking, _free(arrivals.filter("forged"), known if past is None else known.unionByName(past), ttl_ms)


def outcomes(blocking: DataFrame, free: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole rows that pass and those that go to quarantine."""
    parted = "forged" in rows.columns
    honest_rows = rows.filter(~F.col("forged")) if parted else rows
    forged_rows = rows.filter("forged") if parted else rows
    return _rows_of(honest_rows, blocking.filter("valid")), _rows_of(forged_rows, free)


def _rows_of(rows: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The whole rows of some arrivals.

    The numbers go to the rows as bits, 64 to a word, and the rows stay where they are. Numbers that are no integers,
    or too many words to send to every task, are met by the one wide shuffle, by row number; what follows (hashes,
    texts, URLs) costs by the row, so its tasks keep their number.
    """
    numbers = arrivals.select(F.col("order.row_no").alias("row_no"))
    if dict(numbers.dtypes)["row_no"] == "bigint":
        word, bit = word_and_bit(F.col("row_no"))
        words = cut_lineage(numbers.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")), "row-bits")
        if words.count() <= WORDS:
            here = (word == F.col("word")) & (bit.bitwiseAND(F.col("bits")) != 0)
            return rows.join(F.broadcast(words), here, "left_semi").select("row.*")
    return even(rows, "row_no").join(even(numbers, "row_no"), "row_no", "left_semi").select("row.*")


def word_and_bit(number: Column) -> tuple[Column, Column]:
    """Where a row number lies among words of 64 bits, and its bit there."""
    return F.shiftright(number, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), number.bitwiseAND(F.lit(63)).cast("int"))


def dedup_ttl(
    events: DataFrame,
    key: str = "id",
    ts: str = "arrival_ts",
    ttl_s: int = K.DEDUP_TTL_S,
    exact: bool = True,
    row_id: str | None = None,
) -> DataFrame:
    """Drop repeats of ``key`` within ``ttl_s`` of the accepted arrival.

    ``row_id`` names a column that identifies a row on every reading, see
    ``sources.events.file_row_id``; without one the rows are written once more.

    ``exact=False`` is the built-in watermark form for streams. It drops at least as much:
    its clock only moves between micro-batches.
    """
    if not exact:
        if not events.isStreaming:
            raise ValueError("the watermark form works on streams only")
        return events.withWatermark(ts, f"{ttl_s} seconds").dropDuplicatesWithinWatermark([key])
    if events.isStreaming:
        raise ValueError("use noteflow.streaming.dedup_state for exact removal on a stream")
    arrivals, rows = _stage(events, key, ts, row_id)
    return _rows_of(rows, _accepted(arrivals, ttl_s * 1000))


def ingress_fold(
    events: DataFrame,
    ttl_s: int = K.DEDUP_TTL_S,
    sig_ok: str | None = None,
    row_id: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine): repeat removal together with the two checks.

    A repeat is dropped before it is checked. A badly shaped event is dropped but blocks its
    id; a forged one goes to quarantine and does not block, so a good copy may follow.
    """
    arrivals, rows = stage_arrivals(events, sig_ok, row_id)
    return outcomes(*fold_arrivals(arrivals, ttl_s * 1000), rows)
