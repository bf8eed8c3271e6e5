"""Registered corpus queries beside their SQL on small tables, and what their results must hold."""

import glob
import os
import zlib

import duckdb
import numpy as np
import pytest

from noteflow.llm.queries import ORACLE, QUERIES
from noteflow.llm.tokenizer_files import tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def in_order(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    result = db.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    got = in_order(df.columns, df.collect())
    assert got and got == in_order(columns, result.fetchall())


def test_packing_holds_every_id(spark, db):
    from tokenizers import Tokenizer

    rows = QUERIES["op6_best_fit_packing"](spark, SF).collect()
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want, total = {}, 0
    for doc_id, text in db.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for number, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start:start + 2048]
            want[doc_id, number] = (start, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) <= 2048
    assert len(used) <= 1.03 * -(-total // 2048) + 1


def test_shards_have_equal_bytes(spark, db):
    rows = QUERIES["op7_virtual_slots"](spark, SF).collect()
    texts = dict(db.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    assert len(rows) == len(texts)
    load, places = [0] * 16, [[] for _ in range(16)]
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places)
    assert max(load) - min(load) < 0.01 * sum(load) / 16
