"""The pipeline against a brute-force version, and its handling of odd rows."""

import itertools
import re

import corpus_pipeline
from noteflow.llm import exact_dedup, mixing, quality

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def similar_groups(rows, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in rows:
        words = WORD.findall(r.text.translate(low))
        sets[r.doc_id] = {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        rows = docs.collect()
        kept.append((before.collect(), rows))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    (raw, good), (_, single), (_, apart), (_, mixed), (_, packed) = kept

    judged = {r.doc_id: r.kept for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert {r.doc_id for r in good} == {i for i, k in judged.items() if k} and len(good) < len(raw)
    first = {}
    for r in good:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        first[key] = min(r.doc_id, first.get(key, r.doc_id))
    assert {r.doc_id for r in single} == set(first.values()) and len(single) == len(first)
    assert {r.doc_id for r in apart} == similar_groups(single, 5, 80)
    size = {r.doc_id: len(WORD.findall(r.text)) for r in apart}
    total = sum(size.values())
    assert 1.3 * total < sum(size[r.doc_id] for r in mixed) <= 1.5 * total
    assert max(sum(1 for r in mixed if r.doc_id == i) for i in size) <= 2
    assert sum(1 for r in packed if r.piece == 0) == len(mixed)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    prose = " ".join(f"word{i} other{i}" for i in range(30))
    rows = [(1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (2, None, None, None, None), (None, prose + " x", None, None, None),
            (3, "", "en", "a", 0), (4, prose.replace("word3 ", "wordy "), "en", "b", 1), (5, "tail " + prose[::-1], "en", None, 1)]
    # Ids after each stage: blank texts go, equal and near copies go to the smallest id, a row without an id stays.
    want = [[1, 1, 4, 5, None], [1, 4, 5, None], [1, 5, None]]
    for frame in (spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([], COLUMNS)):
        frame = frame.selectExpr("*", "1 AS id", "2 AS token", "3 AS taken", "4 AS epoch")
        docs, ids = frame, []
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{frame.count()}-{at}")
            stage(spark, docs, SF).write.parquet(out)
            docs = spark.read.parquet(out)
            ids.append(sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is None, i)))
            assert at == 4 or docs.columns == frame.columns
        assert ids[:3] == (want if frame.count() else [[]] * 3)
        assert set(ids[3]) <= set(ids[2]) and all(ids[3].count(i) <= 2 for i in ids[3])
        assert ids[4] == ids[3]
        assert bool(ids[3]) == bool(frame.count())


def test_registered(spark):
    from __spark_entry__ import oracle_sql, queries

    assert queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in oracle_sql()
    assert exact_dedup and mixing
