import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from eventledger.llm import mixing


def rows_of(frame):
    return sorted(frame.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))


def water(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= 2 * sizes[s]}
        for s in over or free:
            target[s] = 2 * sizes[s] if over else level * w[s]
        left -= sum(2 * sizes[s] for s in over)
        free = free - over if over else set()
    return target


def write(spark, path, rows, schema="doc_id long, text string, source string, size int, target int"):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_targets_takes_and_reruns(spark, tmp_path):
    rows = [(i, "w " * (i * 37 % 90), ["b", "a", None, "é", "c"][min(i % 9, 4)], 1, 2) for i in range(400)]
    rows += [(400, None, "a", 1, 2), (401, "", "empty", 1, 2), (402, " \n", "empty", 1, 2), (403, "x " * 30_000, "huge", 1, 2), (404, "x " * 50, "huge", 1, 2)]
    path = write(spark, tmp_path, rows)
    got = rows_of(mixing.op10_mixing(spark, path))
    assert got == rows_of(mixing.op10_mixing(spark, path))
    source = {r[0]: r[2] for r in rows}
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    total = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    want = water(total)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s])
        assert math.isclose(r.target, want[s], abs_tol=1e-4)
        assert 0 <= r.taken <= 2 * r.size
    for s, t in want.items():
        assert abs(sum(r.taken for r in got if source[r.doc_id] == s) - t) <= 1


def test_repeated_and_null_ids_meet_the_target(spark, tmp_path):
    """The budget of a source ends among equal rows, and it is met all the same; which of them are taken is no matter."""
    rows = [(None, "w " * 8, "null") for _ in range(1500)] + [(7, "v " * 5, "one") for _ in range(1000)] + [(i, "u " * (i % 40), "many") for i in range(100, 3000)]
    rows += [(None, f"t{i} t", "other") for i in range(500)] + [(5, "a b", "two"), (5, "a b c d", "two")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op10_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.op10_mixing(spark, str(tmp_path)).collect()))
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    assert len(by) == 5
    for (_, target), mine in by.items():
        assert abs(sum(r.taken for r in mine) - target) <= 1
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"select doc_id, size, source_size, round(target, 3), taken from ({mixing.ORACLE})").fetchall()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.size, r.source_size, round(r.target, 3), r.taken)) for r in got)
    words = lambda t: len(t.split())
    whole = mixing.mixed_documents(frame).groupBy("source").agg({"text": "collect_list"}).collect()
    for source, texts in whole:
        target = next(t for (n, t), mine in by.items() if n == sum(words(x) for _, x, s in rows if s == source))
        assert abs(sum(map(words, texts)) - target) <= 40


def test_empty_tables_and_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (2, "d e", None)], "doc_id long, text string, source string")
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    names = "epochs bucket last_key last_mark rest ties room size key mark row e rank before among task here w _mix_size".split()
    wide = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    out = mixing.mixed_documents(wide)
    assert out.columns == wide.columns and out.count() > 0
    assert out.select(*names).distinct().collect() == [tuple(range(len(names)))]


def test_pipeline_form_repeats_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.op10_mixing(spark, sf).collect()}
    copies = {r.doc_id: r.n for r in mixing.mixed_documents(docs).groupBy("doc_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    for doc, (size, words) in taken.items():
        assert abs(copies.get(doc, 0) * size - words) <= size / 2 + 1


def test_weights_favour_quality(spark):
    rows = [(i, ("clean word " if i % 2 else "no%%% se### ") * 20, "s") for i in range(3000)] + [(10_000 + i, "clean word " * 20, "t") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id for r in mixing.mixed_documents(docs, share=0.15, weights=(1, 1)).select("doc_id").collect()}
    clean, noisy = (sum(i % 2 == k for i in taken if i < 10_000) for k in (1, 0))
    assert clean > 1.2 * noisy > 0


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, size, source_size, target, taken from ({mixing.ORACLE})").fetchall()}
    got = mixing.op10_mixing(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.size, r.source_size, r.taken) == (want[r.doc_id][0], want[r.doc_id][1], want[r.doc_id][3])
        assert r.target == pytest.approx(want[r.doc_id][2], abs=1e-6)
