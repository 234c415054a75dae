"""Versioned loads and the vector index."""

import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.functions import metadata
from lodeworks.operators import store, tracker, vector_index, vectors
from lodeworks.plans import search

SF = "/root/testdata/sf0.01"


def batch(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, [float(k)]) for k, t in enumerate(texts)], "seq long, text string, embedding array<double>").repartition(2)


def texts_of(s):
    return sorted(r.text for r in s.read().collect())


def test_loads_keep_each_text_once_and_old_versions(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/c")
    assert s.version() == 0 and s.read() is None and s.manifest() == {"loads": [], "rows": 0}
    assert tuple(s.load(batch(spark, ["a", "b", "a", None])).first()) == (4, 2, 2, 1)
    assert tuple(s.load(batch(spark, ["b", "c"], 10)).first()) == (2, 1, 3, 2)
    assert texts_of(s) == ["a", "b", "c"] and sorted(r.text for r in s.read(1).collect()) == ["a", "b"]
    assert {r.seq for r in s.read().where("text = 'a'").collect()} == {0}
    before = sorted(os.listdir(tmp_path / "c" / "loads"))
    assert tuple(s.load(batch(spark, ["a", "b", "c"], 20)).first()) == (3, 0, 3, 2) and sorted(os.listdir(tmp_path / "c" / "loads")) == before
    assert tuple(s.load(batch(spark, [])).first()) == (0, 0, 3, 2)
    assert s.merge() == 3 and texts_of(s) == ["a", "b", "c"] and len(s.manifest()["loads"]) == 1
    assert tuple(s.load(batch(spark, ["c", "d"], 30)).first()) == (2, 1, 4, 4)
    assert len(s.vacuum()) == 2 and texts_of(s) == ["a", "b", "c", "d"]


def test_known_rows_are_told_by_hashes_in_their_buckets(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/c")
    s.load(batch(spark, [f"t{k}" for k in range(40)]))
    one = s._hashes(s.manifest()["loads"], [3])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "ReadSchema: struct<content_hash:string>" in plan
    files = one.inputFiles()
    assert files and all("/hashes/bucket=" in f for f in files)


def test_loads_at_once_leave_each_text_once(spark, tmp_path):
    at, told = f"file://{tmp_path}/c", []
    lots = [[f"t{k}" for k in range(a, a + 30)] for a in (0, 10, 20, 0)]
    threads = [threading.Thread(target=lambda own=own, i=i: told.append(tuple(store.Store(spark, at).load(batch(spark, own, 100 * i)).first()))) for i, own in enumerate(lots)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    s = store.Store(spark, at)
    assert texts_of(s) == sorted({t for own in lots for t in own})
    assert sum(t[1] for t in told) == s.manifest()["rows"] == 50 and len(told) == 4


def test_a_failed_batch_is_counted_and_leaves_nothing(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/c")
    bad = batch(spark, ["x", "y"]).withColumn("embedding", F.when(F.col("seq") == 1, F.raise_error(F.lit("no model")).cast("array<double>")).otherwise(F.col("embedding")))
    got = s.load_all([batch(spark, ["a"]), bad, batch(spark, ["x", "a"], 5)]).orderBy("batch").collect()
    assert [(r.total, r.uploaded, r.in_collection, r.version) for r in got] == [(1, 1, 1, 1), (None, 0, 1, 1), (2, 1, 2, 2)]
    assert got[1].failure and got[0].failure is None and texts_of(s) == ["a", "x"]
    s.vacuum()
    assert len(os.listdir(tmp_path / "c" / "loads")) == 2 and texts_of(s) == ["a", "x"]


def clustered(n=4000, size=24, seed=2):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((40, size)) * 2
    return [(k, (centres[k % 40] + r.standard_normal(size) * 0.7).tolist()) for k in range(n)]


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_index_finds_what_exact_search_finds(spark, tmp_path, metric):
    rows = clustered()
    odd = [(9001, None), (9002, [1.0]), (9003, [None] * 24), (9004, [float("nan")] * 24), (9005, [0.0] * 24), (9006, rows[7][1])]
    df = spark.createDataFrame(rows + odd, "id long, embedding array<double>").repartition(3)
    asked = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")).union(spark.createDataFrame([(-1, None), (-2, [1.0])], "query_id long, query array<double>"))
    index = vector_index.build(df, f"file://{tmp_path}/i", 24, metric)
    assert index.model.probes < len(index.model.centres) / 2
    exact = {(r.query_id, r.id): r.score for r in vectors.batch_search(df, asked.where("query_id >= 0"), 10, metric=metric).collect()}
    got = {(r.query_id, r.id): r.score for r in index.search(asked).collect()}
    assert len(got) == 2000 and len(got.keys() & exact.keys()) >= 0.95 * 2000
    assert all(abs(s - exact[k]) < 1e-9 for k, s in got.items() if k in exact)
    whole = {(r.query_id, r.id) for r in index.search(asked, 3, probes=len(index.model.centres)).collect()}
    assert len(whole) == 600
    assert index.table().count() == 4001 + (metric == "euclid")
    index.add(spark.createDataFrame([(9999, rows[40][1])], "id long, embedding array<double>"))
    again = vector_index.VectorIndex(spark, f"file://{tmp_path}/i").search(asked.where("query_id = 40"), 2).collect()
    assert {r.id for r in again} == {40, 9999} and [r.rank for r in again] == [1, 2]
    with pytest.raises(ValueError):
        vector_index.build(df, f"file://{tmp_path}/j", 24, "dot")


def test_index_of_nothing_and_of_few(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<float>")
    assert vector_index.build(none, f"file://{tmp_path}/n", 2).search(asked).collect() == []
    few = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(3)], "id long, embedding array<float>")
    assert [r.id for r in vector_index.build(few, f"file://{tmp_path}/f", 2).search(asked).orderBy("rank").collect()] == [0, 1, 2]
    assert vector_index.build(few, f"file://{tmp_path}/f", 2).search(asked.where("false")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_index_recall_over_a_whole_table(spark):
    got = {(r.query_id, r.id) for r in search.vec_index_topk(spark, SF).collect()}
    v = search._vectors(spark, SF)
    want = {(r.query_id, r.id) for r in vectors.batch_search(v, v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), 10).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def test_batches_with_few_usable_vectors_send_no_more_than_the_limit(spark):
    rows = [(k, [1.0, 0.0] if k < 2 else [0.0, 0.0]) for k in range(50, -1, -1)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.5])], "query_id long, query array<double>")
    assert [(r.rank, r.id) for r in vectors.batch_search(df, asked, 5).orderBy("rank").collect()] == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_keywords_are_the_rows_own(spark):
    df = spark.createDataFrame([(1, "alpha alpha beta"), (1, "gamma delta epsilon"), (None, "zeta zeta"), (2, None)], "id long, text string")
    got = {r.text: r.metadata.keywords for r in metadata.describe(df, "text", F.lit("https://example.com/x")).collect()}
    assert got["alpha alpha beta"] == ["alpha", "beta"] and sorted(got["gamma delta epsilon"]) == ["delta", "epsilon", "gamma"] and got["zeta zeta"] == ["zeta"] and got[None] == []


def test_errors_of_one_time_have_an_order(spark):
    logs = spark.createDataFrame([(f"j{k}", 5.0, "ERROR", f"m{k}", None) for k in range(30)], "job_id string, ts double, level string, message string, step_name string").repartition(5)
    assert [r.job_id for r in tracker.last_errors(logs, 3).collect()] == ["j0", "j1", "j10"]
