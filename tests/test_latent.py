"""The fitted embedding: equality with a dense decomposition, what it finds against word hashing, odd rows, reruns."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.operators import latent, vectors
from lodeworks.plans import search

tables = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")


def dense(texts, features):
    """Weighted, normed rows of texts, word by word."""
    own = [Counter() for _ in texts]
    for c, t in zip(own, texts, strict=True):
        for w in re.findall(r"\w+", (t or "").lower()):
            c[zlib.crc32(w.encode()) % features] += 1
    n, df = sum(bool(c) for c in own), Counter(i for c in own for i in c)
    out = np.zeros((len(texts), features))
    for row, c in zip(out, own, strict=True):
        for i, k in c.items():
            row[i] = (1 + math.log(k)) * math.log1p(n / df[i])
        if c:
            row /= np.linalg.norm(row)
    return out


@tables
def test_vectors_equal_a_dense_decomposition(spark):
    """Where the test matrix is as wide as the rank, nothing is left to chance: cosines are those of all leading directions."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(70).select("doc_id", "text", latent.counted(F.col("text"), 4096).alias("features")).cache()
    model = latent.fit(docs, size=68, features=4096)
    rows = docs.withColumn("v", latent.embed(F.col("features"), model)).collect()
    x = dense([r.text for r in rows], 4096)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert model.values == pytest.approx(s[:68] * (s[:68] ** 2 > 1e-6 * s[0] ** 2), abs=2e-4)
    want = x @ vt[: np.count_nonzero(model.values)].T
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    got = np.array([r.v for r in rows])
    assert got @ got.T == pytest.approx(want @ want.T, abs=2e-3)


@tables
def test_leading_values_of_a_narrow_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", latent.counted(F.col("text"), 4096).alias("features")).cache()
    s = np.linalg.svd(dense([r.text for r in docs.collect()], 4096), compute_uv=False)
    held = []
    for passes in (2, 3, 6):
        model = latent.fit(docs, size=16, features=4096, passes=passes)
        assert np.all(model.values <= s[:16] + 1e-3)
        assert model.directions.T @ model.directions == pytest.approx(np.eye(16), abs=1e-4)
        held.append(float((model.values**2).sum() / (s[:16] ** 2).sum()))
    assert 0.75 < held[0] < held[1] < held[2] and held[2] > 0.98
    assert model.values[:8] == pytest.approx(s[:8], rel=0.03)


@tables
def test_query_ranks_as_its_vectors_do(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", latent.counted(F.col("text")).alias("features")).cache()
    model = latent.fit(docs)
    held = {r.doc_id: np.array(r.v, float) for r in docs.select("doc_id", latent.embed(F.col("features"), model).alias("v")).collect()}
    asked = {r.item_id: np.array(r.v, float) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", latent.embed(latent.counted(F.col("text")), model).alias("v")).collect()}
    got = search.embed_latent(spark, sf).collect()
    assert Counter(r.query_id for r in got) == {q: 3 for q in asked}
    for r in got:
        q = asked[r.query_id]
        best = sorted((float(q @ v) / (np.linalg.norm(q) * np.linalg.norm(v)) for v in held.values() if v.any()), reverse=True)
        assert r.score == pytest.approx(best[r.rank - 1], abs=2e-4)


@tables
def test_near_copies_stand_out_more_than_by_word_hashing(spark):
    """Average precision of the pairs with a similarity of 0.85 or more among all pairs of documents, by cosine at one size."""
    sf = "/root/testdata/sf0.01"
    pairs = search.near_dup_pairs(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", latent.counted(F.col("text")).alias("features")).cache()
    rows = docs.select("doc_id", latent.embed(F.col("features"), latent.fit(docs)).alias("fitted"), vectors.embed(F.col("text"), 64).alias("hashed")).collect()
    place = {r.doc_id: k for k, r in enumerate(rows)}
    own = np.zeros((len(rows), len(rows)), bool)
    for a, b in ((place[p["first"]], place[p["again"]]) for p in pairs):
        own[min(a, b), max(a, b)] = True
    upper = np.triu_indices(len(rows), 1)

    def precision(key):
        x = np.array([r[key] for r in rows])
        found = own[upper][np.argsort(-(x @ x.T)[upper], kind="stable")]
        return float(((np.cumsum(found) / np.arange(1, len(found) + 1)) * found).sum() / found.sum())

    assert precision("fitted") > precision("hashed") + 0.1


def test_reruns_agree_whatever_the_partitions(spark):
    rows = [(i, f"word{i % 7} other{i % 5} thing{i % 3} " * (i % 4 + 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string").select("id", latent.counted(F.col("text"), 512).alias("features"))
    a, b = latent.fit(df.repartition(7), size=8, features=512), latent.fit(df.repartition(2), size=8, features=512)
    assert np.array_equal(a.directions, b.directions) and np.array_equal(a.values, b.values)


def test_odd_rows(spark):
    schema = "id long, text string, ids int"
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b a", 0), (3, "a b a", 0), (4, "...", 0), (None, "c " * 50_000, 0), (5, " ".join(f"w{i}" for i in range(40_000)), 0)], schema)
    rows = df.withColumn("features", latent.counted(F.col("text"), 1 << 12)).cache()
    model = latent.fit(rows, size=8, features=1 << 12)
    got = [(r.id, np.array(r.v)) for r in rows.select("id", latent.embed(F.col("features"), model).alias("v")).collect()]
    for i, v in got:
        assert len(v) == 8 and np.linalg.norm(v) == pytest.approx(0 if i in (1, 2, 4) else 1, abs=1e-5)
    assert np.count_nonzero(model.values) == 3
    same = [v for i, v in got if i == 3]
    assert np.array_equal(*same)
    none = latent.fit(rows.where("id = 99"), size=8, features=1 << 12)
    assert not none.values.any() and not any(any(r.v) for r in rows.select(latent.embed(F.col("features"), none).alias("v")).collect())


def test_sums_of_texts_are_whole_numbers_whatever_the_blocks(spark, monkeypatch):
    import numpy as np

    rows = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 37}" for j in range(1, 30))) for k in range(50)], "id long, text string").repartition(3)
    counted = rows.select(latent.counted(F.col("text"), 256).alias("features"))
    weights, basis = np.linspace(0.5, 2, 256), np.random.default_rng(3).standard_normal((256, 5))
    want = np.zeros((256, 5))
    for r in counted.collect():
        ids, counts = np.array(r.features.ids), np.array(r.features.counts)
        x = latent.weighted(counts, ids, np.array([0]), weights)
        want[ids] += np.rint(np.multiply.outer(x, (x[:, None] * basis[ids]).sum(axis=0)) * latent.SCALE)
    got = latent._product(counted, weights, basis) * latent.SCALE
    assert (got == np.rint(got)).all() and np.abs(got - want).max() <= 2
