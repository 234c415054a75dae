"""Batch search in pieces: ties, copies and odd vectors against plain sorting, and its vectors made once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.operators import vectors


@pytest.mark.parametrize("metric", [vectors.COSINE, vectors.EUCLID])
def test_pieces_and_blocks_keep_the_best_with_ties_by_id(spark, monkeypatch, metric):
    monkeypatch.setattr(vectors, "PIECE", 7)
    monkeypatch.setattr(vectors, "PIECE_QUERIES", 3)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    r = np.random.default_rng(1)
    rows = [(k, [float(x) for x in r.integers(-1, 2, 3)]) for k in range(120)] + [(120, None), (121, [1.0]), (122, [None, 1.0, 1.0]), (123, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    asked = df.where("id < 11").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(x.query_id, x.rank): (x.id, None if x.score is None else round(x.score, 9)) for x in vectors.batch_search(df, asked, 6, metric=metric).collect()}

    def score(a, b):
        if a is None or b is None or len(a) != len(b) or None in b:
            return None
        if metric == vectors.EUCLID:
            return float(np.linalg.norm(np.subtract(a, b)))
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if n else None

    sign = 1 if metric == vectors.EUCLID else -1
    for q, v in rows[:11]:
        found = [(i, s if s is None else round(s, 9)) for i, e in rows if e is not None for s in [score(v, e)]]
        found.sort(key=lambda p: (p[1] is None, sign * (p[1] or 0), p[0]))
        assert [got[q, k] for k in range(1, 7)] == found[:6], q


def test_vectors_are_made_once_for_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(k):
        made.add(1)
        return [1.0, float(k)]

    df = spark.range(40).select("id", vector("id").alias("embedding"))
    asked = spark.range(20).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("query"))
    assert vectors.batch_search(df, asked, 1).where("id = query_id").count() == 20
    assert made.value == 40


def test_hashed_vectors_are_the_words_signed_counts(spark):
    import zlib

    texts = ["a b a", "Ünï a\xa0b", "", None, "x " * 500]
    got = [r.v for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", vectors.embed(F.col("t"), 16).alias("v")).orderBy("i").collect()]
    for t, v in zip(texts, got, strict=True):
        want = np.zeros(16)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            want[h % 16] += 1 if h >> 31 else -1
        assert np.allclose(v, want / max(np.linalg.norm(want), 1e-12))


def test_tables_reach_python_in_small_batches(spark, tmp_path):
    import pyarrow as pa

    from lodeworks.sources import table

    spark.createDataFrame([(k, "x" * 100_000) for k in range(200)], "i int, t string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    got = [r.n for r in table(spark, str(tmp_path), "documents").mapInArrow(sizes, "n long").collect()]
    assert len(got) > 3 and max(got) < 5 << 20
