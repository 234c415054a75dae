"""An index of vectors: inverted lists with residual product codes as a table, and exact ranking of what they find."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.operators.vectors import COSINE, EUCLID, QUERY_BLOCK, ascending, matrix, rectangle, score

#: Vectors that lists, codes and depths are fitted on, lists at most, and candidates a query ranks exactly at most.
SAMPLE, LISTS, DEPTH = 50_000, 4096, 2_000
#: Sampled queries and neighbours by which the number of visited lists is chosen.
PROBED, NEIGHBOURS = 256, 10


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, out)
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        out[used] = sums / np.diff(np.append(first, len(x)))[:, None]
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(axis=1)
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


class Model:
    """Centres of the lists, codebooks of what is left of a vector without its centre, and how far a search goes.

    probes is the number of nearest lists that hold the sampled queries' nearest neighbours with the target recall; depth
    the number of candidates by codes among which these are, scaled from the sample to the table.
    """

    def __init__(self, metric: str, centres: np.ndarray, books: np.ndarray, probes: int, depth: int):
        self.metric, self.centres, self.books, self.probes, self.depth = metric, centres, books, probes, depth

    @classmethod
    def fit(cls, x: np.ndarray, total: int, metric: str, parts: int, recall: float, lists: int | None) -> Model:
        k = lists or int(min(LISTS, max(1, round(total**0.5)), max(1, len(x) // 8)))
        centres = kmeans(x, k)
        cells = _nearest(x, centres)
        left = x - centres[cells]
        wide = -(-x.shape[1] // parts)
        left = np.pad(left, ((0, 0), (0, wide * parts - x.shape[1])))
        size = min(256, len(x))
        books = np.stack([kmeans(left[:, p * wide : (p + 1) * wide], size) for p in range(parts)])
        model = cls(metric, centres, books, 1, NEIGHBOURS)
        rng = np.random.default_rng(9)
        asked = rng.choice(len(x), min(PROBED, len(x)), replace=False)
        sign = 1.0 if ascending(metric) else -1.0
        near = np.argsort(sign * matrix(metric, x[asked], x), axis=1, kind="stable")[:, :NEIGHBOURS]
        place = np.argsort(np.argsort(model.far(x[asked]), axis=1, kind="stable"), axis=1)
        model.probes = int(np.quantile(np.take_along_axis(place, cells[near], axis=1), recall, method="higher")) + 1
        seen = sign * matrix(metric, x[asked], model.decoded(cells, model.codes(x, cells)))
        ahead = np.argsort(np.argsort(seen, axis=1, kind="stable"), axis=1)
        worst = np.quantile(np.take_along_axis(ahead, near, axis=1), recall, method="higher") + 1
        model.depth = int(min(DEPTH, max(NEIGHBOURS, np.ceil(1.2 * worst * max(1.0, total / len(x))))))
        return model

    def far(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries to the lists' centres, but for a query's own length."""
        return (self.centres**2).sum(axis=1) - 2 * q @ self.centres.T

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        parts, _, wide = self.books.shape
        left = np.pad(x - self.centres[cells], ((0, 0), (0, wide * parts - x.shape[1])))
        return np.stack([_nearest(left[:, p * wide : (p + 1) * wide], b) for p, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def decoded(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        left = np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], axis=1)
        return self.centres[cells] + left[:, : self.centres.shape[1]]

    def prepared(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors for a cosine; the rows that have none are NaN."""
        if self.metric != COSINE:
            return x
        with np.errstate(divide="ignore", invalid="ignore"):
            return x / np.linalg.norm(x, axis=1, keepdims=True)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centres=self.centres, books=self.books, numbers=np.array([self.probes, self.depth]))
        return out.getvalue()


class VectorIndex:
    """A written index: a table of (cell, id, code, vector), in order of cell so that a search reads the lists it visits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        r = spark.read.parquet(f"{self.path}/model").first()
        held = np.load(io.BytesIO(bytes(r.packed)))
        self.id_col, self.model = r.id_col, Model(r.metric, held["centres"], held["books"], *held["numbers"].tolist())

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def add(self, vectors: DataFrame, vector_col: str = "embedding") -> None:
        """Appends vectors to the lists of the model as it was fitted; those that it can't hold are left out."""
        model, kind = self.model, vectors.schema[vector_col].dataType
        schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("id", vectors.schema[self.id_col].dataType), T.StructField("code", T.BinaryType()), T.StructField("vector", kind)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = model.prepared(rectangle(batch.column(1).to_pylist(), model.centres.shape[1]))
                fit = np.flatnonzero(np.isfinite(x).all(axis=1))
                x, own = x[fit], batch.take(pa.array(fit))
                cells = _nearest(x, model.centres)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), own.column(0), pa.array([c.tobytes() for c in model.codes(x, cells)], pa.binary()), own.column(1)], schema.names)

        rows = vectors.select(self.id_col, vector_col).mapInArrow(run, schema)
        rows.repartitionByRange("cell", "id").sortWithinPartitions("cell").write.mode("append").parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, limit: int = 10, probes: int | None = None, query_id: str = "query_id", query_col: str = "query") -> DataFrame:
        """(query_id, rank, id, score): for each query the nearest vectors of the lists it visits, by exact scores.

        Blocks of queries go out; a task scores the codes of its lists for the queries that visit them and keeps the
        best of each, no more than depth. Those of all tasks are ranked, depth stay, and their vectors alone are scored
        exactly; ties go by id. Queries of another length, with null components or without a direction find nothing.
        """
        model, sign = self.model, 1.0 if ascending(self.model.metric) else -1.0
        probes, depth = min(probes or model.probes, len(model.centres)), max(model.depth, limit)
        given = queries.select(F.col(query_id).alias("q"), F.col(query_col).alias("v"))
        blocks = 1 + (given.count() - 1) // QUERY_BLOCK
        lists, out = self.table(), None
        found_in = T.StructType([T.StructField("q", given.schema["q"].dataType), T.StructField("cell", T.IntegerType()), T.StructField("id", lists.schema["id"].dataType), T.StructField("near", T.DoubleType())])
        for k in range(max(1, blocks)):
            held = given.where(F.pmod(F.xxhash64("q"), F.lit(max(1, blocks))) == k).toArrow()  # a block's bound
            q = model.prepared(rectangle(held.column("v").to_pylist(), model.centres.shape[1]))
            fit = np.flatnonzero(np.isfinite(q).all(axis=1))
            q, names = q[fit], held.column("q").combine_chunks().take(pa.array(fit))
            visited = np.argsort(model.far(q), axis=1, kind="stable")[:, :probes]
            sent = self.spark.sparkContext.broadcast((q, names, visited, model))

            def near(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                q, names, visited, model = sent.value
                for batch in batches:
                    cells = batch.column(0).to_numpy()
                    for cell in np.unique(cells).tolist():
                        asking = np.flatnonzero((visited == cell).any(axis=1))
                        rows = np.flatnonzero(cells == cell)
                        if not len(asking):
                            continue
                        codes = np.frombuffer(b"".join(batch.column(2).take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
                        far = sign * matrix(model.metric, q[asking], model.decoded(cells[rows], codes))
                        best = np.argsort(far, axis=1, kind="stable")[:, :depth]
                        a = np.repeat(asking, best.shape[1])
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), batch.column(0).take(pa.array(rows[best.ravel()])), batch.column(1).take(pa.array(rows[best.ravel()])), pa.array(np.take_along_axis(far, best, 1).ravel())], found_in.names)

            some = np.unique(visited).tolist()
            own = lists.where(F.col("cell").isin(some)) if len(some) < len(model.centres) else lists
            found = own.select("cell", "id", "code").mapInArrow(near, found_in)
            ahead = F.row_number().over(Window.partitionBy("q").orderBy("near", "id"))
            found = found.withColumn("r", ahead).where(F.col("r") <= depth).select("q", "cell", "id")
            exact = found.join(own.select("cell", "id", "vector"), ["cell", "id"]).join(given, "q").select("q", "id", score(model.metric, F.col("vector"), F.col("v")).alias("score")).distinct()
            out = exact if out is None else out.union(exact)
        order = Window.partitionBy("q").orderBy(F.asc_nulls_last("score") if ascending(model.metric) else F.desc_nulls_last("score"), "id")
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(F.col("q").alias(query_id), "rank", F.col("id").alias(self.id_col), "score")


def build(vectors: DataFrame, path: str, size: int, metric: str = COSINE, parts: int = 16, recall: float = 0.98, lists: int | None = None, id_col: str = "id", vector_col: str = "embedding") -> VectorIndex:
    """Fits an index for vectors of one size on a bounded sample and writes all of them into it.

    The sample is SAMPLE vectors at most, by the hash of their ids. Null vectors, those of another size, with null or
    non-finite components, or, for the cosine, of zeros, are in no list. A product of vectors has no nearest centres: for
    that and the Manhattan distance there is vectors.batch_search.
    """
    if metric not in (COSINE, EUCLID):
        raise ValueError(f"no index for {metric}: search exactly")
    spark = vectors.sparkSession
    usable = vectors.where((F.size(vector_col) == size) & F.col(vector_col).isNotNull())
    total = usable.count()
    taken = usable.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).select(vector_col).toArrow()
    x = rectangle(taken.column(0).to_pylist(), size)
    x = Model(metric, np.zeros((1, size)), np.zeros((1, 1, 1)), 1, 1).prepared(x)
    x = x[np.isfinite(x).all(axis=1)]
    model = Model.fit(x if len(x) else np.zeros((1, size)), total, metric, parts, recall, lists)
    spark.createDataFrame([(metric, id_col, bytearray(model.packed()))], "metric string, id_col string, packed binary").write.mode("overwrite").parquet(f"{path}/model")
    index = VectorIndex(spark, path)
    vectors.sparkSession.createDataFrame([], T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("id", vectors.schema[id_col].dataType), T.StructField("code", T.BinaryType()), T.StructField("vector", vectors.schema[vector_col].dataType)])).write.mode("overwrite").parquet(f"{path}/lists")
    index.add(vectors, vector_col)
    return index
