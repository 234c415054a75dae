"""A vector collection as a table: similarity search, filters, boosts, loading with dedup, and its figures."""

import time
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.functions.metadata import contains_any
from lodeworks.functions.text import raw_hash, record_id
from lodeworks.operators.crawl import written

COSINE, DOT, EUCLID, MANHATTAN = "cosine", "dot", "euclid", "manhattan"
#: Query vectors a search broadcasts at once.
QUERY_BLOCK = 2048
#: Vectors that a task scores at a time, and queries of a block that it scores them against.
PIECE, PIECE_QUERIES = 2048, 256
# The boosts of a re-ranking.
URL_BOOSTS = ((1.15, ("service", "product", "solution")), (1.1, ("about", "team", "company")), (1.05, ("blog", "article", "interview")))
WORD_BOOST, SENTENCE_BOOST = (50, 1.1), (3, 1.05)
TEXT_FIELDS = ("text", "content", "clean_text", "processed_text", "metadata.content", "metadata.text", "metadata.clean_text", "metadata.processed_text", "chunk_text", "document_text", "page_content")
# End of fixed values.


@dataclass(frozen=True)
class Collection:
    """What a collection is created with; the index settings are for stores that have an index."""

    name: str
    size: int = 384
    metric: str = COSINE
    batch: int = 100
    index: dict = field(default_factory=lambda: {"m": 16, "ef_construct": 100, "full_scan_threshold": 10000, "indexing_threshold": 20000})


def ascending(metric: str) -> bool:
    """Distances rank smallest first, similarities largest first."""
    return metric in (EUCLID, MANHATTAN)


def score(metric: str, a: Column, b: Column) -> Column:
    """One metric of two arrays in double precision; null where a cosine has a zero vector."""
    total = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)
    d = lambda x: x.cast("double")
    if metric == EUCLID:
        return F.sqrt(total(lambda x, y: (d(x) - d(y)) * (d(x) - d(y))))
    if metric == MANHATTAN:
        return total(lambda x, y: F.abs(d(x) - d(y)))
    dot = total(lambda x, y: d(x) * d(y))
    if metric == DOT:
        return dot
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + d(x) * d(x)))
    return F.try_divide(dot, norm(a) * norm(b))


def search(vectors: DataFrame, query: list[float], limit: int = 10, threshold: float | None = None, must: dict | None = None, metric: str = COSINE, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The nearest vectors to one query: equality filters first, then the score, the threshold and the top rows."""
    rows = vectors
    for column, value in (must or {}).items():
        rows = rows.where(F.col(column) == value)
    rows = rows.withColumn("score", score(metric, F.col(vector_col), F.array(*(F.lit(float(x)) for x in query))))
    if threshold is not None:
        rows = rows.where(F.col("score") <= threshold if ascending(metric) else F.col("score") >= threshold)
    return rows.orderBy(F.asc_nulls_last("score") if ascending(metric) else F.desc_nulls_last("score"), id_col).limit(limit)


def batch_search(vectors: DataFrame, queries: DataFrame, limit: int = 10, threshold: float | None = None, metric: str = COSINE, id_col: str = "id", vector_col: str = "embedding", query_id: str = "query_id", query_col: str = "query") -> DataFrame:
    """(query_id, rank, id, score): for each query row its nearest vectors.

    Queries are broadcast in blocks of a fixed size; each piece of vectors is scored against a block by matrix products
    and keeps its best rows for each query, those that are no worse than the limit-th best its task has seen, so that the
    ranking shuffles no more than limit rows of a piece and query, and fewer with every piece. Vectors and queries that
    take more than one block are written first, not made again for each.
    As in search, a score is null and ranks last where a vector has null components or another length than the query's,
    and for a zero vector's cosine.
    """
    spark = vectors.sparkSession
    given = queries.select(F.col(query_id).alias("q"), F.col(query_col).alias("v"))
    blocks = 1 + (given.count() - 1) // QUERY_BLOCK
    dealt = given.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    vectors = vectors.select(id_col, vector_col)
    if blocks > 1:
        dealt, vectors = written(dealt, "queries"), written(vectors, "vectors")
    sign = 1.0 if ascending(metric) else -1.0
    schema = T.StructType([T.StructField("q", given.schema["q"].dataType), T.StructField("id", vectors.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    parts = []
    for k in range(blocks):
        held = dealt.where(F.col("block") == k).select("q", "v").toArrow()
        if not held.num_rows:
            continue
        lists = held.column("v").to_pylist()
        dims = max((len(v) for v in lists if v), default=1)
        sent = spark.sparkContext.broadcast((held.column("q").combine_chunks(), rectangle(lists, dims)))

        def best(batches, sent=sent):
            names, q = sent.value
            top = np.full((len(q), limit), np.inf)
            for batch in (b.slice(k, PIECE) for b in batches for k in range(0, b.num_rows, PIECE)):
                batch = batch.filter(batch.column(1).is_valid())
                if not batch.num_rows:
                    continue
                batch = batch.take(pa.array(np.argsort(_places(batch.column(0)), kind="stable")))  # ties go by id
                x = _rows_of(batch.column(1), q.shape[1])
                for i in range(0, len(q), PIECE_QUERIES):
                    s = matrix(metric, q[i : i + PIECE_QUERIES], x)
                    far = np.where(np.isnan(s), np.inf, sign * s)
                    a, b, place = _nearest(far, limit, top[i : i + PIECE_QUERIES, -1])
                    seen = np.full((len(far), limit), np.inf)
                    seen[a, place] = far[a, b]
                    top[i : i + PIECE_QUERIES] = np.sort(np.concatenate([top[i : i + PIECE_QUERIES], seen], axis=1), axis=1)[:, :limit]
                    if threshold is not None:
                        kept = far[a, b] <= sign * threshold
                        a, b = a[kept], b[kept]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(a + i)), batch.column(0).take(pa.array(b)), pa.array(s[a, b], mask=np.isnan(s[a, b]))], ["q", "id", "score"])

        found = vectors.mapInArrow(best, schema)
        if blocks > 1:  # a block's queries leave with its results, so that one block is held at a time
            found = written(found, "best")
            sent.destroy()
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(query_id, schema["q"].dataType), T.StructField("rank", T.IntegerType()), *schema.fields[1:]]))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    order = Window.partitionBy("q").orderBy(F.asc_nulls_last("score") if ascending(metric) else F.desc_nulls_last("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(F.col("q").alias(query_id), "rank", F.col("id").alias(id_col), "score")


def _nearest(far: np.ndarray, limit: int, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and places of each row's limit smallest values that are no larger than its worst; ties in the order of columns."""
    near = far <= worst[:, None]
    if np.count_nonzero(near) > 4 * limit * len(far) and far.shape[1] > limit:
        near = far <= np.minimum(worst, np.partition(far, limit - 1, axis=1)[:, limit - 1])[:, None]
    a, b = np.nonzero(near)
    order = np.lexsort((b, far[a, b], a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < limit], b[place < limit], place[place < limit]


def _places(ids: pa.Array) -> np.ndarray:
    """Each id's place in the order of ids, nulls first."""
    order = pc.sort_indices(ids, null_placement="at_start").to_numpy() if not pa.types.is_nested(ids.type) else np.array(sorted(range(len(ids)), key=lambda i: tuple(ids[i].as_py().values())))
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids))
    return out


def rectangle(lists: list[list[float] | None], dims: int) -> np.ndarray:
    """Vectors as rows; NaN throughout for those that are null, have null components or another length."""
    out = np.full((len(lists), dims), np.nan)
    for row, v in zip(out, lists, strict=True):
        if v is not None and len(v) == dims and None not in v:
            row[:] = v
    return out


def _rows_of(lists: pa.Array, dims: int) -> np.ndarray:
    """rectangle of a list array, at once where its vectors are all whole."""
    flat = lists.flatten()
    if lists.null_count or flat.null_count or not pc.all(pc.equal(pc.list_value_length(lists), dims)).as_py():
        return rectangle(lists.to_pylist(), dims)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def matrix(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == MANHATTAN:
        return np.stack([np.abs(x - v).sum(1) for v in q])
    if metric == EUCLID:
        return np.stack([np.sqrt(((x - v) ** 2).sum(1)) for v in q])
    if metric == COSINE:
        with np.errstate(divide="ignore", invalid="ignore"):
            q, x = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (q, x))
    return q @ x.T


def distinct_results(results: DataFrame, query_id: str = "query_id", text_col: str = "text", order: str = "rank") -> DataFrame:
    """The first result of each text of a query, in order."""
    rank = F.row_number().over(Window.partitionBy(query_id, text_col).orderBy(order))
    return results.withColumn("__r", rank).where("__r = 1").drop("__r")


def boost(results: DataFrame, query_id: str = "query_id", order: str = "rank") -> DataFrame:
    """Scores raised for long and well-built texts and by kind of address; ranked anew, ties in the old order."""
    low = F.lower(F.coalesce("source_url", F.lit("")))
    by_url = F
    for factor, parts in URL_BOOSTS:
        by_url = by_url.when(contains_any(low, parts), factor)
    factor = F.when(F.col("word_count") > WORD_BOOST[0], WORD_BOOST[1]).otherwise(1.0) * F.when(F.col("sentence_count") > SENTENCE_BOOST[0], SENTENCE_BOOST[1]).otherwise(1.0) * by_url.otherwise(1.0)
    rows = results.withColumn("boosted", F.col("score") * factor)
    return rows.withColumn("new_rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("boosted"), order)))


def payload_text(payload: Column) -> Column:
    """A hit's text from the first of many fields that isn't empty."""
    found = F.coalesce(*(F.nullif(F.get_json_object(payload, f"$.{f}"), F.lit("")) for f in TEXT_FIELDS), F.lit("No content available"))
    return F.replace(found, F.lit("﻿"), F.lit(""))


def enrich(payloads: DataFrame, column: str = "payload", source: str = "knowledge_base", company: str = "company") -> DataFrame:
    """Payload maps with defaults for source, company and content type; page_url and url fill in for each other."""
    p = F.col(column)
    get = lambda k: F.try_element_at(p, F.lit(k))
    url = F.coalesce(get("page_url"), get("url"))
    defaults = F.create_map(F.lit("source"), F.lit(source), F.lit("company"), F.lit(company), F.lit("content_type"), F.lit("general"))
    both = F.when(url.isNotNull(), F.create_map(F.lit("page_url"), url, F.lit("url"), F.coalesce(get("url"), url))).otherwise(F.create_map().cast("map<string,string>"))
    return payloads.withColumn(column, F.map_from_entries(F.map_entries(F.map_zip_with(F.map_zip_with(defaults, p, lambda k, a, b: F.coalesce(b, a)), both, lambda k, a, b: F.coalesce(b, a)))))


def new_rows(batch: DataFrame, existing: DataFrame | None, text_col: str = "text", order: str = "seq") -> DataFrame:
    """Rows whose text hash is neither in the collection nor earlier in the batch."""
    rows = batch.withColumn("content_hash", raw_hash(F.col(text_col)))
    first = F.row_number().over(Window.partitionBy("content_hash").orderBy(order))
    rows = rows.withColumn("__r", first).where("__r = 1").drop("__r")
    return rows if existing is None else rows.join(existing.select("content_hash").distinct(), "content_hash", "left_anti")


def known_hashes(collection: DataFrame) -> DataFrame:
    """The content hashes a collection holds, each once."""
    return collection.select("content_hash").where("content_hash is not null").distinct()


def held(spark: SparkSession, path: str) -> bool:
    """Whether there is a collection at path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drop(spark: SparkSession, path: str) -> bool:
    """Deletes the collection at path; whether there was one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def validate_load(collection: DataFrame, probes: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """What a load has to show: vectors, probes (query_id, query), probes that a search finds something for, and the verdict."""
    found = batch_search(collection, probes, 1, id_col=id_col, vector_col=vector_col).where("score is not null").agg(F.count("*").alias("answered"))
    counts = collection.agg(F.count("*").alias("vectors")).crossJoin(probes.agg(F.count("*").alias("probes"))).crossJoin(found)  # one row by one row
    return counts.withColumn("valid", (F.col("vectors") > 0) & (F.col("answered") == F.col("probes")))


def health(collection: DataFrame, size: int, vector_col: str = "embedding") -> DataFrame:
    """Vectors, those that a search of a size can use, and the status: unhealthy without any, degraded if some are useless."""
    fit = (F.size(vector_col) == size) & ~F.exists(vector_col, lambda x: x.isNull())
    rows = collection.agg(F.count("*").alias("vectors"), F.count_if(fit).alias("usable"))
    return rows.withColumn("status", F.when(F.col("usable") == 0, "unhealthy").when(F.col("usable") < F.col("vectors"), "degraded").otherwise("healthy"))


def exists(collection: DataFrame, content_hash: str) -> DataFrame:
    return collection.where(F.col("content_hash") == content_hash).limit(1)


def create(spark: SparkSession, path: str, schema: str, recreate: bool = False) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite" if recreate else "ignore").parquet(path)


def upsert(spark: SparkSession, batch: DataFrame, path: str, text_col: str = "text", order: str = "seq") -> DataFrame:
    """Appends the new rows with their record ids to the collection at path; returns counts of rows and new rows."""
    try:
        existing = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        existing = None
    rows = new_rows(batch, existing, text_col, order).withColumn("record_id", record_id(F.col(text_col), F.col(order)))
    # What is new is settled in a table first: the append reads that, whatever the collection has become.
    rows = written(rows, "new")
    uploaded = rows.count()
    rows.write.mode("append").parquet(path)
    total = uploaded + (0 if existing is None else existing.count())
    return batch.agg(F.count("*").alias("total")).select("total", F.lit(uploaded).alias("uploaded"), F.lit(total).alias("in_collection"))


def info(collection: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Vectors, their size and whether there are any."""
    return collection.agg(F.count("*").alias("vectors_count"), F.max(F.size(vector_col)).alias("vector_size"), F.count_if(F.col(vector_col).isNull()).alias("without_vector")).withColumn("status", F.when(F.col("vectors_count") > 0, "healthy").otherwise("empty"))


def filtered_count(collection: DataFrame, should: list[Column], needle: Column) -> DataFrame:
    """Rows that meet any of some filters, rows that hold a needle, and whether there are any of either, in the whole table."""
    any_of = should[0]
    for c in should[1:]:
        any_of = any_of | c
    found = collection.agg(F.count_if(any_of).alias("direct"), F.count_if(needle).alias("held"), F.count("*").alias("total"))
    return found.withColumn("exists", (F.col("direct") > 0) | (F.col("held") > 0))


def operation_times(log: DataFrame) -> DataFrame:
    return log.groupBy("operation").agg(F.count("*").alias("n"), F.round(F.sum("seconds") / F.count("*"), 6).alias("avg_seconds"))


@lru_cache(1 << 16)
def _word_hash(w: str) -> int:
    return zlib.crc32(w.encode())


def embed(c: Column, size: int = 384, model: Callable[[list[str]], np.ndarray] | None = None) -> Column:
    """Unit vectors of texts, in batches. Without a model: signed feature hashing of words, the same on every machine."""
    def hashed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, t in zip(out, texts, strict=True):
            h = np.fromiter(map(_word_hash, t.lower().split()), np.uint32)
            row[:] = np.bincount(h % size, np.where(h >> 31, 1.0, -1.0), size)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model or hashed
        for texts in parts:
            yield pd.Series(list(encode([t or "" for t in texts])))

    return run(c)


class ResultCache:
    """A driver's results by query: each for some seconds, the oldest gone beyond a number."""

    def __init__(self, seconds: float = 300, most: int = 1000, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock, self.held = seconds, most, clock, OrderedDict()

    def get(self, key):
        at, value = self.held.get(key, (None, None))
        if at is not None and self.clock() - at > self.seconds:
            del self.held[key]
            return None
        return value

    def put(self, key, value) -> None:
        self.held[key] = (self.clock(), value)
        while len(self.held) > self.most:
            self.held.popitem(last=False)

    def clear(self) -> None:
        self.held.clear()
