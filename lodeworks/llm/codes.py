"""Vector code compression: product codes whose codebooks are fitted in integers, with kd-trees sent to all tasks each round."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.common import drop_path, release, staged
from lodeworks.llm.whitening import integers, usable

#: Components become floor(SCALE * component), held to HELD either way: squared distances then fit a long.
SCALE, HELD = 1024, 1 << 24
#: Entries of a leaf, and parts that are searched together.
LEAF, TOGETHER = 16, 8192


class KdTree:
    """Entries of a codebook, halved at the median of the widest dimension down to small leaves, each node with its box."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.low, self.high, self.axis, self.cut, self.left, self.right, self.leaf = [], [], [], [], [], [], []
        self._grow(np.arange(len(entries)))

    def _grow(self, own: np.ndarray) -> int:
        x, node = self.entries[own], len(self.low)
        self.low.append(x.min(axis=0))
        self.high.append(x.max(axis=0))
        wide = self.high[node] - self.low[node]
        for held in (self.axis, self.cut, self.left, self.right):
            held.append(-1)
        self.leaf.append(own)
        if len(own) > LEAF and wide.size and wide.max() > 0:
            axis = int(wide.argmax())
            order = np.argsort(x[:, axis], kind="stable")
            half = len(own) // 2
            self.axis[node], self.cut[node], self.leaf[node] = axis, x[order[half - 1], axis], None
            self.left[node] = self._grow(np.sort(own[order[:half]]))  # a leaf's entries stay in order of index
            self.right[node] = self._grow(np.sort(own[order[half:]]))
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry and its squared distance; of equally near ones the lowest index.

        All rows first take the best of their own leaf. Then the tree is walked once: a node keeps the rows that its box
        isn't farther from than their best so far, equally far ones included, since a lower index may be in there.
        """
        best, at = np.full(len(x), np.iinfo(np.int64).max, np.int64), np.full(len(x), len(self.entries), np.int64)
        m = max(1, x.shape[1])
        reach = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        kind = np.float64 if m * reach * reach < 1 << 53 else np.int64  # either is exact
        x, entries = x.astype(kind), self.entries.astype(kind)
        low, high = np.array(self.low, kind), np.array(self.high, kind)

        def scan(rows: np.ndarray, own: np.ndarray) -> None:
            y, w = x[rows], entries[own]
            if kind is np.float64:
                d = (y * y).sum(axis=1)[:, None] - 2 * (y @ w.T) + (w * w).sum(axis=1)
            else:
                d = ((y[:, None, :] - w[None, :, :]) ** 2).sum(axis=2)
            j = d.argmin(axis=1)  # the first of equals
            d, e = d[np.arange(len(rows)), j].astype(np.int64), own[j]
            better = (d < best[rows]) | ((d == best[rows]) & (e < at[rows]))
            best[rows[better]], at[rows[better]] = d[better], e[better]

        home = np.zeros(len(x), np.int64)
        left, right, axis, cut = (np.array(v) for v in (self.left, self.right, self.axis, self.cut))
        while (inner := left[home] >= 0).any():
            rows = np.flatnonzero(inner)
            node = home[rows]
            home[rows] = np.where(x[rows, axis[node]] <= cut[node], left[node], right[node])
        for node in np.unique(home).tolist():
            scan(np.flatnonzero(home == node), self.leaf[node])
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            gap = np.maximum(low[node] - x[rows], 0) + np.maximum(x[rows] - high[node], 0)
            rows = rows[(gap * gap).sum(axis=1) <= best[rows]]
            if not len(rows):
                continue
            if self.leaf[node] is None:
                todo += [(self.right[node], rows), (self.left[node], rows)]
            elif len(rows := rows[home[rows] != node]):
                scan(rows, self.leaf[node])
        return at, best


def cuts(dims: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of each part; where the dimensions don't divide, the first parts are longer by one."""
    ends = np.cumsum([dims // parts + (k < dims % parts) for k in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _stacked(batch: pa.RecordBatch, at: int, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """Some vectors at a time, as rows of a matrix of integers, and where they begin."""
    for i in range(0, batch.num_rows, TOGETHER):
        part = batch.column(at).slice(i, TOGETHER)
        yield i, part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), dims)


def _sums(trees, bounds: list[tuple[int, int]], dims: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's numbers and sums of the parts that each entry is nearest to: no more rows than there are entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = max(e - b for b, e in bounds)
        n, sums = np.zeros((len(bounds), size), np.int64), np.zeros((len(bounds), size, wide), np.int64)
        for batch in batches:
            for _, x in _stacked(batch, 0, dims):
                for p, (b, e) in enumerate(bounds):
                    near, _ = trees.value[p].nearest(x[:, b:e])
                    n[p] += np.bincount(near, minlength=size)
                    order = np.argsort(near, kind="stable")
                    used, first = np.unique(near[order], return_index=True)
                    sums[p, used, : e - b] += np.add.reduceat(x[order, b:e], first, axis=0)
        p, k = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p * size + k), pa.array(n[p, k]), *(pa.array(sums[p, k, c]) for c in range(wide))], ["entry", "n", *(f"s{c}" for c in range(wide))])
        release()

    return run


def _codes(trees, bounds: list[tuple[int, int]], dims: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in _stacked(batch, 2, dims):
                found = [trees.value[p].nearest(x[:, b:e]) for p, (b, e) in enumerate(bounds)]
                codes = np.stack([f[0] for f in found], axis=1)
                error = np.sum([f[1] for f in found], axis=0)
                text = [r.tobytes().hex() for r in codes.astype(">u1" if size <= 256 else ">u2")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(x)), batch.column(1).slice(i, len(x)), pa.array(text), pa.array(error)], ["id", "label", "code", "error"])
        release()

    return run


class Codebooks:
    """Codebooks of vectors of one length: started from those of the smallest ids, moved to floored means for some rounds."""

    def __init__(self, rows: DataFrame, dims: int, parts: int, size: int, rounds: int):
        self.bounds, self.dims = cuts(dims, parts), dims
        first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(size).select("x").collect()
        start = np.array([r.x for r in first], np.int64).reshape(len(first), dims)
        self.books = [start[:, b:e].copy() for b, e in self.bounds]
        self.size = len(first)
        spark = rows.sparkSession
        wide = max(e - b for b, e in self.bounds)
        names = [f"s{c}" for c in range(wide)]
        for _ in range(rounds if wide else 0):
            trees = self.send(spark)
            each = rows.select("x").mapInArrow(_sums(trees, self.bounds, dims, self.size), "entry long, n long, " + ", ".join(f"{c} long" for c in names))
            # One row per entry.
            for r in each.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).collect():
                p, k = divmod(r.entry, self.size)
                b, e = self.bounds[p]
                self.books[p][k] = [r[c] // r.n for c in names[: e - b]]
            trees.unpersist()

    def send(self, spark):
        """The kd-trees of all codebooks, to all executors; their size is that of the codebooks, whatever the table's."""
        return spark.sparkContext.broadcast([KdTree(b) for b in self.books])

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for row in b.tolist() for v in row).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The integers that a code stands for."""
        step = len(code) // len(self.books)
        return [v for p, b in enumerate(self.books) for v in b[int(code[p * step : (p + 1) * step], 16)].tolist()]


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, size: int = 256, rounds: int = 4) -> DataFrame:
    """One row per vector: id, code (hex, two digits for each part), error, label_error and codebooks_sha256.

    Components become integers, vectors are cut into consecutive parts, and each part's codebook starts from the vectors
    of the smallest ids. In each round every part goes to its nearest entry (squared Euclidean distance, ties to the lower
    index) and entries move to the floored means of their parts; unused ones stay. All sums are of integers, so that
    neither the number of tasks nor their order matters. Trees of a codebook's size go out; a task sends back one row for
    each entry it used.

    Vectors that are null or hold null or non-finite components give no rows. Those of each length have codebooks of
    their own; where the dimensions don't divide by the parts, the first parts are longer by one, and empty vectors get
    code 0 without error. Null ids come last when codebooks start, rows with one id go by their vectors, and repeated rows
    all give rows; fewer vectors than entries give that many entries. Components beyond 2**24 / 1024 are held there. Null
    labels are one label. Codebooks of more than 256 entries take four digits a part. Other columns are ignored; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    rows = vectors.where(usable(v)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), integers(v, SCALE, HELD).cast("array<int>").alias("x"), F.size(v).alias("dims"))
    rows, rows_at = staged(rows, "parts")
    kind = vectors.schema[label_col].dataType
    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("label", kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = spark.createDataFrame([], schema).withColumn("codebooks_sha256", F.lit(""))
    for (dims,) in sorted(rows.select("dims").distinct().collect()):  # one row per length
        own = rows.where(F.col("dims") == dims)
        books = Codebooks(own, dims, parts, size, rounds)
        made = own.select("id", "label", "x").mapInArrow(_codes(books.send(spark), books.bounds, dims, size), schema)
        coded = coded.unionAll(made.withColumn("codebooks_sha256", F.lit(books.digest())))
    coded, _ = staged(coded, "codes")
    drop_path(spark, rows_at)
    # As a table of known size, so that Spark broadcasts it below its threshold and splits a hot label above.
    sums, _ = staged(coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error"), "label-errors")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """The rounds, written one behind the other."""
    steps = []
    for r in range(5):
        steps.append(f"""n{r} AS (SELECT rid, p.part, (min(((list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x))::BIGINT) * 256 + c.entry)) AS best FROM p JOIN c{r} AS c ON p.part = c.part GROUP BY rid, p.part)""")
        if r < 4:
            steps.append(f"""s{r} AS (SELECT part, entry, pos, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT p.part, n{r}.best % 256 AS entry, unnest(p.x)::BIGINT AS v, unnest(range(16)) AS pos FROM p JOIN n{r} USING (rid, part)) GROUP BY part, entry, pos)""")
            steps.append(f"""m{r} AS (SELECT part, entry, list(((s - ((s % n + n) % n)) // n)::DOUBLE ORDER BY pos) AS x FROM s{r} GROUP BY part, entry)""")
            steps.append(f"""c{r + 1} AS (SELECT c{r}.part, c{r}.entry, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} ON c{r}.part = m{r}.part AND c{r}.entry = m{r}.entry)""")
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT rid, k AS part, x[16 * k + 1:16 * k + 16] AS x FROM (SELECT rid, x, unnest(range(4)) AS k FROM v)),
c0 AS (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= 256),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS v, unnest(range(16)) AS pos FROM c4)),
e AS (SELECT rid, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM n4 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN e USING (rid), h
"""


ORACLE = _oracle()
