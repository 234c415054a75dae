"""Embedding near-duplicates with an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import drop_path, partitions, release, staged
from lodeworks.llm.graph import components, spread

#: Bounds of the sample that codebooks and the number of visited cells are fitted on: rows, and bytes of its vectors.
SAMPLE, SAMPLE_BYTES = 20_000, 64_000_000
#: Vectors a cell is home to about, and sampled vectors a codeword stands for at least.
PER_CELL, PER_WORD = 200, 4
#: Vectors of a cell that meet in one task; a larger cell is dealt into parts, and each two of them meet.
PART = 4096
#: Visits that the fit tries; a grid on which so many don't give the target recall is searched exactly.
MOST = 256


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ words.T - 0.5 * (words**2).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


class MultiIndex:
    """Two codebooks, one for each half of the unit vectors, and how many cells of their product a vector visits.

    Two vectors meet if their visits have a cell in common. The number of visits is the least that gives the target recall
    for partners at exactly the threshold, in random directions from sampled vectors. With a target of 1, or where MOST
    visits don't give it, a vector visits every cell that can be home to a partner instead, and no pair is lost: a point
    of a codeword's region is at least as far away as the plane that parts it from the nearest codeword's.
    """

    def __init__(self, sample: np.ndarray, total: int, threshold: float, recall: float):
        k = int(min(max(2, round((total / PER_CELL) ** 0.5)), max(2, len(sample) // PER_WORD), len(sample)))
        half = sample.shape[1] // 2
        self.half, self.k = half, k
        self.words = (kmeans(sample[:, :half], k), kmeans(sample[:, half:], k))
        self.reach = (max(0.0, 2 - 2 * threshold)) ** 0.5 + 1e-9
        self.exact, self.visits = recall >= 1, 1
        if self.exact:
            return
        rng = np.random.default_rng(11)
        a = sample[rng.permutation(len(sample))[:4000]]
        noise = rng.standard_normal(a.shape)
        noise -= (noise * a).sum(1, keepdims=True) * a
        size = np.linalg.norm(noise, axis=1, keepdims=True)
        b = threshold * a + (1 - threshold**2) ** 0.5 * noise / np.maximum(size, 1e-300)
        most = min(16, k * k)
        while True:  # until the target recall
            need = self._meeting(self.cells(a, most), self.cells(b, most))
            if most >= min(MOST, k * k) or (need <= most).mean() >= recall:
                break
            most = min(2 * most, k * k)
        self.exact = most < k * k and (need <= most).mean() < recall
        self.visits = int(min(most, np.quantile(need, recall, method="higher")))

    @staticmethod
    def _meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of visits from which on the lists of a row in a and in b have a cell in common."""
        n = a.shape[1]
        reach = np.maximum(np.arange(n)[:, None], np.arange(n)[None, :]) + 1
        out, step = np.empty(len(a), np.int64), max(1, 4_000_000 // (n * n))
        for i in range(0, len(a), step):
            same = a[i : i + step, :, None] == b[i : i + step, None, :]
            out[i : i + step] = np.where(same, reach, n + 1).reshape(len(same), -1).min(axis=1)
        return out

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(((w**2).sum(1) - 2 * (part @ w.T)) for w, part in zip(self.words, (x[:, : self.half], x[:, self.half :]), strict=True))

    def cells(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The first cells of each vector's multi-sequence traversal: in the order of the sum of both halves' distances.

        The cell of the r-th and s-th nearest codewords has at least r * s cells no farther, so that only those with
        r * s within the number of visits can be among the first.
        """
        visits = visits or self.visits
        d1, d2 = self.distances(x)
        o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
        near = min(visits, self.k)
        r, s = np.divmod(np.arange(near * near), near)
        can = (r + 1) * (s + 1) <= visits
        r, s = r[can], s[can]
        sums = np.take_along_axis(d1, o1, 1)[:, r] + np.take_along_axis(d2, o2, 1)[:, s]
        first = np.argsort(sums, axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(o1, r[first], 1) * self.k + np.take_along_axis(o2, s[first], 1)

    def reachable(self, x: np.ndarray) -> list[np.ndarray]:
        """All cells that can be home to a vector within reach of each one, its own included."""
        far = []
        for w, d in zip(self.words, self.distances(x), strict=True):
            home = d.argmin(axis=1)
            apart = np.linalg.norm(w[home][:, None, :] - w[None], axis=2)
            gap = d - d[np.arange(len(d)), home][:, None]
            far.append(np.where(apart > 0, gap / np.where(apart > 0, 2 * apart, 1), 0.0))
        out = []
        for a, b in zip(*far, strict=True):
            i, j = np.flatnonzero(a <= self.reach), np.flatnonzero(b <= self.reach)
            r, s = np.nonzero(a[i][:, None] ** 2 + b[j][None] ** 2 <= self.reach**2)
            out.append(i[r] * self.k + j[s])
        return out

    def visited(self, x: np.ndarray) -> list[np.ndarray]:
        """Each vector's cells, in order of number."""
        return [np.sort(c).astype("<i4") for c in (self.reachable(x) if self.exact else self.cells(x))]


def packed(x: np.ndarray) -> bytes:
    """A vector's components in single precision if that loses nothing, else in double precision; no -0.0.

    The largest component is scaled to between a half and one by a power of two, which keeps every digit and lets neither
    tiny nor huge vectors leave the range of numbers when they are squared.
    """
    x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) + 0.0
    with np.errstate(under="ignore"):
        short = x.astype("<f4")
    return short.tobytes() if (short == x).all() else x.astype("<f8").tobytes()


def unit(raw: list[bytes], dims: int) -> np.ndarray:
    """Unit vectors from packed ones of so many dimensions."""
    x = np.empty((len(raw), dims))
    for short in (True, False):
        at = [i for i, r in enumerate(raw) if (len(r) == 4 * dims) == short]
        if at:
            x[at] = np.frombuffer(b"".join([raw[i] for i in at]), "<f4" if short else "<f8").reshape(len(at), dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, dims = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = None
            if i is not None and v.is_valid and not v.values.null_count:
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype="<f8")
                x = x if len(x) and np.isfinite(x).all() and x.any() else None
            out.append(None if x is None else packed(x))
            dims.append(None if x is None else len(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], ["id", "raw", "dims"])
    release()


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first cell of each row of a, which is sorted, that the row of b has too; -1 if there is none.

    Shorter rows are filled up with -1 in front.
    """
    out = np.full(len(a), -1, a.dtype)
    for v in range(a.shape[1]):
        open_ = np.flatnonzero(out < 0)
        here = (b[open_] == a[open_, v][:, None]).any(axis=1) & (a[open_, v] >= 0)
        out[open_[here]] = a[open_[here], v]
    return out


def _verify(threshold: float, dims: int):
    """Rows sorted by block: all pairs of a block, or of its two parts, are verified by cosine.

    A pair counts in the first cell that both its vectors visit, so that no pair counts twice.
    """
    names = ["id", "links", "other"]

    def meet(cell: int, two: bool, rows: list) -> pa.RecordBatch:
        ids, n = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        part, x = np.array([r[0] for r in rows]), unit([r[3] for r in rows], dims)
        lists = [np.frombuffer(r[4], "<i4") for r in rows]
        cells = np.full((len(rows), max(map(len, lists))), -1, np.int32)
        for k, c in enumerate(lists):
            cells[k, cells.shape[1] - len(c) :] = c
        links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i in range(0, len(ids), 512):
            a, b = np.nonzero(x[i : i + 512] @ x[i:].T >= threshold)
            own = a < b
            a, b = a[own] + i, b[own] + i
            if two:
                own = part[a] != part[b]
                a, b = a[own], b[own]
            if not len(a):
                continue
            own = _first_shared(cells[a], cells[b]) == cell
            a, b = a[own], b[own]
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            labels = spread(labels, a, b)
        found = np.flatnonzero(links)
        far = np.flatnonzero(labels != np.arange(len(ids)))
        other = pa.array([None] * len(found) + ids[labels[far]].tolist(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[found], ids[far]])), pa.array(np.concatenate([links[found], np.zeros(len(far), np.int64)])), other], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for batch in batches:
            for *key, part, i, n, raw, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != block:
                    if len(rows) > 1:
                        yield meet(block[0], block[1] != block[2], rows)
                    block, rows = key, []
                rows.append((part, i, n, raw, cells))
        if len(rows) > 1:
            yield meet(block[0], block[1] != block[2], rows)
        release()

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = 0.995) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept (whether it is the first of its component).

    Equal vectors form one class first. Each class visits the first cells of its multi-sequence traversal, nearest first
    and as many as give the target recall for partners at exactly the threshold; classes with a cell in common meet there,
    and all found pairs are verified by cosine in double precision: none below the threshold links. A cell of more than
    PART classes is dealt into parts, each two of which meet in a task of their own. Only counts and a spanning forest
    leave a task, not its pairs. recall=1 visits every cell that can hold a partner: slower, and no pair is lost.

    Vectors that are null, empty, zero, or have null or non-finite components, and rows with a null id, link with nothing
    and are their own component. Vectors of each length have an index of their own; those of one component link by sign.
    Repeated rows count as vectors of their own. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, rows_at = staged(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(_valid, "id long, raw binary, dims int").withColumn("key", F.md5("raw")), "vectors")
    classes = rows.where("raw is not null").groupBy("dims", "key").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.any_value("raw").alias("raw"))
    classes = classes.withColumn("node", F.monotonically_increasing_id())  # ids may repeat; settled as the table is written
    classes, classes_at = staged(classes, "classes")
    keys, _ = staged(rows.select("id", "key", F.col("dims").alias("d")), "keys")
    drop_path(spark, rows_at)
    # One row per length.
    sizes = sorted((r.dims, r["count"]) for r in classes.groupBy("dims").count().collect())
    own = classes.where("false").select("dims", F.col("key").alias("k"), F.col("n").alias("n_links"), F.col("first").alias("component_id"))
    for dims, total in sizes:
        own = own.unionAll(_linked(classes.where(F.col("dims") == dims), dims, total, threshold, recall))
    drop_path(spark, classes_at)
    out = keys.join(own, (F.col("key") == F.col("k")) & (F.col("d") == F.col("dims")), "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _linked(classes: DataFrame, dims: int, total: int, threshold: float, recall: float) -> DataFrame:
    """(dims, k, n_links, component_id) of classes of equal vectors of one length; written."""
    spark = classes.sparkSession
    if dims == 1:
        signed = classes.withColumn("sign", F.substring(F.hex("raw"), -2, 2) >= "80")
        groups = signed.groupBy("sign").agg(F.sum("n").alias("all"), F.min("first").alias("component_id"))
        own = signed.join(groups, "sign").select("dims", F.col("key").alias("k"), (F.col("all") - 1).alias("n_links"), "component_id")
    elif total > 1:
        sample = classes.orderBy("key").limit(max(256, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))).select("raw").collect()
        index = MultiIndex(unit([r.raw for r in sample], dims), total, threshold, recall)
        place = lambda batches: _place(index, dims, batches)
        placed, placed_at = staged(classes.select(F.col("node").alias("id"), "n", "raw").mapInArrow(place, "id long, n long, raw binary, cells binary, visits array<int>"), "placed")
        # Cells with more classes than a part holds; as a table of known size Spark broadcasts them below its threshold.
        large = placed.select(F.explode("visits").alias("cell")).groupBy("cell").count().where(F.col("count") > PART)
        large = large.select(F.col("cell").alias("large_cell"), F.ceil(F.col("count") / PART).cast("int").alias("parts"))
        large, large_at = staged(large, "large")
        visits = placed.select("id", "n", "raw", "cells", F.explode("visits").alias("cell")).join(large, F.col("cell") == F.col("large_cell"), "left")
        visits = visits.withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))
        others = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        dealt = visits.select("cell", "part", "id", "n", "raw", "cells", F.explode(others).alias("with"))
        dealt = dealt.select("cell", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "id", "n", "raw", "cells")
        dealt = dealt.repartition(partitions(spark), "cell", "low", "high").sortWithinPartitions("cell", "low", "high")
        found, found_at = staged(dealt.mapInArrow(_verify(threshold, dims), "id long, links long, other long"), "found")
        stars, stars_at = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
        links = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
        own = classes.join(links, F.col("node") == F.col("id"), "left").join(stars, F.col("node") == F.col("a"), "left")
        own, own_at = staged(own.select("dims", F.col("key").alias("k"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "first", F.coalesce("b", "node").alias("root")), "own")
        # The smallest id of each component of more classes than one.
        low = own.groupBy("root").agg(F.min("first").alias("low"), F.count("*").alias("size")).where("size > 1").select(F.col("root").alias("of"), "low")
        own = own.join(low, F.col("root") == F.col("of"), "left").select("dims", "k", "n_links", F.coalesce("low", "first").alias("component_id"))
        own, _ = staged(own, "linked")
        for path in (placed_at, large_at, found_at, stars_at, own_at):
            drop_path(spark, path)
        return own
    else:
        own = classes.select("dims", F.col("key").alias("k"), (F.col("n") - 1).alias("n_links"), F.col("first").alias("component_id"))
    return staged(own, "linked")[0]


def _place(index: MultiIndex, dims: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes with their visited cells, in order of number: packed, and as a list."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            cells = index.visited(unit(part.column(2).to_pylist(), dims))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in cells], pa.binary()), pa.array(cells, pa.list_(pa.int32()))], ["id", "n", "raw", "cells", "visits"])
    release()


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""
