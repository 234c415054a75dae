"""Embeddings of texts fitted on a corpus: weighted word counts, projected on their leading directions by randomised range finding.

The directions are those of the largest singular values of the matrix of all texts (rows) by features (columns). A random
test matrix is sent through the products of its blocks twice: once to find a basis of the range, once to decompose in it.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed words: what the driver, a worker and a broadcast hold is this many rows of size + SPARE numbers, whatever the corpus.
FEATURES = 1 << 16
#: Directions that are followed beyond those asked for.
SPARE = 16
#: Tasks of a pass at most: each sends one partial sum, so that these don't grow with the corpus.
TASKS = 4_096
#: Sums are of integers, in units of 1 / SCALE for each text and feature, so that no order of tasks or texts shows in them.
SCALE = float(1 << 24)
#: Entries of a block that are worked on at once.
BLOCK = 1 << 14

_WORD = re.compile(r"\w+")


def feature(word: str, features: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % features


def counted(c: Column, features: int = FEATURES) -> Column:
    """A text's lower-cased words by their hashes, ascending, with how often they occur. A null text has none."""

    @F.arrow_udf("ids array<int>, counts array<int>")
    def run(texts: pa.Array) -> pa.Array:
        ids, counts, at = array("i"), array("i"), array("i", [0])
        for t in texts:
            own = Counter()
            for w, n in Counter(_WORD.findall((t.as_py() or "").lower())).items():
                own[feature(w, features)] += n
            order = sorted(own)
            ids.extend(order)
            counts.extend(own[i] for i in order)
            at.append(len(ids))
        starts = pa.array(np.array(at, np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(starts, pa.array(np.array(v, np.int32))) for v in (ids, counts)], ["ids", "counts"])

    return run(c)


@dataclass
class LatentModel:
    """Weights of features, directions (features by size, columns of zeros beyond the corpus' rank) and their singular values."""

    weights: np.ndarray
    directions: np.ndarray
    values: np.ndarray


def weighted(counts: np.ndarray, ids: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Entries of texts that begin at starts: damped counts by weight, each text of length one."""
    x = (1 + np.log(counts)) * weights[ids]
    norms = np.sqrt(np.add.reduceat(x * x, starts))
    return x / np.repeat(np.where(norms > 0, norms, 1), np.diff(np.append(starts, len(x))))


def _blocks(column: pa.StructArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with words in blocks: their places in the batch, starts, ids and counts of entries. No text is cut."""
    ids, counts = column.field("ids"), column.field("counts")
    at = ids.offsets.to_numpy().astype(np.int64)
    ids, counts = ids.values.to_numpy(), counts.values.to_numpy()
    rows = np.flatnonzero(np.diff(at))
    while len(rows):
        n = max(1, int(np.searchsorted(at[rows + 1] - at[rows[0]], BLOCK, "right")))
        own, rows = rows[:n], rows[n:]
        lo, hi = at[own[0]], at[own[-1] + 1]  # rows between these without words have no entries
        yield own, at[own] - lo, ids[lo:hi], counts[lo:hi]


def _frequencies(rows: DataFrame, features: int) -> tuple[int, np.ndarray]:
    """Texts with words, and in how many of them each feature is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(features + 1, np.int64), 0
        for batch in batches:
            for own, _, ids, _ in _blocks(batch.column(0)):
                n[:features] += np.bincount(ids, minlength=features)
                total += len(own)
        n[features] = total
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n[found])], ["feature", "n"])

    found = rows.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(features + 1, np.int64)
    n[found["feature"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return int(n[features]), n[:features]


def _product(rows: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The matrix' transpose times itself times a basis. Tasks sum over their texts, sums meet by feature."""
    features, size = basis.shape
    sent = rows.sparkSession.sparkContext.broadcast((weights, basis))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, basis = sent.value
        total, touched = np.zeros((features, size)), np.zeros(features, bool)  # whole numbers of less than 2 ** 53
        for batch in batches:
            for _, starts, ids, counts in _blocks(batch.column(0)):
                x = weighted(counts, ids, starts, weights)
                for own, y in zip(np.split(ids, starts[1:]), np.split(x, starts[1:]), strict=True):  # a text's features are all different
                    parts = np.multiply.outer(y, (y @ basis[own]) * SCALE)
                    total[own] += np.rint(parts, out=parts)
                touched[ids] = True
        found = np.flatnonzero(touched)
        for k in range(0, len(found), 1_024):
            own = found[k : k + 1_024]
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * size, pa.int32()), pa.array(total[own].astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), sums], ["feature", "sums"])

    sums = F.array(*(F.sum(F.col("sums")[k]) for k in range(size))).alias("sums")
    got = rows.mapInArrow(multiply, "feature long, sums array<long>").groupBy("feature").agg(sums).toArrow()
    sent.destroy()
    out = np.zeros((features, size))
    if got.num_rows:
        flat = got.column("sums").combine_chunks()
        out[got.column("feature").to_numpy()] = np.asarray(flat.flatten()).reshape(-1, size) / SCALE
    return out


def fit(rows: DataFrame, column: str = "features", size: int = 64, features: int = FEATURES, passes: int = 2, seed: int = 1) -> LatentModel:
    """Directions of a table's counted texts, all of which are counted: one pass for the weights, two for the directions.

    The table is read three times, so write it first; where singular values fall slowly, more passes come closer to the
    leading directions. Reruns agree. Without texts every direction is zero.
    """
    own = rows.select(F.col(column).alias("features")).where("features IS NOT NULL")
    own = own.coalesce(TASKS)
    texts, n = _frequencies(own, features)
    weights = np.where(n > 0, np.log1p(texts / np.maximum(n, 1)), 0.0)
    if not texts:
        return LatentModel(weights, np.zeros((features, size), np.float32), np.zeros(size))
    test = np.random.default_rng(seed).standard_normal((features, min(features, size + SPARE)))
    basis = test
    for _ in range(passes - 1):
        basis, _ = np.linalg.qr(_product(own, weights, basis))
    inner = basis.T @ _product(own, weights, basis)
    squares, turns = np.linalg.eigh((inner + inner.T) / 2)
    squares, turns = squares[::-1][:size], turns[:, ::-1][:, :size]
    real = squares > 1e-6 * squares[0]
    directions = basis @ turns * real
    directions *= np.where(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])] < 0, -1, 1)
    lack = size - directions.shape[1]
    return LatentModel(weights, np.pad(directions, ((0, 0), (0, lack))).astype(np.float32), np.pad(np.sqrt(np.maximum(squares * real, 0)), (0, lack)))


def embed(c: Column, model: LatentModel, sent=None) -> Column:
    """Unit vectors of counted texts; zeros for those without a word that the corpus has. sent is the model's broadcast, if it is used often."""
    held = sent or model

    def project(features: pa.Array) -> pa.Array:
        m = held.value if hasattr(held, "value") else held
        out = np.zeros((len(features), m.directions.shape[1]), np.float32)
        for rows, starts, ids, counts in _blocks(features):
            x = weighted(counts, ids, starts, m.weights)
            for row, own, y in zip(rows, np.split(ids, starts[1:]), np.split(x, starts[1:]), strict=True):
                out[row] = y @ m.directions[own].astype(np.float64)
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        out /= np.where(lengths > 1e-9, lengths, 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))

    return F.arrow_udf(project, "array<float>")(c)
