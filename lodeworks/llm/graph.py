"""Connected components over a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import drop_path, staged


def forest(pairs) -> list[tuple[int, int]]:
    """Star edges (node, root), root the smallest node, of the components of some pairs."""
    up: dict[int, int] = {}
    for a, b in pairs:
        while (p := up.get(a, a)) != a:
            up[a] = up.get(p, p)
            a = p
        while (p := up.get(b, b)) != b:
            up[b] = up.get(p, p)
            b = p
        if a < b:
            up[b] = a
        elif b < a:
            up[a] = b
    out = []
    for x in up:
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        out.append((x, r))
    return out


def spread(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of the components of nodes 0 to n - 1 after links a to b join those that labels has: the smallest node of each."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stars = forest(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if stars:
            a, b = zip(*stars, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame, tag: str = "components") -> tuple[DataFrame, str]:
    """(a, b) links to (a, b) stars: every node but the smallest of its component, with that smallest node.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014):
    each is one minimum by node and one join, the join's hot nodes are left to adaptive skew splitting, and a round's
    edges replace the last round's as a written table. Ends when a round changes nothing. Nothing comes to the driver
    but two numbers a round. Nodes without links aren't returned. Returns the table and its path.
    """
    spark = edges.sparkSession
    clean = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, path = staged(clean.distinct().mapInArrow(_local_stars, "a long, b long").distinct(), tag)
    seen = None
    while True:
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == seen or sign[0] == 0:
            return now, path
        seen = sign
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, mid = staged(large, tag)
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        moved = large.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small, new = staged(moved.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), tag)
        drop_path(spark, path)
        drop_path(spark, mid)
        now, path = small, new
