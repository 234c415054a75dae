"""Embedding whitening: covariance by one SQL aggregation over all pairs of dimensions, decomposed with LAPACK."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.common import drop_path, staged

#: Entries become floor(SCALE * entry); beyond HELD either way they are held there, so that sums stay in range.
SCALE, HELD = 256, 1 << 31
OUT = T.StructType(
    [
        T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
        T.StructField("deviation_exact", T.DecimalType(38, 0)),
    ]
)


def usable(v: Column) -> Column:
    """Whether a vector is there and all its components are numbers of finite size."""
    far = float("inf")
    return F.coalesce(F.forall(v, lambda c: F.coalesce((c.cast("double") > -far) & (c.cast("double") < far), F.lit(False))), F.lit(False))


def integers(v: Column, scale: int, held: int) -> Column:
    """floor(scale * c) of each component c in double precision, held to the range of held either way."""
    return F.transform(v, lambda c: F.floor(F.least(F.greatest(c.cast("double") * float(scale), F.lit(float(-held))), F.lit(float(held)))))


def _literal(values) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" if isinstance(v, float) else f"{v}L" for v in values) + ")"


def _dot(mean: np.ndarray, weights: np.ndarray) -> str:
    """SQL of the sum over dimensions of (x - mean) * weight, in the order of dimensions."""
    return f"aggregate(zip_with(zip_with(x, {_literal(mean.tolist())}, (a, m) -> a - m), {_literal(weights.tolist())}, (y, w) -> y * w), 0D, (s, t) -> s + t)"


def covariance(fit: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance with divisor n of the vectors x of fit: the upper triangle's centred products, summed in one aggregation.

    Row k of the triangle and row dims - 1 - k have dims + 1 products together. They are one group of the aggregation, with
    a sum for each place: as many expressions as there are dimensions, where one for each pair would be too large to compile.
    """
    dims = len(mean)
    last, half = dims - 1, (dims + 1) // 2
    centred = fit.selectExpr(f"zip_with(x, {_literal(mean.tolist())}, (a, m) -> a - m) AS y").select("y", F.explode(F.sequence(F.lit(0), F.lit(half - 1))).alias("k"))
    upper, lower = [f"y[k] * y[k + {t}]" for t in range(dims)], [f"y[{last} - k] * y[{t}]" for t in range(dims)]
    sums = [upper[0], *(f"IF(k + {t} <= {last}, {upper[t]}, {lower[t - 1]})" for t in range(1, dims)), lower[last]]
    out = np.empty((dims, dims))
    for k, *row in centred.groupBy("k").agg(*(F.expr(f"sum({s})").alias(f"s{t}") for t, s in enumerate(sums))).collect():
        for t, s in enumerate(row):
            i, j = (k, k + t) if k + t <= last else (last - k, t - 1)
            out[i, j] = out[j, i] = s / n
    return out


class Whitening:
    """What the fit list of vectors of one length gives: n, sums, components by falling eigenvalue, and how white it gets.

    The list is read three times: sums and ranges, products of pairs, covariance of what has been whitened.
    """

    def __init__(self, fit: DataFrame, dims: int, components: int):
        parts = [f"{f}(x[{i}]) AS {f}{i}" for i in range(dims) for f in ("sum", "min", "max")]
        got = fit.selectExpr("count(*) AS n", *parts).first()
        self.n, self.sums = got["n"], [got[f"sum{i}"] for i in range(dims)]
        # No vector's deviation is above this, as each one's value is in the list.
        self.bound = sum(max(self.n * got[f"max{i}"] - s, s - self.n * got[f"min{i}"]) ** 2 for i, s in enumerate(self.sums))
        self.mean = np.array([s / self.n for s in self.sums])
        cov = covariance(fit, self.mean, self.n)
        values, vectors = np.linalg.eigh(cov)
        take = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = values[take], vectors[:, take]
        self.trace = float(np.trace(cov))
        self.there = self.values > dims * np.finfo(float).eps * max(float(values.max()), 0.0)
        ways = [k for k in range(len(take)) if self.there[k]]
        self.error = None
        if ways:
            white = fit.selectExpr(*(f"{self.whitened(k)} AS w{k}" for k in ways))
            pairs = [(a, b) for a in ways for b in ways if a <= b]
            found = white.selectExpr(*(f"covar_pop(w{a}, w{b}) AS c{a}_{b}" for a, b in pairs)).first()
            self.error = max(abs(v - (a == b)) for (a, b), v in zip(pairs, found, strict=True))

    def whitened(self, k: int) -> str:
        return _dot(self.mean, self.vectors[:, k] / self.values[k] ** 0.5) if self.there[k] else "CAST(NULL AS DOUBLE)"

    def deviation(self) -> str:
        """SQL of the sum over dimensions of (n * x - sum)^2 as a decimal: worked out as a long where that holds all of them."""
        kind, add, times = ("BIGINT", "s + d * d", "a * {n}L - m") if self.bound < 1 << 63 else ("DECIMAL(38,0)", "CAST(try_add(s, try_multiply(d, d)) AS DECIMAL(38,0))", "CAST(a AS DECIMAL(20,0)) * {n}L - m")
        sums = "array(" + ", ".join(f"CAST({s} AS {'BIGINT' if kind == 'BIGINT' else 'DECIMAL(38,0)'})" for s in self.sums) + ")"
        return f"CAST(aggregate(zip_with(x, {sums}, (a, m) -> {times.format(n=self.n)}), CAST(0 AS {kind}), (s, d) -> {add}) AS DECIMAL(38,0))"

    def row(self) -> str:
        """SQL of a vector's array of output structs, one for each component."""
        each = []
        for k, value in enumerate(self.values.tolist()):
            explained = f"{value / self.trace!r}D" if self.trace > 0 else "CAST(NULL AS DOUBLE)"
            error = "CAST(NULL AS DOUBLE)" if self.error is None else f"{float(self.error)!r}D"
            each.append(f"named_struct('component', {k + 1}, 'n', {self.n}L, 'deviation', try_cast(d AS BIGINT), 'whitened', {self.whitened(k)}, 'explained', {explained}, 'identity_error', {error}, 'deviation_exact', d)")
        return f"array({', '.join(each)})"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """One row per vector and component: its place along the component in units of the component's own deviation.

    Entries c become x = floor(256 * c). Sums, covariance and components are those of the fit list: each distinct x once.
    The covariance is centred and summed for all pairs of dimensions in one aggregation, and decomposed by LAPACK's
    symmetric solver; components are numbered from 1 by falling eigenvalue. identity_error is measured on the fit list:
    the largest entry of the whitened vectors' covariance minus the identity, over components that have any variance.

    Vectors that are null or hold null or non-finite entries give no rows, nor do empty ones. Vectors of each length are
    a list of their own. Rows with a null id and repeated rows give rows of their own. A component without variance (equal
    vectors, or fewer different ones than components) has a null whitened value; explained and identity_error are null
    where no component has any. Entries beyond 2**31 / 256 are held there. deviation is null where a long can't hold it;
    deviation_exact has it then, up to 38 digits. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    rows = vectors.where(usable(v)).select(F.col(id_col).alias("id"), integers(v, SCALE, HELD).alias("x"), F.size(v).alias("dims")).where("dims > 0")
    rows, _ = staged(rows, "integers")
    out = None
    for (dims,) in sorted(rows.select("dims").distinct().collect()):  # one row per length
        own = rows.where(F.col("dims") == dims)
        fit, fit_at = staged(own.select("x").distinct(), "fit")
        found = Whitening(fit, dims, min(components, dims))
        drop_path(spark, fit_at)
        made = own.select("id", "x", F.expr(found.deviation()).alias("d")).select(F.col("id").alias(id_col), F.inline(F.expr(found.row())))
        out = made if out is None else out.unionAll(made)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType), *OUT]))
    return out
