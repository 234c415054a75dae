"""Differences of snapshots, and derived tables that follow them without being built anew."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.operators.store import Versions


def _hashable(df: DataFrame, name: str):
    c = F.col(f"`{name}`")
    return F.array_sort(F.map_entries(c)) if isinstance(df.schema[name].dataType, T.MapType) else c


def _prints(df: DataFrame, columns: Sequence[str]) -> list:
    """Four whole numbers below 2**32 that stand for a row's columns: two hashes, halved so that their sums fit a long."""
    cells = [x for c in columns for x in (F.col(f"`{c}`").isNull(), _hashable(df, c))]  # a hash passes nulls over
    out = []
    for seed in (0, 1):
        h = F.xxhash64(F.lit(seed), *cells)
        out += [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]
    return out


def _keys(df: DataFrame, keys: Sequence[str]):
    return F.struct(*(F.col(f"`{c}`").alias(c) for c in keys))


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that differ between two snapshots and how: added, changed or removed.

    Rows are compared by hashes of 128 bits over all columns of `new`, whatever their order in `old`; null keys are keys. Rows that
    share a key are compared as a bag: one more or one fewer copy is a change. Both sides go through one shuffle, summed before it, so
    that neither rows nor a key with very many of them travel. Columns that only `old` has don't count; one that it lacks is null there.
    """
    columns = new.columns
    for c in columns:
        if c not in old.columns:
            old = old.withColumn(c, F.lit(None).cast(new.schema[c].dataType))
    sides = []
    for side, sign in ((old, -1), (new, 1)):
        prints = [(p * F.lit(sign)).alias(f"p{i}") for i, p in enumerate(_prints(side, columns))]
        sides.append(side.select(_keys(side, keys).alias("k"), F.lit(sign).alias("sign"), *prints))
    summed = sides[0].union(sides[1]).groupBy("k").agg(F.count_if(F.col("sign") < 0).alias("before"), F.count_if(F.col("sign") > 0).alias("after"), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(4)))
    same = (F.col("before") == F.col("after")) & (F.greatest(*(F.abs(f"p{i}") for i in range(4))) == 0)
    kind = F.when(F.col("before") == 0, "added").when(F.col("after") == 0, "removed").otherwise("changed")
    return summed.where(~same).select("k.*", kind.alias("change"))


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A semi or anti join by keys of which nulls are equal."""
    r = right.select(*(F.col(f"`{c}`").alias(f"_right_{i}") for i, c in enumerate(keys)))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_right_{i}"))
    return left.join(r, same, how)


class Step(NamedTuple):
    """A derived table: `derive(rows of the table before)` gives its rows, each row's `keys` and those of its parent included.

    A derived row may depend on the rows of its parent's key alone, and no two parents give rows of one key.
    """

    name: str
    keys: Sequence[str]
    derive: Callable[[DataFrame], DataFrame]


SOURCE = "source"


class Maintained(Versions):
    """A source table and the tables that steps derive from it, one after the other, in versions.

    A refresh compares the new snapshot with the last, derives again from added and changed keys only, compares what comes out with
    what was there for these, and hands on only keys that differ: a page whose markup changes but not its text
    costs no new vector. Each version writes the rows of the keys that it touches, and those keys: tombstones, where they come with no
    rows. A reader keeps rows of the version that touched their key last. A manifest, renamed into its place, makes all tables visible
    at once; a refresh that dies leaves nothing to readers, and of two at once the second raises.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], steps: Sequence[Step]):
        super().__init__(spark, path)
        self.keys = {SOURCE: list(keys)} | {s.name: list(s.keys) for s in steps}
        self.steps = list(steps)

    def _at(self, level: str, part: str, load: str) -> str:
        return f"{self.path}/loads/{load}/{level}/{part}"

    def _union(self, level: str, part: str, loads: list[str]) -> DataFrame:
        """A level's rows or touched keys of some loads, and the place of each in their order."""
        found = None
        for place, load in enumerate(loads):
            own = self.spark.read.parquet(self._at(level, part, load)).withColumn("place", F.lit(place))
            found = own if found is None else found.unionByName(own, allowMissingColumns=True)
        return found

    def read(self, number: int | None = None, level: str = SOURCE) -> DataFrame | None:
        """A table as of a version, by default the newest; None before the first."""
        loads = self.manifest(number)["loads"]
        if not loads:
            return None
        rows = self._union(level, "rows", loads)
        if len(loads) > 1:
            last = self._union(level, "touched", loads).groupBy("k").agg(F.max("place").alias("place"))
            r = last.select(F.col("k").alias("last_k"), F.col("place").alias("last_place"))
            rows = rows.join(r, rows.k.eqNullSafe(r.last_k) & (rows.place == r.last_place), "left_semi")
        return rows.select("row.*")

    def refresh(self, source: DataFrame) -> DataFrame:
        """Brings all tables to a new snapshot: (level, added, changed, removed, derived), derived being the rows that were written."""
        number, load, done = self.version(), uuid.uuid4().hex, []
        seen = self.manifest(number)
        new, parents = source, self.keys[SOURCE]
        for level in self.keys:
            keys = self.keys[level]
            old = self.read(number, level)
            if level != SOURCE:
                new = next(s for s in self.steps if s.name == level).derive(fresh)
                if old is not None:
                    old = _on(old, self._touched(parent, load), parents, "left_semi")
                staged = self._at(level, "derived", load)
                new.write.parquet(staged)  # read twice below; derived once
                new = self.spark.read.parquet(staged)
            before = self.spark.createDataFrame([], new.schema) if old is None else old
            found = changes(before, new, keys)
            self._keep_touched(level, load, found)
            touched = self._touched(level, load)
            fresh = self._keep_rows(level, load, _on(new, touched.where("change <> 'removed'"), keys, "left_semi"))
            by = {r.change: r["count"] for r in touched.groupBy("change").count().collect()}  # three rows
            done.append((level, by.get("added", 0), by.get("changed", 0), by.get("removed", 0), fresh.count()))
            if level != SOURCE:
                self._fs.delete(self._path(staged), True)
            parent, parents = level, keys
        if any(a + c + r for _, a, c, r, _ in done):
            if not self._commit(number + 1, {"loads": [*seen["loads"], load], "rows": 0}):
                self._drop(load)
                raise RuntimeError("another refresh was first; refresh again from its version")
        else:
            self._drop(load)
        return self.spark.createDataFrame(done, "level string, added long, changed long, removed long, derived long")

    def _keep_touched(self, level: str, load: str, found: DataFrame) -> None:
        found.select(_keys(found, self.keys[level]).alias("k"), "change").write.parquet(self._at(level, "touched", load))

    def _touched(self, level: str, load: str) -> DataFrame:
        return self.spark.read.parquet(self._at(level, "touched", load)).select("k.*", "change")

    def _keep_rows(self, level: str, load: str, rows: DataFrame) -> DataFrame:
        keyed = rows.select(_keys(rows, self.keys[level]).alias("k"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
        keyed.write.parquet(self._at(level, "rows", load))
        return self.spark.read.parquet(self._at(level, "rows", load)).select("row.*")

    def merge(self) -> int:
        """Writes all tables of the newest version as one load, without what later versions replaced; the version that has it."""
        number, load = self.version(), uuid.uuid4().hex
        seen = self.manifest(number)
        if len(seen["loads"]) < 2:
            return number
        for level in self.keys:
            rows = self._keep_rows(level, load, self.read(number, level))
            self._keep_touched(level, load, rows.select(*(F.col(f"`{c}`") for c in self.keys[level])).distinct().withColumn("change", F.lit("added")))
        if self._commit(number + 1, {"loads": [load], "rows": 0}):
            return number + 1
        self._drop(load)
        return self.version()
