"""A collection in versions: loads become visible at once, by a manifest that is renamed into its place."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.text import record_id
from lodeworks.operators.vectors import new_rows

#: Folders of content hashes: a load reads those that its own hashes fall into.
BUCKETS = 256
_TURN = threading.Lock()


class Versions:
    """Numbered manifests at path, each naming the loads of a version; one is made by renaming a file into its place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifests/{number:09d}.json"

    def version(self) -> int:
        """The number of the newest version; 0 before the first load."""
        at = self._path(f"{self.path}/manifests")
        if not self._fs.exists(at):
            return 0
        names = (s.getPath().getName() for s in self._fs.listStatus(at))
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def manifest(self, number: int | None = None) -> dict:
        number = self.version() if number is None else number
        if not number:
            return {"loads": [], "rows": 0}
        return json.loads("".join(r.value for r in self.spark.read.text(self._manifest(number), wholetext=True).collect()))

    def _commit(self, number: int, manifest: dict) -> bool:
        """Whether the manifest has become that of a version that had none."""
        new = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(new, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            with _TURN:  # a local disk's rename looks first and moves then
                self._context.rename(new, self._path(self._manifest(number)), self._rename)
            return True
        except Exception as error:
            self._fs.delete(new, False)
            if "FileAlreadyExistsException" not in str(error):
                raise
            return False

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all but the last versions and the loads that only those have, dead ones included; not while loads run."""
        last = self.version()
        kept = range(max(1, last - keep + 1), last + 1)
        alive = {x for n in kept for x in self.manifest(n)["loads"]}
        for n in range(1, kept.start):
            self._fs.delete(self._path(self._manifest(n)), False)
        at = self._path(f"{self.path}/loads")
        dead = [s.getPath().getName() for s in self._fs.listStatus(at) if s.getPath().getName() not in alive] if self._fs.exists(at) else []
        for x in dead:
            self._drop(x)
        return sorted(dead)

    def _drop(self, load: str) -> None:
        self._fs.delete(self._path(f"{self.path}/loads/{load}"), True)


class Store(Versions):
    """Rows at path, each text once; every load is a folder, and a manifest names the folders of a version.

    A load writes its rows and their hashes beside the others' and then renames a manifest to the next number. If another
    load was first, its hashes alone are compared and the load tries again, so that two loads at once leave each text
    once, and a load that dies leaves nothing that a reader sees. Hashes are tables of their own in buckets: finding what
    is new reads neither texts nor vectors. The manifest carries the number of rows. Rows without a text aren't loaded.
    """

    def read(self, number: int | None = None) -> DataFrame | None:
        """The rows of a version, by default the newest; None if there are none."""
        loads = self.manifest(number)["loads"]
        return self.spark.read.parquet(*(f"{self.path}/loads/{x}/rows" for x in loads)) if loads else None

    def _hashes(self, loads: list[str], buckets: list[int]) -> DataFrame:
        found = None
        for x in loads:
            own = self.spark.read.schema("content_hash string, bucket int").parquet(f"{self.path}/loads/{x}/hashes")
            found = own if found is None else found.union(own)
        return found.where(F.col("bucket").isin(buckets)).select("content_hash")

    def _write(self, rows: DataFrame) -> tuple[str, int, list[int]]:
        """Rows and hashes as a load that nobody knows yet; its name, size and buckets."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/loads/{name}/rows")
        kept = self.spark.read.parquet(f"{self.path}/loads/{name}/rows").select("content_hash", _bucket())
        kept.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/loads/{name}/hashes")
        sizes = kept.groupBy("bucket").count().collect()  # at most BUCKETS rows
        return name, sum(r["count"] for r in sizes), [r.bucket for r in sizes]

    def load(self, batch: DataFrame, text_col: str = "text", order: str = "seq") -> DataFrame:
        """Adds the rows whose text is new, first ones first; one row: total, uploaded, in_collection, version."""
        total, given = batch.agg(F.count("*")).first()[0], batch.where(F.col(text_col).isNotNull())
        number = self.version()
        seen = self.manifest(number)
        rows = new_rows(given, None, text_col, order).withColumn("record_id", record_id(F.col(text_col), F.col(order)))
        if seen["loads"]:
            buckets = [r.bucket for r in rows.select(_bucket()).distinct().collect()]  # at most BUCKETS
            rows = rows.join(self._hashes(seen["loads"], buckets), "content_hash", "left_anti")
        name, uploaded, buckets = self._write(rows)
        while uploaded and not self._commit(number + 1, {"loads": [*seen["loads"], name], "rows": seen["rows"] + uploaded}):
            number = self.version()
            now = self.manifest(number)
            others = [x for x in now["loads"] if x not in seen["loads"]]
            mine = self.spark.read.parquet(f"{self.path}/loads/{name}/rows")
            again, uploaded, buckets = self._write(mine.join(self._hashes(others, buckets), "content_hash", "left_anti")) if others else (name, uploaded, buckets)
            if again != name:
                self._drop(name)
            name, seen = again, now
        if not uploaded:
            self._drop(name)
            number -= 1
        rows_now = seen["rows"] + uploaded
        return self.spark.range(1).select(F.lit(total).alias("total"), F.lit(uploaded).alias("uploaded"), F.lit(rows_now).alias("in_collection"), F.lit(number + 1).alias("version"))

    def load_all(self, batches: Iterable[DataFrame], text_col: str = "text", order: str = "seq") -> DataFrame:
        """Loads some batches, each by itself: (batch, total, uploaded, in_collection, version, failure); a failed one is counted and left."""
        done = []
        for k, batch in enumerate(batches):
            try:
                done.append((k, *self.load(batch, text_col, order).first(), None))
            except PySparkException as error:
                done.append((k, None, 0, self.manifest()["rows"], self.version(), str(error).partition("\n")[0]))
        return self.spark.createDataFrame(done, "batch int, total long, uploaded long, in_collection long, version long, failure string")

    def merge(self) -> int:
        """Puts a version's loads together as one; the number of the version that has it. Another load meanwhile wins."""
        number = self.version()
        seen = self.manifest(number)
        if len(seen["loads"]) < 2:
            return number
        name, rows, _ = self._write(self.read(number))
        if self._commit(number + 1, {"loads": [name], "rows": rows}):
            return number + 1
        self._drop(name)
        return self.version()


def _bucket():
    return F.pmod(F.xxhash64("content_hash"), F.lit(BUCKETS)).cast("int").alias("bucket")
