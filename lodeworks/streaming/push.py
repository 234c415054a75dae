"""Updates pushed out of a stream, each batch once; and a stream's progress in the tracker's log."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQueryListener

from lodeworks.operators import tracker


@dataclass
class Part(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    rows: int = 0


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.rstrip("/"))


class PushWriter(DataSourceStreamArrowWriter):
    """Tasks write Parquet parts that nobody counts; the commit names a batch's parts in a manifest, which makes them updates.

    A batch whose manifest is there has been pushed before, by a run that stopped between its commit and Spark's own: its parts of this
    time go, and the first ones stay. An aborted batch leaves no parts but those of tasks that were lost, which no manifest names.
    """

    def __init__(self, path: str, query: str):
        self.path, self.query = path, query

    def write(self, iterator: Iterator) -> Part:
        import pyarrow.parquet as pq

        store, root = _files(self.path)
        part, writer, out = Part(), None, None
        try:
            for batch in iterator:
                if writer is None:
                    name = f"{self.query}-{uuid.uuid4().hex}.parquet"
                    store.create_dir(f"{root}/parts", recursive=True)
                    out = store.open_output_stream(f"{root}/parts/{name}")
                    writer = pq.ParquetWriter(out, batch.schema)
                    part.files.append(name)
                writer.write_batch(batch)
                part.rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
                out.close()
        return part

    def _drop(self, messages: list[Part | None]) -> None:
        store, root = _files(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{root}/parts/{name}")

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        from pyarrow import fs

        store, root = _files(self.path)
        at = f"{root}/batches/{self.query}-{batchId:012d}.json"
        if store.get_file_info(at).type != fs.FileType.NotFound:
            self._drop(messages)
            return
        store.create_dir(f"{root}/batches", recursive=True)
        new = f"{root}/batches/.{uuid.uuid4().hex}"
        with store.open_output_stream(new) as out:
            files = [f for m in messages if m is not None for f in m.files]
            out.write(json.dumps({"query": self.query, "batch": batchId, "rows": sum(m.rows for m in messages if m), "files": files}).encode())
        store.move(new, at)

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        self._drop(messages)


class PushSource(DataSource):
    """Options: path, a folder that all executors share; query, a name (letters, digits, underscores) that goes with one checkpoint."""

    @classmethod
    def name(cls) -> str:
        return "push"

    def streamWriter(self, schema, overwrite: bool) -> PushWriter:
        query = self.options.get("query", "updates")
        if not query.replace("_", "").isalnum():
            raise ValueError("a query's name has letters, digits and underscores")
        return PushWriter(self.options["path"], query)


def push(stream: DataFrame, path: str, checkpoint: str, query: str = "updates", every: str | None = None):
    """Starts to push a stream's rows to a folder: batch by batch, or in intervals; what is available where none is given."""
    stream.sparkSession.dataSource.register(PushSource)
    writer = stream.writeStream.format("push").option("path", path).option("query", query).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def updates(spark: SparkSession, path: str, schema, after: int = -1, query: str = "updates") -> DataFrame:
    """Pushed rows with their batch, of batches after one that a reader has seen; parts without a manifest don't count."""
    manifests = spark.read.schema("query string, batch long, rows long, files array<string>").json(f"{path}/batches")
    named = manifests.where((F.col("query") == query) & (F.col("batch") > after)).select("batch", F.explode("files").alias("_part"))
    rows = spark.read.schema(schema).parquet(f"{path}/parts").withColumn("_part", F.element_at(F.split("_metadata.file_path", "/"), -1))
    return rows.join(named, "_part").drop("_part")


class TrackerListener(StreamingQueryListener):
    """Writes down streams' starts, batches with rows, and ends as lines of the tracker's log, `many` at a time and at each end.

    A line's job is the query's name, or its id; a failed query's line has level ERROR. Lines are held on the driver until they are written.
    """

    def __init__(self, spark: SparkSession, root: str, many: int = 100):
        self.spark, self.root, self.many, self.held, self.turn, self.names = spark, root, many, [], threading.Lock(), {}

    def _line(self, run, level: str, message: str, step: str) -> None:
        with self.turn:
            self.held.append((self.names.get(str(run), str(run)), datetime.now(timezone.utc).timestamp(), level, message, step))
            full = len(self.held) >= self.many
        if full:
            self.flush()

    def flush(self) -> None:
        with self.turn:
            held, self.held = self.held, []
        if held:
            tracker.record(self.spark.createDataFrame(held, tracker.TABLES["logs"]).coalesce(1), self.root, "logs")

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or str(event.id)
        self._line(event.runId, "INFO", "started", "start")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self._line(p.runId, "INFO", f"batch {p.batchId}: {p.numInputRows} rows, {p.processedRowsPerSecond:.1f} a second", "batch")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        failed = event.exception
        self._line(event.runId, "ERROR" if failed else "INFO", str(failed).partition("\n")[0] if failed else "ended", "end")
        self.names.pop(str(event.runId), None)
        self.flush()
