"""Event streams: windows with late data, bounded state, dedup across batches, alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeworks.operators.analytics import health


def read_events(spark: SparkSession, folder: str, schema, ts: str = "ts", late: str = "1 hour", per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream with a watermark; files that come later are read when they come."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, size: str = "1 hour", ts: str = "ts") -> DataFrame:
    return events.groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "5 minutes", slide: str = "1 minute", ts: str = "ts") -> DataFrame:
    return events.groupBy(F.window(ts, size, slide).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("average")).select(F.col("w.start").alias("start"), "n", "errors", "average")


def sessions(events: DataFrame, gap: str = "6 hours", ts: str = "ts") -> DataFrame:
    return events.groupBy("user_id", F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(rows: DataFrame, key: str = "content_hash") -> DataFrame:
    """The first row of each key within the watermark's reach; the state of older keys goes."""
    return rows.dropDuplicatesWithinWatermark([key])


def windowed_alerts(windows: DataFrame) -> DataFrame:
    """Windows whose mean or share of errors breaks a limit."""
    rate = F.col("errors") / F.col("n")
    return windows.withColumn("status", F.when(rate > 0.1, "critical").when(F.col("average") > 5000, "warning").otherwise("healthy")).where("status <> 'healthy'")


LATEST = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("last", T.ArrayType(T.DoubleType()))])


def _keep_last(most: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, held = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        n, held = n + len(rows), [*held, *rows["value"].tolist()][-most:]
        state.update((n, held))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 300_000)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last": [held]})

    return run


def last_values(events: DataFrame, most: int = 10) -> DataFrame:
    """Each key's count and last values after every batch: a ring of bounded size, which goes after five minutes of
    event time without rows."""
    return events.groupBy("user_id").applyInPandasWithState(_keep_last(most), LATEST, "n long, held array<double>", "update", GroupStateTimeout.EventTimeTimeout)


def into(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Runs what is available through a function of each batch; a batch that is repeated must give the same table."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def batch_health(interactions: DataFrame) -> DataFrame:
    return health(interactions)


def into_collection(stream: DataFrame, path: str, checkpoint: str, upsert: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """Loads batches of chunks into a collection: each batch's new rows, by hash against all that are there."""
    return into(stream, lambda batch, _: upsert(batch.sparkSession, batch, path).collect(), checkpoint)
