"""Queries that run a stream over what is available and return its table; their SQL is that of the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodeworks.operators.crawl import shared_dir
from lodeworks.sources import table
from lodeworks.streaming import expiry, windows


def _events(spark, sf_dir):
    """The events file as a stream; a file source reads folders, and takes the name as a pattern."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def _run(stream, mode: str):
    """The stream's result as a table in the shared folder; in complete mode each batch replaces the last."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    windows.into(stream, lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out"), f"{at}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def stream_tumbling(spark, sf_dir):
    out = _run(windows.tumbling(_events(spark, sf_dir), "1 day"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_distinct(spark, sf_dir):
    keyed = _events(spark, sf_dir).withColumn("content_hash", F.md5(F.col("event_id").cast("string").cast("binary")))
    return _run(windows.first_seen(keyed).select("event_id", "content_hash"), "append")


def stream_cache(spark, sf_dir):
    """Users' events as requests to a cache whose answers are good for half a day: which ones find one."""
    requests = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("request_id"), "ts")
    with expiry.running(spark):
        out = _run(expiry.cached(requests, 43_200), "append")
    return out.select("key", "request_id", "hit")


#: An answer is found by a user's first event, and then by the first one after the last answer's end.
STREAM_CACHE_SQL = """
WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, event_id AS request_id, ts FROM events WHERE ts IS NOT NULL),
found AS (SELECT key, min(ts) AS at FROM e GROUP BY key
  UNION ALL SELECT f.key, min(e.ts) FROM found f JOIN e ON e.key IS NOT DISTINCT FROM f.key AND e.ts > f.at + INTERVAL 12 HOUR GROUP BY f.key),
o AS (SELECT *, row_number() OVER (PARTITION BY key, ts ORDER BY request_id) AS nth FROM e)
SELECT o.key, o.request_id, NOT (o.nth = 1 AND f.at IS NOT NULL) AS hit FROM o LEFT JOIN found f ON f.key IS NOT DISTINCT FROM o.key AND f.at = o.ts
"""

QUERIES = {"stream_cache": stream_cache, "stream_tumbling": stream_tumbling, "stream_distinct": stream_distinct}

ORACLES = {
    "stream_cache": STREAM_CACHE_SQL,
    "stream_tumbling": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_distinct": "SELECT DISTINCT event_id, md5(event_id::VARCHAR) AS content_hash FROM events",
}
