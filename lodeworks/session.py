"""The Spark session the engine runs on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results depend on; the rest is the cluster's own.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "lodeworks", **more: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).getOrCreate()
