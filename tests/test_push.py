"""Pushed batches: once each, whatever is repeated or fails; progress in the tracker's log."""

import collections
import glob
import os
import shutil
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lodeworks.operators import tracker
from lodeworks.streaming import push

SCHEMA = "id long, text string"


def feed(spark, at, k, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"file://{at}/in/{k}")


def stream(spark, at):
    return spark.readStream.schema(SCHEMA).parquet(f"file://{at}/in/*")


def run(spark, at, df=None):
    query = push.push(stream(spark, at) if df is None else df, f"file://{at}/out", f"file://{at}/state")
    query.awaitTermination(90)


def got(spark, at, **more):
    return collections.Counter(map(tuple, push.updates(spark, f"file://{at}/out", SCHEMA, **more).select("id", "text").collect()))


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    feed(spark, tmp_path, 0, [(1, "a"), (1, "a"), (2, None), (None, "")])
    run(spark, tmp_path)
    first = collections.Counter([(1, "a"), (1, "a"), (2, None), (None, "")])
    assert got(spark, tmp_path) == first
    feed(spark, tmp_path, 1, [(3, "x" * 100_000)])
    run(spark, tmp_path)
    both = first + collections.Counter([(3, "x" * 100_000)])
    assert got(spark, tmp_path) == both and got(spark, tmp_path, after=0) == both - first
    # As if the run had ended between the sink's commit and Spark's: the last batch runs again.
    for commit in glob.glob(f"{tmp_path}/state/commits/*1"):
        os.remove(commit)
    for crc in glob.glob(f"{tmp_path}/state/commits/.*1.crc"):
        os.remove(crc)
    parts = set(os.listdir(tmp_path / "out/parts"))
    run(spark, tmp_path)
    assert got(spark, tmp_path) == both and set(os.listdir(tmp_path / "out/parts")) == parts


def test_a_failed_batch_leaves_nothing_and_is_pushed_later(spark, tmp_path):
    feed(spark, tmp_path, 0, [(1, "a"), (2, "b")])
    bad = stream(spark, tmp_path).withColumn("text", F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path, bad)
    assert not glob.glob(f"{tmp_path}/out/batches/*.json")
    run(spark, tmp_path)
    assert got(spark, tmp_path) == {(1, "a"): 1, (2, "b"): 1}


def test_orphaned_parts_do_not_count(spark, tmp_path):
    feed(spark, tmp_path, 0, [(1, "a")])
    run(spark, tmp_path)
    part = next(p for p in os.listdir(tmp_path / "out/parts"))
    shutil.copy(tmp_path / "out/parts" / part, tmp_path / "out/parts/updates-lost.parquet")
    assert got(spark, tmp_path) == {(1, "a"): 1}


def test_progress_in_the_log(spark, tmp_path):
    root = f"file://{tmp_path}/tracker"
    tracker.create_tables(spark, root)
    feed(spark, tmp_path, 0, [(1, "a"), (2, "b")])
    listener = push.TrackerListener(spark, root)
    spark.streams.addListener(listener)
    try:
        run(spark, tmp_path)
        for _ in range(60):
            lines = tracker.read(spark, root, "logs").collect()
            if lines:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    assert [r.step_name for r in sorted(lines, key=lambda r: r.ts)] == ["start", "batch", "end"]
    assert len({r.job_id for r in lines}) == 1 and any(r.message.startswith("batch 0: 2 rows") for r in lines)
