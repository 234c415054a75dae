"""Expiring state against a plain model, over batches and restarts."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from lodeworks.streaming import expiry, windows

SCHEMA = "key string, request_id long, ts timestamp"
START = datetime.datetime(2024, 1, 1)


def model(rows, ttl):
    """The sequential rule: batches in turn, each key's requests by time."""
    held, out = {}, {}
    for batch in rows:
        for key, rid, ts in sorted((r for r in batch if r[2] is not None), key=lambda r: (r[2], r[1])):
            at = held.get(key)
            out[rid] = at is not None and (ts - at).total_seconds() <= ttl
            if not out[rid]:
                held[key] = ts
    return out


def run(spark, tmp_path, batches, ttl=300.0, late="10 hours"):
    """Each batch as a file and a run of its own, on one checkpoint: every run but the first is a restart."""
    got = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in/*").withWatermark("ts", late)
        with expiry.running(spark):
            windows.into(expiry.cached(stream, ttl), lambda df, _: got.extend(df.collect()), f"file://{tmp_path}/state")
    return got


def test_hits_and_misses_equal_the_model(spark, tmp_path):
    dice, rid, batches = random.Random(5), 0, []
    for k in range(3):
        batch = []
        for _ in range(120):
            key = dice.choice(["hot", "hot", "hot", "a", "b", "", None])
            batch.append((key, rid, START + datetime.timedelta(seconds=k * 1500 + dice.randrange(1500))))
            rid += 1
        batch += [("edge", rid, START), ("edge", rid + 1, START + datetime.timedelta(seconds=300)), ("edge", rid + 2, START + datetime.timedelta(seconds=300, microseconds=1)), ("none", rid + 3, None)] if k == 0 else []
        rid += 4
        batches.append(batch)
    got = run(spark, tmp_path, batches)
    want = model(batches, 300)
    assert len(got) == len(want) and {r.request_id: r.hit for r in got} == want
    assert set(want.values()) == {True, False}
    edge = sorted((r.ts, r.hit) for r in got if r.key == "edge")
    assert [hit for _, hit in edge] == [False, True, False]  # good to the end of the time, not after it


def test_entries_go_behind_the_watermark(spark, tmp_path):
    minute = datetime.timedelta(minutes=1)
    batches = [[("a", 1, START)], [("b", 2, START + 60 * minute)], [("c", 3, START + 61 * minute)]]
    run(spark, tmp_path, batches, late="1 minute")
    state = spark.read.format("statestore").option("stateVarName", "entry").load(f"file://{tmp_path}/state").select(F.col("key.key").alias("key"))
    assert {r.key for r in state.collect()} == {"b", "c"}


def test_clock_forgets(spark, tmp_path):
    got = []

    def ask(k, rows):
        spark.createDataFrame(rows, "key string, request string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
        stream = spark.readStream.schema("key string, request string").parquet(f"file://{tmp_path}/in/*")
        with expiry.running(spark):
            sink = expiry.remembered(stream, 8).writeStream.foreachBatch(lambda df, _: got.append(sorted((r.key or "", r.request, r.hit) for r in df.collect())))
            query = sink.option("checkpointLocation", f"file://{tmp_path}/state").trigger(once=True).start()
        assert query.awaitTermination(60)

    ask(0, [("u", "x"), ("u", "x"), ("v", "x"), (None, "x"), ("u", None)])
    assert got[0] == [("", "x", False), ("u", "x", False), ("u", "x", True), ("v", "x", False)]
    time.sleep(9)
    ask(1, [("u", "x"), ("v", "y")])
    assert got[1] == [("u", "x", False), ("v", "y", False)]


def test_provider_is_given_back(spark):
    before = spark.conf.get(expiry.running.NAME, None)
    with pytest.raises(ValueError, match="stop"), expiry.running(spark):
        assert spark.conf.get(expiry.running.NAME) == expiry.PROVIDER
        raise ValueError("stop")
    assert spark.conf.get(expiry.running.NAME, None) == before
