"""State that expires: what a cache with a time to live would answer, key by key, over a stream of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that an answer is good for, unless told otherwise.
TTL = 300.0
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
AT = T.StructType([T.StructField("at", T.LongType())])


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


class Expiring(StatefulProcessor):
    """Keeps when a key's answer was found, and tells for each request whether it is still good.

    A request finds an answer (hit) up to `ttl` microseconds after it was found; a later one finds it anew. Hits don't prolong
    it. Requests of a batch are taken in the order of (ts, request_id), nulls first; one that comes in a later batch, but is
    older than the answer that is held, finds that one. A timer in event time drops the entry once the watermark is past
    its end, so that state holds the keys of a time to live and the watermark's delay, whatever the stream's length.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", AT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat([r[["request_id", "ts"]] for r in rows]).sort_values(["ts", "request_id"], na_position="first")
        at = self.entry.get()[0] if self.entry.exists() else None
        began, hits = at, []
        for t in _micros(asked["ts"]):
            good = at is not None and t - at <= self.ttl
            hits.append(good)
            if not good:
                at = t
        if at != began:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.entry.update((int(at),))
            self.handle.registerTimer(int(at + self.ttl) // 1000 + 1)
        yield asked.assign(key=key[0], hit=hits)[["key", "request_id", "ts", "hit"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="object"), "request_id": pd.Series([], dtype="int64"), "ts": pd.Series([], dtype="datetime64[us]"), "hit": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


def cached(requests: DataFrame, seconds: float = TTL) -> DataFrame:
    """(key, request_id, ts, hit) of a stream (key string, request_id long, ts timestamp with a watermark), other columns aside.

    Requests without a time are left out: they have no place in the order. A null key is a key of its own. A batch's requests of one key
    meet in one task as pairs of numbers; the source's limit for a trigger bounds them. Needs the state store of `running`.
    """
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("request_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("hit", T.BooleanType())])
    keyed = requests.where("ts IS NOT NULL").select("key", "request_id", "ts").groupBy("key")
    return keyed.transformWithStateInPandas(Expiring(round(seconds * 1e6)), schema, "Append", "EventTime")


class Lasting(StatefulProcessor):
    """Whether a key was seen in the last seconds of the machine's clock; the state store itself drops what is older."""

    def __init__(self, seconds: float):
        self.ms = round(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", T.StructType([T.StructField("request", T.StringType())]), AT, ttlDurationMs=self.ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            hits = []
            for request in batch["request"]:
                known = (request,)
                hit = self.held.containsKey(known)
                if not hit:  # an update would prolong it
                    self.held.updateValue(known, (timerValues.getCurrentProcessingTimeInMs(),))
                hits.append(hit)
            yield pd.DataFrame({"key": key[0], "request": batch["request"], "hit": hits})

    def close(self) -> None:
        pass


def remembered(requests: DataFrame, seconds: float = TTL) -> DataFrame:
    """(key, request, hit) of a stream (key string, request string), by the clock: a service's cache for each session or user.

    A request that the key made before, at most so many seconds ago, is a hit. The time to live is the state store's own, on the map's entries.
    Rows without a request are left out. Needs the state store of `running`, and a trigger by time (or once): as the clock
    goes on without data, a run over what is available never ends.
    """
    schema = "key string, request string, hit boolean"
    return requests.where("request IS NOT NULL").select("key", "request").groupBy("key").transformWithStateInPandas(Lasting(seconds), schema, "Append", "ProcessingTime")


class running:
    """Sets the RocksDB state store for the queries that start inside, and gives the session back as it was."""

    NAME = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(self.NAME, None)
        self.conf.set(self.NAME, PROVIDER)

    def __exit__(self, *_):
        if self.before is None:
            self.conf.unset(self.NAME)
        else:
            self.conf.set(self.NAME, self.before)
