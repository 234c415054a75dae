"""Crawls over a table of pages as iterated joins."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.urls import first_of_each


def shared_dir(spark) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where it is unset, a temporary folder
    serves a local master; others raise, as their executors would each write to a disk of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")

        where = "file://" + tempfile.mkdtemp(prefix="lodeworks-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark, tag: str) -> str:
    """A new folder in the shared one, for what goes when Python ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _DROPPED.add(path)
    atexit.register(_drop, spark, path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table, so that each round's plan stays as short as the first's."""
    return _appended(df, f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}")


def _appended(df: DataFrame, path: str) -> DataFrame:
    """The table at path after df has gone behind it; the table goes when Python ends."""
    spark = df.sparkSession
    if path not in _DROPPED:
        _DROPPED.add(path)
        atexit.register(_drop, spark, path)
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


#: What a written table was shuffled by goes from the executors' disks once it is written.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_DROPPED: set[str] = set()


def _drop(spark, path: str) -> None:
    with contextlib.suppress(Exception):
        sc = spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def crawl(seeds: DataFrame, links: DataFrame, depth: int | None = 3, most: int | None = None) -> DataFrame:
    """(url, depth): what links (url, link) reach from the seeds within so many rounds, each address at its first depth.

    depth, a feature of the crawl, bounds the rounds; with None they go on until the frontier is empty.
    Each round joins the frontier to the links, drops what was visited and goes behind it; a frontier of any size is a table. most, if
    given, bounds the pages by (depth, url), a feature of the crawl.
    """
    spark = seeds.sparkSession
    path = f"{shared_dir(spark)}/crawl-{uuid.uuid4().hex}"
    seen = _appended(seeds.select("url").distinct().withColumn("depth", F.lit(0)), path)
    front = seen
    for k in count(1) if depth is None else range(1, depth + 1):
        found = front.join(links, "url").select(F.col("link").alias("url")).distinct().join(seen, "url", "left_anti")
        front = written(found.withColumn("depth", F.lit(k)), "frontier")
        if front.isEmpty():
            break
        seen = _appended(front, path)
    return seen if most is None else seen.orderBy("depth", "url").limit(most)


#: Folders that known addresses are kept in: a round looks only into those that its own finds fall into. So many are
#: listed without a job.
BUCKETS = 32


def _bucket(c: str = "url") -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def best_first(seeds: DataFrame, links: DataFrame, score: Callable[[Column], Column], each: int = 10, rounds: int | None = 3, most: int | None = None, by_host: bool = False) -> DataFrame:
    """(url, round, score): what a crawl takes that opens the `each` best open addresses a round, of every host with by_host.

    The best have the highest score, then the smallest address; unscored ones come last. What a page links to is open from the next round
    on, and an address is taken once. each, rounds and most (pages in all, the best of the last round) are features of the crawl; with
    rounds=None it goes on until nothing is open. Known addresses are a table in buckets by hash, so that a round compares what it finds with
    a few of them only; what is taken is a table as well. Open ones are found by a scan of known addresses with a limit for each partition.
    """
    spark = seeds.sparkSession
    known_at, taken_at = scratch(spark, "known"), scratch(spark, "taken")
    kept = "url string, score double, bucket int"

    def learn(urls: DataFrame) -> None:
        rows = urls.where("url IS NOT NULL").select("url", score(F.col("url")).cast("double").alias("score"), _bucket().alias("bucket"))
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(known_at)

    learn(seeds.select("url").distinct())
    taken = _appended(spark.createDataFrame([], "url string, round int, score double"), taken_at)
    best = [F.desc_nulls_last("score"), "url"]
    total = 0
    for k in count(1) if rounds is None else range(1, rounds + 1):
        known = spark.read.schema(kept).parquet(known_at)
        todo = known.join(taken.select("url"), "url", "left_anti").select("url", "score")
        if by_host:
            host = F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.col("url"))
            rank = F.row_number().over(Window.partitionBy("host").orderBy(*best))
            now = todo.withColumn("host", host).withColumn("rank", rank).where(F.col("rank") <= each).select("url", "score")
        else:
            now = todo.orderBy(*best).limit(each)
        if most is not None:
            now = now.orderBy(*best).limit(most - total)
        now = written(now.select("url", F.lit(k).alias("round"), "score"), "round")
        n = now.count()
        if not n:
            break
        total += n
        taken = _appended(now, taken_at)
        if total == most:
            break
        found = written(now.select("url").join(links.select("url", "link"), "url").select(F.col("link").alias("url")).distinct(), "found")
        near = [r.b for r in found.select(_bucket().alias("b")).distinct().collect()]  # at most BUCKETS
        learn(found.join(known.where(F.col("bucket").isin(near)).select("url"), "url", "left_anti"))
    return taken


def same_host(links: DataFrame) -> DataFrame:
    """Links that stay on their page's host."""
    host = lambda c: F.parse_url(F.col(c), F.lit("HOST"))
    return links.where(host("url") == host("link"))


def union_of_sources(*sources: DataFrame) -> DataFrame:
    """Addresses of several lists, each once, with the first list that has it."""
    rows = None
    for k, s in enumerate(sources):
        part = s.select("url").withColumn("source", F.lit(k))
        rows = part if rows is None else rows.union(part)
    return first_of_each(rows, "source")


def new_only(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known.select("url"), "url", "left_anti")
