"""Shared plumbing of the training-data operators: staged tables, text units, distributed prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the white-space rule is a longest run of bytes other than these.
BLANKS = "\\x20\\x09-\\x0D"
#: Bytes that separate words of the lexical rule; A-Z fold to a-z, bytes from 0x80 on belong to words.
LEXICAL = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder of this machine serves a local master; any other master raises, since its
    executors would each write to a disk of their own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lodeworks-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a staged table through Hadoop's file system."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _drop_late(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        drop_path(spark, path)


#: Shuffle files go when the query that wrote them ends, not when a garbage collector finds its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def write(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """Writes df as Parquet; the shuffles of its plan are gone afterwards."""
    with _clean_shuffles(df.sparkSession):
        df.write.option("compression", codec).parquet(path)


def staged(df: DataFrame, tag: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Writes df as Parquet into the shared folder and reads it back: the lineage ends here, and lost executors cost nothing.

    Returns the table and its path, for drop_path once no plan reads it any more; what is left goes when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    write(df, path, codec)
    return spark.read.schema(df.schema).parquet(path), path


#: Paths of the tables staged within each open temporary().
_MADE: list[list[str]] = []


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Tables and files left in the shared folder within go at the end, but for those taken out of the list that this yields."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE[:] = [m for m in _MADE if m is not made]
        for path in made:
            drop_path(spark, path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    for made in _MADE:
        made.append(path)
    atexit.register(_drop_late, spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of white-space words; 0 for null. Counts the starts of words, without building them."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.when(F.trim(flat) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(flat), " +"))).cast("long")


def running_before(df: DataFrame, group: list[str], order: list[str], amounts: dict[str, str], tag: str) -> tuple[DataFrame, str]:
    """Adds, for each (new name, column) of amounts, the sum of the column over all earlier rows of the row's group.

    The rows are range-partitioned over (group, order), so that a hot group spreads over many tasks; each part is summed
    by group, the few part sums are added up, and each row gets its part's offset plus its place within the part. No
    task ever holds more than its range. order must be a total order, or tied rows must be interchangeable.
    Returns the table and the path it is staged at.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *group, *order).withColumn("__part", F.spark_partition_id())
    ranged, path = staged(ranged, tag)
    sums = ranged.groupBy(*group, "__part").agg(*(F.sum(c).alias(f"__s_{n}") for n, c in amounts.items()))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*(F.col(c).alias(f"__g_{c}") for c in group), F.col("__part").alias("__p"), *(F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in amounts))
    on = F.col("__part") == F.col("__p")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    inside = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Offsets: one row for each group of a part, at most parts + groups in all.
    out = ranged.withColumns({f"__w_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in amounts.items()}).join(offsets, on, "left")
    out = out.withColumns({n: F.col(f"__w_{n}") + F.col(f"__o_{n}") for n in amounts})
    return out.select(*df.columns, *amounts), path


def positional(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on, so that no name can clash with one that an operator adds."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def annotate(df: DataFrame, used: list[str], make_worker, added: T.StructType) -> DataFrame:
    """df with columns that a worker computes from Arrow batches of the used columns.

    make_worker() runs once in each task and returns a function from a RecordBatch of the used columns to the added
    columns' arrays. The other columns pass through under positional names, so that odd names do no harm on the way;
    an input column with the name of an added one, by the session's rule of case, is left out of the result.
    """
    fold = (lambda n: n) if df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true" else str.lower
    names = {fold(f.name) for f in added}
    kept = [(i, f) for i, f in enumerate(df.schema) if fold(f.name) not in names]
    at = {fold(c): i for i, c in reversed([*enumerate(df.columns)])}
    wide = positional(df)
    flat = wide.select(*(F.col(f"c{at[fold(c)]}").alias(f"u{i}") for i, c in enumerate(used)), *(F.col(f"c{i}") for i, _ in kept))
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in kept), *(T.StructField(f"a{i}", f.dataType) for i, f in enumerate(added))])
    n, out_names = len(used), [f.name for f in schema]

    def run(batches):
        worker = make_worker()
        for batch in batches:
            arrays = worker(pa.RecordBatch.from_arrays(batch.columns[:n], [f"u{i}" for i in range(n)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[n:], *arrays], out_names)
        release()

    out = flat.mapInArrow(run, schema)
    return out.toDF(*(f.name for _, f in kept), *(f.name for f in added))


def release() -> None:
    """Gives a worker's freed Arrow memory back, which it would keep from task to task."""
    pa.default_memory_pool().release_unused()


def prefixed(schema: T.StructType, prefix: str) -> T.StructType:
    return T.StructType([T.StructField(prefix + f.name, f.dataType) for f in schema])
