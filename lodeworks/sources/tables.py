"""The engine's tables as Parquet."""

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Bytes of rows that Spark hands to Python at a time, unless the session has its own: long texts then take no more memory than short ones.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(_BATCH, "1g") == "1g":
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files a core, below which a table's rows are dealt out to all cores.
CORE_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its files are so small that a few splits, or one row group, would hold all the work.

    Larger tables keep the splits of their files: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * CORE_BYTES else df
