"""Writing results: JSON, stage tables, snapshots and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_interactions(df: DataFrame, path: str) -> None:
    """One JSON line per interaction, behind those that are there."""
    df.write.mode("append").json(path)


def write_results(chunks: DataFrame, quality: DataFrame, duplicates: DataFrame, path: str) -> None:
    """Chunks, their quality by id, duplicates and a summary, each in a folder of its own."""
    write_json(chunks, f"{path}/chunks")
    write_json(quality, f"{path}/quality")
    write_json(duplicates, f"{path}/duplicates")
    summary = chunks.agg(F.count("*").alias("chunks"), F.avg("char_count").alias("average_chars")).crossJoin(duplicates.agg(F.count("*").alias("with_duplicates")))  # one row by one row
    write_json(summary, f"{path}/summary")


def save_stage(df: DataFrame, path: str, stage: str) -> DataFrame:
    """A stage's result as a table, and the table."""
    df.write.mode("overwrite").parquet(f"{path}/{stage}_results")
    return load_stage(df.sparkSession, path, stage)


def load_stage(spark: SparkSession, path: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{stage}_results")


def drop_stage(spark: SparkSession, path: str, stage: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{stage}_results")
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def snapshot(metrics: DataFrame, path: str, stamp: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/snapshot-{stamp}")


def restore(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metrics of all snapshots under a folder, the earlier ones among them, to go on from."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)


def log_metric(spark: SparkSession, path: str, name: str, seconds: float, details: str, ts: float) -> None:
    """One measured operation, as a JSON line behind those that are there."""
    spark.createDataFrame([(name, float(seconds), details, float(ts))], "name string, seconds double, details string, ts double").coalesce(1).write.mode("append").json(path)


def scraping_report(pages: DataFrame) -> DataFrame:
    """Pages by type and outcome, with words: the figures of a scrape."""
    ok = F.col("error").isNull()
    return pages.groupBy("page_type").agg(F.count("*").alias("pages"), F.count_if(ok).alias("succeeded"), F.sum(F.when(ok, F.col("word_count")).otherwise(0)).alias("words"))


def discovery_report(urls: DataFrame, example: int = 5) -> DataFrame:
    """Addresses by category, with the first few of each as examples, a feature of the report."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy("url"))
    few = urls.withColumn("__r", rank).where(F.col("__r") <= example).groupBy("category").agg(F.sort_array(F.collect_list("url")).alias("examples"))
    return urls.groupBy("category").agg(F.count("*").alias("n")).join(few, "category")


def save_scrape(pages: DataFrame, urls: DataFrame, path: str) -> None:
    """The pages, their summary, and the reports of discovery and scraping, each in a folder of its own."""
    write_json(pages, f"{path}/pages")
    write_json(pages.agg(F.count("*").alias("pages"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.sum("word_count").alias("words")), f"{path}/summary")
    write_json(discovery_report(urls), f"{path}/discovery")
    write_json(scraping_report(pages), f"{path}/scraping")


def backup(table: DataFrame, path: str) -> None:
    table.write.mode("errorifexists").parquet(path)
