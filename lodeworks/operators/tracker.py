"""Jobs, steps, metrics and logs as tables: reads, figures, and states derived from appended events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The pipeline's steps in order.
STEPS = ("initialization", "url_discovery", "scraping", "document_upload", "merging", "processing", "embedding", "deduplication", "upload", "validation")
ACTIVE, DONE = ("running", "in_progress"), ("completed", "failed", "skipped")


def step_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(STEPS)], "step_order int, step_name string")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: one aggregation, without a sort of the key's rows. Ties go to the largest other fields."""
    fields = [c for c in rows.columns if c != key]
    top = rows.groupBy(key).agg(F.max(F.struct(*(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), F.struct(*fields).alias("__row"))).alias("__top"))
    return top.select(key, "__top.__row.*")


def at_maximum(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """All rows of each key at its largest time: ties stay."""
    top = rows.groupBy(F.col(key).alias("__k")).agg(F.max(ts).alias("__m"))
    return rows.join(top, (F.col(key) == F.col("__k")) & (F.col(ts) == F.col("__m"))).drop("__k", "__m")


def current_step(steps: DataFrame, job: str = "job_id") -> DataFrame:
    """Each job's running step, the last one if several run."""
    return latest(steps.where(F.col("status").isin(*ACTIVE)), job, ["step_order"])


def job_stats(jobs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Counts by status, mean duration of completed jobs, and sums over each job's last metrics, ties counted twice."""
    s = F.col("status")
    took = F.when((s == "completed") & F.col("end_time").isNotNull(), F.col("end_time") - F.col("start_time"))
    counts = jobs.agg(F.count("*").alias("total"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "running").alias("running"), F.avg(took).alias("avg_duration"))
    sums = at_maximum(metrics, "job_id", "ts").agg(F.sum("vectors").alias("total_vectors"), F.sum("urls").alias("total_urls"))
    return counts.crossJoin(sums)  # one row by one row


def job_detail(jobs: DataFrame, steps: DataFrame, metrics: DataFrame, logs: DataFrame, last: int = 50) -> DataFrame:
    """Jobs with their last metrics, steps in order and last log lines, by joins rather than a lookup per job."""
    m = latest(metrics, "job_id", ["ts"]).select("job_id", F.struct(*[c for c in metrics.columns if c != "job_id"]).alias("metrics"))
    s = steps.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("step_order", "step_name", "status", "progress"))).alias("steps"))
    recent = logs.withColumn("__r", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("message")))).where(F.col("__r") <= last)
    g = recent.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("ts", "level", "message"))).alias("logs"))
    return jobs.join(m, "job_id", "left").join(s, "job_id", "left").join(g, "job_id", "left")


def history(jobs: DataFrame, n: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("start_time"), F.desc("job_id")).limit(n)


def step_logs(logs: DataFrame, job: str, step: str | None = None) -> DataFrame:
    rows = logs.where(F.col("job_id") == job)
    rows = rows if step is None else rows.where(F.col("step_name") == step)
    return rows.orderBy("ts").withColumn("time", F.date_format(F.timestamp_seconds("ts"), "HH:mm:ss"))


def timeline(steps: DataFrame, logs: DataFrame) -> DataFrame:
    """Steps with durations, states and their logs."""
    g = logs.groupBy("job_id", "step_name").agg(F.sort_array(F.collect_list(F.struct("ts", "level", "message"))).alias("logs"))
    rows = steps.join(g, ["job_id", "step_name"], "left")
    return rows.withColumns({"duration": F.col("end_time") - F.col("start_time"), "is_active": F.col("status").isin(*ACTIVE), "is_complete": F.col("status").isin(*DONE), "logs": F.coalesce("logs", F.array())})


def retained(jobs: DataFrame, before: Column) -> DataFrame:
    """Jobs without the finished ones from before a time."""
    return jobs.where(~((F.col("start_time") < before) & F.col("status").isin("completed", "failed", "stopped")))


def matching_jobs(jobs: DataFrame, text: str = "", status: str | None = None) -> DataFrame:
    """Jobs whose id, kind or any address holds a text, whatever the case, and whose status is the one given."""
    needle = F.lit(text.lower())
    found = F.contains(F.lower("job_id"), needle) | F.contains(F.lower("kind"), needle) | F.exists("input_urls", lambda u: F.contains(F.lower(u), needle))
    return jobs.where(found if status is None else found & (F.col("status") == status))


def duration_text(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(F.round(seconds).cast("int").cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(F.round(seconds / 60).cast("int").cast("string"), F.lit("m"))).otherwise(F.concat(F.round(seconds / 3600).cast("int").cast("string"), F.lit("h")))


def started(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """The events of jobs that start: one row per step, pending."""
    return jobs.select("job_id", "ts").crossJoin(F.broadcast(steps)).withColumns({"status": F.lit("pending"), "progress": F.lit(0.0)})  # ten steps


def state(events: DataFrame) -> DataFrame:
    """Steps as their last event left them: the log of events is the only thing that is ever written."""
    last = events.groupBy("job_id", "step_name").agg(
        F.max(F.struct("ts", "status"))["status"].alias("status"), F.max(F.when(F.col("progress").isNotNull(), F.struct("ts", "progress")))["progress"].alias("progress"),
        F.min(F.when(F.col("status").isin(*ACTIVE), F.col("ts"))).alias("start_time"), F.max(F.when(F.col("status").isin(*DONE), F.col("ts"))).alias("end_time"),
    )
    return last


def last_errors(logs: DataFrame, n: int = 10) -> DataFrame:
    return logs.where(F.col("level") == "ERROR").orderBy(F.desc("ts"), *(c for c in logs.columns if c != "ts")).limit(n)


def flat_logs(jobs: DataFrame, logs: str = "logs", order: str = "ts") -> DataFrame:
    """The log lines of all jobs that carry theirs as a list, each with its job, in order of time."""
    rows = jobs.select("job_id", F.explode(logs).alias("__l")).select("job_id", "__l.*")
    return rows.orderBy(order, "job_id", *(c for c in rows.columns if c not in (order, "job_id")))


#: Columns of the tracker's tables; a log of events is all that is written.
TABLES = {
    "jobs": "job_id string, status string, start_time double, end_time double, input_urls array<string>, error_message string",
    "steps": "job_id string, step_name string, step_order int, status string, ts double, progress double, items_total long, items_processed long",
    "metrics": "job_id string, ts double, total_urls long, processed_urls long, successful_urls long, failed_urls long, total_chunks long, total_embeddings long, total_vectors long, duplicate_count long",
    "logs": "job_id string, ts double, level string, message string, step_name string",
}


def create_tables(spark: SparkSession, root: str) -> None:
    """The tracker's tables under a folder, where they aren't yet."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def record(rows: DataFrame, root: str, name: str) -> None:
    """Appends rows to one of the tracker's tables; columns they lack are null, a later version's columns are kept out."""
    lacking = [f for f in rows.sparkSession.createDataFrame([], TABLES[name]).schema]
    rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in lacking)).write.mode("append").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def without_jobs(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows of other tables whose job is gone too."""
    return rows.join(jobs.select("job_id"), "job_id", "left_anti")
