"""Figures of use, health and performance over event tables. Look-backs end at a given time, the table's last by default."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of alerts.
HIGH_IS_BAD = {"cpu_percent": (80.0, 95.0), "memory_percent": (85.0, 95.0), "disk_usage_percent": (85.0, 95.0)}
THROUGHPUT, ERROR_RATE, DURATION = (1.0, 0.1), (0.05, 0.1), (5.0, 10.0)
SLOW_MS, MANY_ERRORS, MANY_QUERIES = 5000, 0.1, 100
STEP_WEIGHTS = (0.15, 0.20, 0.45, 0.15, 0.05)
# End of fixed values.
#: Width of a band of latencies.
BAND = 1000


def since(rows: DataFrame, span: str, ts: str = "ts", end: Column | None = None) -> DataFrame:
    """Rows from a span before the end on; the end is the largest time where none is given."""
    if end is not None:
        return rows.where(F.col(ts) >= end - F.expr(f"INTERVAL {span}"))
    last = rows.agg(F.max(ts).alias("__end"))
    return rows.crossJoin(F.broadcast(last)).where(F.col(ts) >= F.col("__end") - F.expr(f"INTERVAL {span}")).drop("__end")  # one row


def usage(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total_queries"), F.countDistinct("session_id").alias("unique_sessions"), F.avg("response_time_ms").alias("average_response_time"),
        F.avg((~F.col("error_occurred")).cast("int")).alias("success_rate"), F.avg("confidence_score").alias("average_confidence"),
    )


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def latency(rows: DataFrame, value: str = "response_time_ms", by: str | None = None) -> DataFrame:
    """Minimum, maximum, mean, and the values at places n // 2 and int(n * 0.95) of the sorted list.

    Equal values are counted first. Running counts over distinct values then find the places, in bands of BAND units: what
    the bands below hold is summed up over the few bands, so that no task sees more than one band's values.
    """
    key = [by] if by else []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n")).withColumn("band", F.floor(F.col(value) / BAND))
    bands = counts.groupBy(*key, "band").agg(F.sum("n").alias("held"))
    below = Window.partitionBy(*key).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(*key, "band", F.coalesce(F.sum("held").over(below), F.lit(0)).alias("below"), F.sum("held").over(Window.partitionBy(*key)).alias("total"))
    placed = counts.join(bands, [*key, "band"]).withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy(*key, "band").orderBy(value)))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    return placed.groupBy(*key).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("average"),
        at(F.floor(F.col("total") / 2)).alias("median"), at(F.floor(F.col("total") * 0.95)).alias("p95"),
    ).where("min is not null")


def errors(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("error_occurred").alias("total_errors"), (F.count_if("error_occurred") / F.count("*")).alias("error_rate"))


def popular(rows: DataFrame, most: int = 10, query: str = "user_query", order: str = "seq") -> DataFrame:
    """The most frequent queries of more than five characters with mean confidence and latency; ties first seen first."""
    asked = rows.withColumn("query", F.trim(F.lower(query))).where(F.length("query") > 5)
    by = asked.groupBy("query").agg(F.count("*").alias("n"), F.avg("confidence_score").alias("average_confidence"), F.avg("response_time_ms").alias("average_response_time"), F.min(order).alias("first"))
    return by.orderBy(F.desc("n"), "first").limit(most)


def health(rows: DataFrame) -> DataFrame:
    """Status and alerts of some recent rows; healthy without any."""
    m = rows.agg(F.count("*").alias("queries"), F.coalesce(F.avg("response_time_ms"), F.lit(0.0)).alias("average_response_time"), F.coalesce(F.avg(F.col("error_occurred").cast("int")), F.lit(0.0)).alias("error_rate"))
    slow, wrong, many = F.col("average_response_time") > SLOW_MS, F.col("error_rate") > MANY_ERRORS, F.col("queries") > MANY_QUERIES
    alerts = F.array_compact(F.array(F.when(slow, F.lit("High response times detected")), F.when(wrong, F.lit("High error rate detected")), F.when(many, F.lit("High query volume detected"))))
    return m.withColumns({"status": F.when(wrong, "critical").when(slow, "warning").otherwise("healthy"), "alerts": alerts})


def derived(rows: DataFrame) -> DataFrame:
    """Pipeline metrics with throughput and success rate."""
    n, s, e = F.col("items_processed"), F.col("duration_seconds"), F.col("error_count")
    return rows.withColumns({"throughput": F.when(s > 0, n / F.when(s > 0, s)).otherwise(0.0), "success_rate": F.when(n > 0, (n - e) / F.when(n > 0, n)).otherwise(0.0)})


def _alert(component: Column, metric: str, value: Column, warning: float, critical: float, low: bool = False) -> Column:
    worse = lambda x: value < x if low else value >= x
    level = F.when(worse(critical), "critical").when(worse(warning), "warning")
    return F.when(level.isNotNull(), F.struct(component.alias("component"), F.lit(metric).alias("metric"), level.alias("severity"), value.cast("double").alias("value"), F.when(level == "critical", critical).otherwise(warning).alias("limit")))


def pipeline_alerts(metrics: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per broken limit of throughput, error rate and duration."""
    c = F.col("component")
    found = F.array_compact(F.array(_alert(c, "throughput", F.col("throughput"), *THROUGHPUT, low=True), _alert(c, "error_rate", 1.0 - F.col("success_rate"), *ERROR_RATE), _alert(c, "response_time", F.col("duration_seconds"), *DURATION)))
    return metrics.select(*keep, F.explode(found).alias("a")).select(*keep, "a.*")


def system_alerts(samples: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    found = F.array_compact(F.array(*(_alert(F.lit("system"), k, F.col(k), *v) for k, v in HIGH_IS_BAD.items())))
    return samples.select(*keep, F.explode(found).alias("a")).select(*keep, "a.*")


def component_report(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("component").agg(
        F.count("*").alias("operations"), F.avg("throughput").alias("avg_throughput"), F.max("throughput").alias("max_throughput"),
        F.avg("duration_seconds").alias("avg_duration"), F.max("duration_seconds").alias("max_duration"), F.sum("error_count").alias("total_errors"),
    )


def alert_pivot(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("component").pivot("severity", ["critical", "warning"]).agg(F.count(F.lit(1))).na.fill(0, ["critical", "warning"])


def page_report(pages: DataFrame) -> DataFrame:
    """Pages, words and characters by type, with whole means."""
    return pages.groupBy("page_type").agg(F.count("*").alias("pages"), F.sum("word_count").alias("words"), F.sum("content_length").alias("characters"), F.expr("sum(word_count) div count(*)").alias("average_words"))


def length_buckets(pages: DataFrame, column: str = "word_count") -> DataFrame:
    w = F.col(column)
    return pages.agg(F.count("*").alias("pages"), F.count_if(w < 100).alias("short"), F.count_if((w >= 100) & (w < 500)).alias("medium"), F.count_if(w >= 500).alias("long"))


def stage_rates(counts: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """Each stage's count by the one before; null where that is zero."""
    return counts.select("*", *(F.try_divide(F.col(b), F.col(a)).alias(f"{b}_rate") for a, b in zip(stages, stages[1:], strict=False)))


def ratios(results: DataFrame) -> DataFrame:
    """Runs with the share that was loaded, the share of pages that came, and whether there are sources; 0 of nothing is 0."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return results.withColumns({"upload_rate": share("uploaded", "total"), "success_percent": share("succeeded", "attempted") * 100, "duration_seconds": F.col("end_time") - F.col("start_time"), "has_sources": F.size("sources") > 0})


def step_view(steps: DataFrame) -> DataFrame:
    """Each step's duration, up to now if it runs, and items a second."""
    took = F.coalesce("end_time", F.col("now")) - F.col("start_time")
    return steps.withColumn("duration", took).withColumn("items_per_second", F.coalesce(F.try_divide(F.col("items_processed"), F.when(took > 0, took)), F.lit(0.0)))


def system_samples(spark, sample: Callable[[], dict[str, float]], times: int, pause: float = 1.0) -> DataFrame:
    """Rows of a given sampler of this machine, a pause apart."""
    rows = []
    for k in range(times):
        rows.append((k, time.time(), *(float(sample().get(name, 0.0)) for name in HIGH_IS_BAD)))
        time.sleep(pause if k + 1 < times else 0)
    return spark.createDataFrame(rows, "seq int, ts double, " + ", ".join(f"{name} double" for name in HIGH_IS_BAD))


def file_summary(files: DataFrame) -> DataFrame:
    ok = F.col("success")
    return files.agg(F.count("*").alias("files"), F.count_if(ok).alias("succeeded"), F.sum(F.when(ok, F.col("word_count"))).alias("words"), F.sum(F.when(ok, F.col("char_count"))).alias("characters"), F.avg(F.when(ok, F.col("word_count"))).alias("average_words"))


def progress(steps: DataFrame, job: str = "job_id") -> DataFrame:
    """Weighted progress of each job, by the step's place."""
    weights = F.array(*(F.lit(w) for w in STEP_WEIGHTS))
    w = F.coalesce(F.get(weights, F.col("step_order") - 1), F.lit(0.1))
    return steps.groupBy(job).agg((F.sum(F.coalesce("progress", F.lit(0.0)) * w) / F.sum(w)).alias("progress"))


def rate_and_eta(rows: DataFrame) -> DataFrame:
    """Items a second and seconds that remain, null where there is no rate."""
    rate = F.try_divide(F.col("items_processed"), F.col("elapsed"))
    left = F.greatest(F.col("items_total") - F.col("items_processed"), F.lit(0))
    return rows.withColumns({"rate": rate, "eta_seconds": F.try_divide(left, rate), "percent": F.least(F.lit(100.0), F.coalesce(F.try_divide(F.col("items_processed") * 100.0, F.col("items_total")), F.lit(0.0)))})


def eta_text(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(s % 3600 / 60).cast("string"), F.lit("m")))


def last_rows(rows: DataFrame, n: int = 1000, by: str | None = None, order: str = "ts", tie: str | None = None) -> DataFrame:
    """The last rows of the table, or of each key. Over a whole table this is a top-n, never a sort of it."""
    keys = [F.desc(order), *([F.desc(tie)] if tie else [])]
    if by is None:
        return rows.orderBy(*keys).limit(n)
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*keys))).where(F.col("__r") <= n).drop("__r")


def counted(rows: DataFrame, name: str, /, **figures: Column) -> DataFrame:
    """rows, with figures observed while they pass: read them with Observation.get after an action."""
    from pyspark.sql import Observation

    watch = Observation(name)
    out = rows.observe(watch, *(c.alias(k) for k, c in figures.items()))
    out.observation = watch
    return out
