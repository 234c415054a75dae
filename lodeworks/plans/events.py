"""Queries of analytics, monitoring, job tracking and time windows; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import analytics, incremental, tracker
from lodeworks.sources import table


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chat interactions: the user as session, the value as latency and confidence."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"), F.concat(F.lit(" "), F.upper(kind), F.lit(" "), (F.col("user_id") % 7).cast("string")).alias("user_query"),
        kind.alias("category"), F.floor(F.col("value") * 50).cast("long").alias("response_time_ms"), ((F.col("event_id") % 101) / 100.0).alias("confidence_score"), (kind == "error").alias("error_occurred"), F.when(kind == "error", F.concat(F.lit("code "), (F.col("user_id") % 3).cast("string"))).alias("error_message"),
    )


I_SQL = """
WITH i AS (SELECT event_id AS seq, ts, user_id AS session_id, ' ' || upper(event_type) || ' ' || user_id % 7 AS user_query, event_type AS category, floor(value * 50)::BIGINT AS response_time_ms,
  (event_id % 101) / 100.0::DOUBLE AS confidence_score, event_type = 'error' AS error_occurred, CASE WHEN event_type = 'error' THEN 'code ' || user_id % 3 END AS error_message FROM events),
r AS (SELECT * FROM i WHERE ts >= (SELECT max(ts) FROM i) - INTERVAL 24 HOURS)
"""


def _recent(spark, sf_dir):
    return analytics.since(interactions(spark, sf_dir), "24 HOURS")


def usage_stats(spark, sf_dir):
    u = analytics.usage(_recent(spark, sf_dir))
    return u.select("total_queries", "unique_sessions", *(F.round(c, 6).alias(c) for c in ("average_response_time", "success_rate", "average_confidence")))


def latency_stats(spark, sf_dir):
    return analytics.latency(interactions(spark, sf_dir)).withColumn("average", F.round("average", 6))


def latency_by_category(spark, sf_dir):
    return analytics.latency(interactions(spark, sf_dir), by="category").withColumn("average", F.round("average", 6))


def _latency_sql(by: str = "") -> str:
    cols, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return I_SQL + f", o AS (SELECT {cols}response_time_ms AS v, row_number() OVER ({part}ORDER BY response_time_ms) - 1 AS k, count(*) OVER ({part}) AS n FROM i) SELECT {cols}min(v) AS min, max(v) AS max, round(avg(v), 6) AS average, max(CASE WHEN k = n // 2 THEN v END) AS median, max(CASE WHEN k = floor(n * 0.95::DOUBLE)::BIGINT THEN v END) AS p95 FROM o" + (f" GROUP BY {by}" if by else "")


def popular_queries(spark, sf_dir):
    return analytics.popular(interactions(spark, sf_dir)).select("query", "n", F.round("average_confidence", 6).alias("average_confidence"), F.round("average_response_time", 6).alias("average_response_time"))


POPULAR_SQL = I_SQL + "SELECT trim(lower(user_query)) AS query, count(*) AS n, round(avg(confidence_score), 6) AS average_confidence, round(avg(response_time_ms), 6) AS average_response_time FROM i WHERE length(trim(lower(user_query))) > 5 GROUP BY 1 ORDER BY n DESC, min(seq) LIMIT 10"


def error_analysis(spark, sf_dir):
    return analytics.errors(_recent(spark, sf_dir)).withColumn("error_rate", F.round("error_rate", 6))


def error_messages(spark, sf_dir):
    return analytics.histogram(interactions(spark, sf_dir), "error_message")


def query_categories(spark, sf_dir):
    return analytics.histogram(_recent(spark, sf_dir), "category")


def health_alerts(spark, sf_dir):
    h = analytics.health(analytics.since(interactions(spark, sf_dir), "5 MINUTES"))
    return h.select("queries", F.round("average_response_time", 6).alias("average_response_time"), F.round("error_rate", 6).alias("error_rate"), "status", F.array_join("alerts", "; ").alias("alerts"))


HEALTH_SQL = (
    I_SQL
    + """, m AS (SELECT count(*) AS queries, coalesce(avg(response_time_ms), 0) AS t, coalesce(avg(error_occurred::INT), 0) AS e FROM i WHERE ts >= (SELECT max(ts) FROM i) - INTERVAL 5 MINUTES)
SELECT queries, round(t, 6) AS average_response_time, round(e, 6) AS error_rate, CASE WHEN e > 0.1 THEN 'critical' WHEN t > 5000 THEN 'warning' ELSE 'healthy' END AS status,
  array_to_string(list_filter([CASE WHEN t > 5000 THEN 'High response times detected' END, CASE WHEN e > 0.1 THEN 'High error rate detected' END, CASE WHEN queries > 100 THEN 'High query volume detected' END], lambda x: x IS NOT NULL), '; ') AS alerts FROM m"""
)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pipeline metrics."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.concat("l_returnflag", "l_linestatus").alias("component"), (F.col("l_quantity") / 4.0).alias("duration_seconds"), (F.col("l_linenumber") * 3).alias("items_processed"), (F.col("l_partkey") % 3).cast("int").alias("error_count"))
    return analytics.derived(rows)


M_SQL = """
WITH b AS (SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag || l_linestatus AS component, l_quantity / 4.0::DOUBLE AS duration_seconds, l_linenumber * 3 AS items_processed, (l_partkey % 3)::INT AS error_count FROM lineitem),
m AS (SELECT *, CASE WHEN duration_seconds > 0 THEN items_processed / duration_seconds ELSE 0 END AS throughput, CASE WHEN items_processed > 0 THEN (items_processed - error_count) / items_processed ELSE 0 END AS success_rate FROM b),
a AS (SELECT id, line, component, 'throughput' AS metric, CASE WHEN throughput < 0.1 THEN 'critical' ELSE 'warning' END AS severity, throughput::DOUBLE AS value FROM m WHERE throughput < 1
  UNION ALL SELECT id, line, component, 'error_rate', CASE WHEN 1.0::DOUBLE - success_rate >= 0.1 THEN 'critical' ELSE 'warning' END, 1.0::DOUBLE - success_rate FROM m WHERE 1.0::DOUBLE - success_rate >= 0.05
  UNION ALL SELECT id, line, component, 'response_time', CASE WHEN duration_seconds >= 10 THEN 'critical' ELSE 'warning' END, duration_seconds FROM m WHERE duration_seconds >= 5)
"""


def perf_report(spark, sf_dir):
    r = analytics.component_report(metrics(spark, sf_dir))
    return r.select("component", "operations", *(F.round(c, 6).alias(c) for c in ("avg_throughput", "max_throughput", "avg_duration", "max_duration")), F.col("total_errors").cast("long").alias("total_errors"))


PERF_SQL = M_SQL + "SELECT component, count(*) AS operations, round(avg(throughput), 6) AS avg_throughput, round(max(throughput), 6) AS max_throughput, round(avg(duration_seconds), 6) AS avg_duration, round(max(duration_seconds), 6) AS max_duration, sum(error_count)::BIGINT AS total_errors FROM m GROUP BY component"


def threshold_alerts(spark, sf_dir):
    return analytics.pipeline_alerts(metrics(spark, sf_dir), ("id", "line")).select("id", "line", "component", "metric", "severity", F.round("value", 6).alias("value"))


def alert_pivot(spark, sf_dir):
    return analytics.alert_pivot(analytics.pipeline_alerts(metrics(spark, sf_dir)))


def system_alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("cpu_percent"), (F.col("event_id") % 100).cast("double").alias("memory_percent"), (F.col("user_id") % 97).cast("double").alias("disk_usage_percent"))
    return analytics.system_alerts(e, ("event_id",)).groupBy("metric", "severity").agg(F.count("*").alias("n"))


SYSTEM_SQL = """
WITH a AS (SELECT unnest([{'m': 'cpu_percent', 'v': value, 'w': 80.0::DOUBLE, 'c': 95.0::DOUBLE}, {'m': 'memory_percent', 'v': (event_id % 100)::DOUBLE, 'w': 85.0::DOUBLE, 'c': 95.0::DOUBLE}, {'m': 'disk_usage_percent', 'v': (user_id % 97)::DOUBLE, 'w': 85.0::DOUBLE, 'c': 95.0::DOUBLE}]) AS x FROM events)
SELECT x.m AS metric, CASE WHEN x.v >= x.c THEN 'critical' ELSE 'warning' END AS severity, count(*) AS n FROM a WHERE x.v >= x.w GROUP BY 1, 2
"""


def current_stats(spark, sf_dir):
    e = interactions(spark, sf_dir)
    hour = analytics.since(e, "1 HOUR").agg(F.count("*").alias("events_1hour"), F.count_if("error_occurred").alias("errors_1hour"))
    five = analytics.since(e, "5 MINUTES").agg(F.count("*").alias("events_5min"), F.round(F.avg("response_time_ms"), 6).alias("avg_response_5min"))
    return hour.crossJoin(five)  # one row by one row


CURRENT_SQL = I_SQL + "SELECT (SELECT count(*) FROM i WHERE ts >= m - INTERVAL 1 HOUR) AS events_1hour, (SELECT count_if(error_occurred)::BIGINT FROM i WHERE ts >= m - INTERVAL 1 HOUR) AS errors_1hour, (SELECT count(*) FROM i WHERE ts >= m - INTERVAL 5 MINUTES) AS events_5min, (SELECT round(avg(response_time_ms), 6) FROM i WHERE ts >= m - INTERVAL 5 MINUTES) AS avg_response_5min FROM (SELECT max(ts) AS m FROM i)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    start = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderpriority").alias("kind"), start.alias("start_time"), F.when(status != "running", start + F.floor("o_totalprice")).alias("end_time"))


def job_metrics(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("double").alias("ts"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("vectors"), F.col("l_partkey").alias("urls"))


def job_steps(spark, sf_dir):
    status = F.when(F.col("l_linestatus") == "O", "running").when(F.col("l_returnflag") == "A", "failed").otherwise("completed")
    start = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("step_order"), F.concat(F.lit("step "), F.col("l_linenumber").cast("string")).alias("step_name"), status.alias("status"), F.when(status != "failed", F.round(F.col("l_discount") * 1000)).alias("progress"), start.alias("start_time"), F.when(status != "running", start + F.col("l_quantity")).alias("end_time"), (F.col("l_partkey") % 200).alias("items_total"), F.col("l_suppkey").alias("items_processed"))


J_SQL = """
WITH j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status, o_orderpriority AS kind, epoch(o_orderdate)::DOUBLE AS start_time,
  CASE WHEN o_orderstatus IN ('F', 'P') THEN epoch(o_orderdate)::DOUBLE + floor(o_totalprice) END AS end_time FROM orders),
m AS (SELECT l_orderkey AS job_id, epoch(l_shipdate)::DOUBLE AS ts, l_linenumber AS line, l_quantity::BIGINT AS vectors, l_partkey AS urls FROM lineitem),
s AS (SELECT *, CASE WHEN status <> 'running' THEN start_time + q END AS end_time, CASE WHEN status <> 'failed' THEN round(d * 1000) END AS progress FROM
  (SELECT l_orderkey AS job_id, l_linenumber AS step_order, 'step ' || l_linenumber AS step_name, CASE WHEN l_linestatus = 'O' THEN 'running' WHEN l_returnflag = 'A' THEN 'failed' ELSE 'completed' END AS status,
   epoch(l_shipdate)::DOUBLE AS start_time, l_quantity AS q, l_discount AS d, l_partkey % 200 AS items_total, l_suppkey AS items_processed FROM lineitem))
"""


def job_stats(spark, sf_dir):
    s = tracker.job_stats(jobs(spark, sf_dir), job_metrics(spark, sf_dir))
    return s.withColumn("avg_duration", F.round("avg_duration", 6))


JOB_STATS_SQL = J_SQL + """, c AS (SELECT count(*) AS total, count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'running')::BIGINT AS running,
  round(avg(CASE WHEN status = 'completed' THEN end_time - start_time END), 6) AS avg_duration FROM j),
l AS (SELECT sum(vectors)::BIGINT AS total_vectors, sum(urls)::BIGINT AS total_urls FROM m JOIN (SELECT job_id, max(ts) AS t FROM m GROUP BY job_id) x ON m.job_id = x.job_id AND m.ts = x.t)
SELECT * FROM c, l"""


def job_latest_metrics(spark, sf_dir):
    return tracker.latest(job_metrics(spark, sf_dir), "job_id", ["ts", "line"])


def job_current_step(spark, sf_dir):
    return tracker.current_step(job_steps(spark, sf_dir)).select("job_id", "step_order", "step_name")


def job_history(spark, sf_dir):
    return tracker.history(jobs(spark, sf_dir), 20)


def job_retention(spark, sf_dir):
    return tracker.retained(jobs(spark, sf_dir), F.lit(8.5e8)).groupBy("status").agg(F.count("*").alias("n"))


def status_counts(spark, sf_dir):
    return analytics.histogram(jobs(spark, sf_dir), "status")


def job_steps_timeline(spark, sf_dir):
    steps = job_steps(spark, sf_dir)
    logs = steps.select("job_id", "step_name", F.col("start_time").alias("ts"), F.when(F.col("status") == "failed", "ERROR").otherwise("INFO").alias("level"), F.col("status").alias("message"))
    rows = tracker.timeline(steps, logs)
    return rows.select("job_id", "step_order", "duration", "is_active", "is_complete", F.array_join(F.transform("logs", lambda x: F.concat(x["level"], F.lit(" "), x["message"])), ";").alias("logs"))


TIMELINE_SQL = (
    J_SQL
    + """, g AS (SELECT job_id, step_name, string_agg(level || ' ' || status, ';' ORDER BY start_time, level, status) AS logs FROM
  (SELECT *, CASE WHEN status = 'failed' THEN 'ERROR' ELSE 'INFO' END AS level FROM s) GROUP BY ALL)
SELECT job_id, step_order, end_time - start_time AS duration, status = 'running' AS is_active, status IN ('completed', 'failed', 'skipped') AS is_complete, coalesce(logs, '') AS logs FROM s LEFT JOIN g USING (job_id, step_name)"""
)


def job_search(spark, sf_dir):
    rows = jobs(spark, sf_dir).withColumns({"job_id": F.col("job_id").cast("string"), "input_urls": F.array(F.concat(F.lit("https://example.com/"), F.col("kind")))})
    return tracker.matching_jobs(rows, "URGENT", "completed").select("job_id", "kind")


def job_durations(spark, sf_dir):
    return jobs(spark, sf_dir).where("end_time is not null").groupBy(tracker.duration_text((F.col("end_time") - F.col("start_time")) / 16).alias("took")).agg(F.count("*").alias("n"))


JOB_DURATIONS_SQL = J_SQL + "SELECT CASE WHEN d < 60 THEN round(d)::INT || 's' WHEN d < 3600 THEN round(d / 60)::INT || 'm' ELSE round(d / 3600)::INT || 'h' END AS took, count(*) AS n FROM (SELECT (end_time - start_time) / 16 AS d FROM j WHERE end_time IS NOT NULL) GROUP BY took"


def job_detail(spark, sf_dir):
    steps = job_steps(spark, sf_dir)
    logs = steps.select("job_id", F.col("start_time").alias("ts"), F.lit("INFO").alias("level"), "step_name", F.concat("step_name", F.lit(" "), "status").alias("message"))
    d = tracker.job_detail(jobs(spark, sf_dir), steps, job_metrics(spark, sf_dir).drop("line").groupBy("job_id", "ts").agg(F.max("vectors").alias("vectors")), logs)
    return d.select("job_id", "status", F.col("metrics.vectors").alias("vectors"), F.size("steps").alias("steps"), F.size("logs").alias("logs"))


JOB_DETAIL_SQL = J_SQL + """, l AS (SELECT job_id, arg_max(v, ts) AS vectors FROM (SELECT job_id, ts, max(vectors) AS v FROM m GROUP BY ALL) GROUP BY job_id), n AS (SELECT job_id, count(*) AS k FROM s GROUP BY job_id)
SELECT j.job_id, j.status, l.vectors, k::INT AS steps, CASE WHEN k IS NOT NULL THEN least(k, 50) END::INT AS logs FROM j LEFT JOIN l USING (job_id) LEFT JOIN n USING (job_id)"""


def step_rates(spark, sf_dir):
    v = analytics.step_view(job_steps(spark, sf_dir).withColumn("now", F.lit(9.5e8)))
    return v.select("job_id", "step_order", "duration", F.round("items_per_second", 6).alias("items_per_second"))


STEP_RATES_SQL = J_SQL + """, d AS (SELECT *, coalesce(end_time, 9.5e8::DOUBLE) - start_time AS duration FROM s)
SELECT job_id, step_order, duration, round(CASE WHEN duration > 0 THEN items_processed / duration ELSE 0 END, 6) AS items_per_second FROM d"""


def result_ratios(spark, sf_dir):
    """Customers' orders as runs: orders that ended well of all, failed ones among those that ended."""
    by = jobs(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("run")), "job_id")
    s = F.col("status")
    runs = by.groupBy("run").agg(F.count("*").alias("total"), F.count_if(s == "completed").alias("uploaded"), F.count_if(s != "running").alias("attempted"), F.count_if(s == "completed").alias("succeeded"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.collect_set(F.when(s == "failed", F.col("kind"))).alias("sources"))
    return analytics.ratios(runs).select("run", F.round("upload_rate", 6).alias("upload_rate"), F.round("success_percent", 6).alias("success_percent"), "duration_seconds", "has_sources")


RESULT_RATIOS_SQL = J_SQL + """, r AS (SELECT o_custkey AS run, count(*) AS total, count_if(status = 'completed') AS good, count_if(status <> 'running') AS ended, count_if(status = 'failed') AS bad, min(start_time) AS a, max(end_time) AS b
  FROM j JOIN orders ON job_id = o_orderkey GROUP BY o_custkey)
SELECT run, round(good / total, 6) AS upload_rate, round(CASE WHEN ended > 0 THEN good / ended * 100 ELSE 0 END, 6) AS success_percent, b - a AS duration_seconds, bad > 0 AS has_sources FROM r"""


def job_logs_flat(spark, sf_dir):
    steps = job_steps(spark, sf_dir)
    by = steps.groupBy("job_id").agg(F.collect_list(F.struct(F.col("start_time").alias("ts"), F.when(F.col("status") == "failed", "ERROR").otherwise("INFO").alias("level"), "step_order")).alias("logs"))
    return tracker.flat_logs(by)


JOB_LOGS_FLAT_SQL = J_SQL + "SELECT job_id, start_time AS ts, CASE WHEN status = 'failed' THEN 'ERROR' ELSE 'INFO' END AS level, step_order FROM s"


def scrape_report(spark, sf_dir):
    """Pages as a scrape's outcome: one whose id is divisible by seven failed, as an example of an error."""
    from lodeworks.functions.text import word_count
    from lodeworks.functions.urls import page_type
    from lodeworks.sources import sinks

    p = table(spark, sf_dir, "pages").select(page_type(F.col("url")).alias("page_type"), word_count(F.col("html")).alias("word_count"), F.when(F.col("page_id") % 7 == 0, "status 500").alias("error"))
    return sinks.scraping_report(p)


def step_progress(spark, sf_dir):
    return analytics.progress(job_steps(spark, sf_dir)).withColumn("progress", F.round("progress", 6))


STEP_PROGRESS_SQL = J_SQL + ", w AS (SELECT *, coalesce([0.15, 0.20, 0.45, 0.15, 0.05]::DOUBLE[][step_order], 0.1::DOUBLE) AS w FROM s) SELECT job_id, round(sum(coalesce(progress, 0) * w) / sum(w), 6) AS progress FROM w GROUP BY job_id".replace("[0.15, 0.20, 0.45, 0.15, 0.05]::DOUBLE[][step_order]", "list_extract([0.15, 0.20, 0.45, 0.15, 0.05]::DOUBLE[], step_order)")


def eta(spark, sf_dir):
    rows = job_steps(spark, sf_dir).where("end_time is not null").withColumn("elapsed", F.col("end_time") - F.col("start_time"))
    r = analytics.rate_and_eta(rows)
    return r.select("job_id", "step_order", F.round("rate", 6).alias("rate"), F.round("eta_seconds", 4).alias("eta_seconds"), F.round("percent", 4).alias("percent"), analytics.eta_text(F.col("eta_seconds")).alias("eta"))


ETA_SQL = J_SQL + """, r AS (SELECT job_id, step_order, items_processed, items_total, CASE WHEN q > 0 THEN items_processed / q END AS rate FROM s WHERE end_time IS NOT NULL),
e AS (SELECT *, greatest(items_total - items_processed, 0) / nullif(rate, 0) AS left_s FROM r)
SELECT job_id, step_order, round(rate, 6) AS rate, round(left_s, 4) AS eta_seconds, round(least(100, CASE WHEN items_total > 0 THEN items_processed * 100.0::DOUBLE / items_total ELSE 0 END), 4) AS percent,
  CASE WHEN floor(left_s) < 60 THEN floor(left_s)::BIGINT || 's' WHEN floor(left_s) < 3600 THEN floor(left_s / 60)::BIGINT || 'm ' || (floor(left_s)::BIGINT % 60) || 's' WHEN left_s IS NOT NULL THEN floor(left_s / 3600)::BIGINT || 'h ' || (floor(left_s)::BIGINT % 3600) // 60 || 'm' END AS eta FROM e"""


def stage_success(spark, sf_dir):
    counts = jobs(spark, sf_dir).agg(F.count("*").alias("found"), F.count_if(F.col("status") != "failed").alias("scraped"), F.count_if(F.col("status") == "completed").alias("loaded"))
    r = analytics.stage_rates(counts, ("found", "scraped", "loaded"))
    return r.select("found", "scraped", "loaded", F.round("scraped_rate", 6).alias("scraped_rate"), F.round("loaded_rate", 6).alias("loaded_rate"))


STAGE_SQL = J_SQL + ", c AS (SELECT count(*) AS found, count_if(status <> 'failed')::BIGINT AS scraped, count_if(status = 'completed')::BIGINT AS loaded FROM j) SELECT *, round(scraped / found, 6) AS scraped_rate, round(loaded / scraped, 6) AS loaded_rate FROM c"


def operation_times(spark, sf_dir):
    from lodeworks.operators.vectors import operation_times as times

    return times(table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), F.col("value").alias("seconds")))


def win_tumbling(spark, sf_dir):
    e = interactions(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "category").agg(F.count("*").alias("n"), F.round(F.avg("response_time_ms"), 6).alias("avg_ms"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "category", "n", "avg_ms")


def win_sliding(spark, sf_dir):
    e = interactions(spark, sf_dir).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


WIN_SLIDING_SQL = I_SQL + ", b AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM i) SELECT start, count(*) AS n FROM b GROUP BY start"


def win_session(spark, sf_dir):
    e = interactions(spark, sf_dir).groupBy("session_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("session_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


WIN_SESSION_SQL = I_SQL + ", g AS (SELECT session_id, ts, CASE WHEN ts - lag(ts) OVER p < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM i WINDOW p AS (PARTITION BY session_id ORDER BY ts)), k AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT session_id, min(ts) AS start, count(*) AS n FROM k GROUP BY session_id, s"


def last_n(spark, sf_dir):
    return analytics.last_rows(interactions(spark, sf_dir), 1000, tie="seq").select("seq")


def last_n_by_key(spark, sf_dir):
    return analytics.last_rows(interactions(spark, sf_dir), 10, by="session_id", tie="seq").select("session_id", "seq")


def page_length_buckets(spark, sf_dir):
    from lodeworks.functions.text import word_count

    return analytics.length_buckets(table(spark, sf_dir, "documents").select(word_count(F.col("text")).alias("word_count")))


def page_type_report(spark, sf_dir):
    from lodeworks.functions.text import word_count
    from lodeworks.functions.urls import page_type

    p = table(spark, sf_dir, "pages").select(page_type(F.col("url")).alias("page_type"), word_count(F.col("html")).alias("word_count"), F.length("html").alias("content_length"))
    return analytics.page_report(p)


def _bucket_sql() -> str:
    from lodeworks.plans.text import words_sql

    return f"WITH w AS (SELECT len({words_sql('text')}) AS w FROM documents) SELECT count(*) AS pages, count_if(w < 100)::BIGINT AS short, count_if(w >= 100 AND w < 500)::BIGINT AS medium, count_if(w >= 500)::BIGINT AS long FROM w"


def _page_report_sql() -> str:
    from lodeworks.functions.urls import PAGE_TYPES
    from lodeworks.plans.text import _case, words_sql

    return f"""WITH p AS (SELECT lower(url) AS l, len({words_sql('html')}) AS w, length(html) AS n FROM pages),
t AS (SELECT CASE WHEN ends_with(l, '/') AND length(l) - length(replace(l, '/', '')) <= 3 THEN 'homepage' ELSE {_case('l', PAGE_TYPES, "'other'")} END AS page_type, w, n FROM p)
SELECT page_type, count(*) AS pages, sum(w)::BIGINT AS words, sum(n)::BIGINT AS characters, (sum(w) // count(*))::BIGINT AS average_words FROM t GROUP BY page_type"""


def _scrape_report_sql() -> str:
    from lodeworks.functions.urls import PAGE_TYPES
    from lodeworks.plans.text import _case, words_sql

    return f"""WITH p AS (SELECT lower(url) AS l, len({words_sql('html')}) AS w, page_id % 7 <> 0 AS ok FROM pages),
t AS (SELECT CASE WHEN ends_with(l, '/') AND length(l) - length(replace(l, '/', '')) <= 3 THEN 'homepage' ELSE {_case('l', PAGE_TYPES, "'other'")} END AS page_type, w, ok FROM p)
SELECT page_type, count(*) AS pages, count_if(ok)::BIGINT AS succeeded, sum(CASE WHEN ok THEN w ELSE 0 END)::BIGINT AS words FROM t GROUP BY page_type"""


#: The day that parts two snapshots of what users did.
SNAPSHOT_DAY = "2024-01-16"


def snapshot_changes(spark, sf_dir):
    """How often users did what at which hour, before a day and from it on, as two snapshots: what came, changed and went."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    profile = lambda rows: rows.groupBy("user_id", "event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    day = F.lit(SNAPSHOT_DAY).cast("timestamp_ntz")
    return incremental.changes(profile(e.where(F.col("ts") < day)), profile(e.where(F.col("ts") >= day)), ["user_id", "event_type", "hour"])


SNAPSHOT_SQL = f"""
WITH e AS (SELECT user_id, event_type, hour(ts)::INT AS hour, ts < TIMESTAMP '{SNAPSHOT_DAY}' AS early FROM events WHERE ts IS NOT NULL),
n AS (SELECT user_id, event_type, hour, count_if(early) AS a, count_if(NOT early) AS b FROM e GROUP BY 1, 2, 3)
SELECT user_id, event_type, hour, CASE WHEN a = 0 THEN 'added' WHEN b = 0 THEN 'removed' ELSE 'changed' END AS change FROM n WHERE a <> b
"""

QUERIES = {
    "snapshot_changes": snapshot_changes,
    "usage_stats": usage_stats,
    "latency_stats": latency_stats,
    "latency_by_category": latency_by_category,
    "popular_queries": popular_queries,
    "error_analysis": error_analysis,
    "error_messages": error_messages,
    "query_categories": query_categories,
    "health_alerts": health_alerts,
    "perf_report": perf_report,
    "threshold_alerts": threshold_alerts,
    "alert_pivot": alert_pivot,
    "system_alerts": system_alerts,
    "current_stats": current_stats,
    "job_stats": job_stats,
    "job_latest_metrics": job_latest_metrics,
    "job_current_step": job_current_step,
    "job_history": job_history,
    "job_retention": job_retention,
    "status_counts": status_counts,
    "job_steps_timeline": job_steps_timeline,
    "job_search": job_search,
    "job_durations": job_durations,
    "job_detail": job_detail,
    "job_logs_flat": job_logs_flat,
    "step_rates": step_rates,
    "result_ratios": result_ratios,
    "scrape_report": scrape_report,
    "step_progress": step_progress,
    "eta": eta,
    "stage_success": stage_success,
    "operation_times": operation_times,
    "win_tumbling": win_tumbling,
    "win_sliding": win_sliding,
    "win_session": win_session,
    "last_n": last_n,
    "last_n_by_key": last_n_by_key,
    "page_length_buckets": page_length_buckets,
    "page_type_report": page_type_report,
}

ORACLES = {
    "snapshot_changes": SNAPSHOT_SQL,
    "usage_stats": I_SQL + "SELECT count(*) AS total_queries, count(DISTINCT session_id) AS unique_sessions, round(avg(response_time_ms), 6) AS average_response_time, round(avg((NOT error_occurred)::INT), 6) AS success_rate, round(avg(confidence_score), 6) AS average_confidence FROM r",
    "latency_stats": _latency_sql(),
    "latency_by_category": _latency_sql("category"),
    "popular_queries": POPULAR_SQL,
    "error_analysis": I_SQL + "SELECT count_if(error_occurred)::BIGINT AS total_errors, round(count_if(error_occurred) / count(*), 6) AS error_rate FROM r",
    "error_messages": I_SQL + "SELECT error_message, count(*) AS n FROM i WHERE error_message IS NOT NULL GROUP BY 1",
    "query_categories": I_SQL + "SELECT category, count(*) AS n FROM r GROUP BY 1",
    "health_alerts": HEALTH_SQL,
    "perf_report": PERF_SQL,
    "threshold_alerts": M_SQL + "SELECT id, line, component, metric, severity, round(value, 6) AS value FROM a",
    "alert_pivot": M_SQL + "SELECT component, count_if(severity = 'critical')::BIGINT AS critical, count_if(severity = 'warning')::BIGINT AS warning FROM a GROUP BY component",
    "system_alerts": SYSTEM_SQL,
    "current_stats": CURRENT_SQL,
    "job_stats": JOB_STATS_SQL,
    "job_latest_metrics": J_SQL + "SELECT job_id, ts, line, vectors, urls FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, line DESC, vectors DESC, urls DESC) AS k FROM m) WHERE k = 1",
    "job_current_step": J_SQL + "SELECT job_id, max(step_order) AS step_order, 'step ' || max(step_order) AS step_name FROM s WHERE status = 'running' GROUP BY job_id",
    "job_history": J_SQL + "SELECT job_id, status, kind, start_time, end_time FROM j ORDER BY start_time DESC, job_id DESC LIMIT 20",
    "job_retention": J_SQL + "SELECT status, count(*) AS n FROM j WHERE NOT (start_time < 8.5e8 AND status IN ('completed', 'failed', 'stopped')) GROUP BY status",
    "status_counts": J_SQL + "SELECT status, count(*) AS n FROM j GROUP BY status",
    "job_steps_timeline": TIMELINE_SQL,
    "job_search": J_SQL + "SELECT job_id::VARCHAR AS job_id, kind FROM j WHERE (contains(job_id::VARCHAR, 'urgent') OR contains(lower(kind), 'urgent')) AND status = 'completed'",
    "job_durations": JOB_DURATIONS_SQL,
    "job_detail": JOB_DETAIL_SQL,
    "job_logs_flat": JOB_LOGS_FLAT_SQL,
    "step_rates": STEP_RATES_SQL,
    "result_ratios": RESULT_RATIOS_SQL,
    "scrape_report": _scrape_report_sql(),
    "step_progress": STEP_PROGRESS_SQL,
    "eta": ETA_SQL,
    "stage_success": STAGE_SQL,
    "operation_times": "SELECT event_type AS operation, count(*) AS n, round(sum(value) / count(*), 6) AS avg_seconds FROM events GROUP BY 1",
    "win_tumbling": I_SQL + "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, category, count(*) AS n, round(avg(response_time_ms), 6) AS avg_ms FROM i GROUP BY 1, 2",
    "win_sliding": WIN_SLIDING_SQL,
    "win_session": WIN_SESSION_SQL,
    "last_n": I_SQL + "SELECT seq FROM i ORDER BY ts DESC, seq DESC LIMIT 1000",
    "last_n_by_key": I_SQL + "SELECT session_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) AS k FROM i) WHERE k <= 10",
    "page_length_buckets": _bucket_sql(),
    "page_type_report": _page_report_sql(),
}
