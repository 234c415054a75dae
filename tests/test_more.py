"""Rules of loads, logs, reports and trackers on small tables."""

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import text
from lodeworks.operators import analytics, chat, crawl, dedup, tracker, vectors
from lodeworks.sources import pages as sources
from lodeworks.sources import sinks


def test_search_and_batch_search_rank_odd_vectors_alike(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0]), (5, None), (6, [0.5, 0.5])]
    held = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query array<double>")
    for metric in (vectors.COSINE, vectors.DOT, vectors.EUCLID, vectors.MANHATTAN):
        one = [(r.id, r.score) for r in vectors.search(held.where("embedding is not null"), [1.0, 0.0], 10, metric=metric).collect()]
        many = [(r.id, r.score) for r in vectors.batch_search(held, asked, 10, metric=metric).orderBy("rank").collect()]
        assert [i for i, _ in one] == [i for i, _ in many] and [s for _, s in one] == pytest.approx([s for _, s in many])
    assert [r.id for r in vectors.batch_search(held, asked, 10, threshold=0.5).orderBy("rank").collect()] == [1, 6]


def test_many_queries_are_searched_block_by_block(spark, monkeypatch):
    held = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "id long, embedding array<double>")
    asked = held.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    whole = sorted(map(tuple, vectors.batch_search(held, asked, 3).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, vectors.batch_search(held, asked, 3).collect())) == whole and len(whole) == 90


def test_collections_are_made_filled_checked_and_dropped(spark, tmp_path):
    at = f"file://{tmp_path}/c"
    assert not vectors.held(spark, at)
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "seq long, text string")
    assert tuple(vectors.upsert(spark, batch, at).first()) == (3, 2, 2)
    assert tuple(vectors.upsert(spark, batch, at).first()) == (3, 0, 2)
    assert vectors.held(spark, at) and vectors.known_hashes(spark.read.parquet(at)).count() == 2
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0])], "id long, embedding array<double>")
    probes = spark.createDataFrame([(7, [1.0, 0.1]), (8, [0.0, 0.0])], "query_id long, query array<double>")
    assert tuple(vectors.validate_load(rows, probes).first()) == (2, 2, 1, False)
    assert vectors.validate_load(rows, probes.where("query_id = 7")).first().valid
    assert vectors.health(rows, 2).first().status == "degraded" and vectors.health(rows.where("id = 1"), 2).first().status == "healthy"
    assert vectors.health(rows.where("id > 9"), 2).first().status == "unhealthy"
    assert vectors.drop(spark, at) and not vectors.held(spark, at)


def test_filtered_counts_see_the_whole_table(spark):
    rows = spark.range(2000).withColumn("label", (F.col("id") > 1990).cast("int"))
    found = vectors.filtered_count(rows, [F.col("id") == -1], F.col("label") == 1).first()
    assert (found.direct, found.held, found.total, found.exists) == (0, 9, 2000, True)
    assert not vectors.filtered_count(rows, [F.col("id") == -1], F.col("label") == 2).first().exists


def test_a_models_answer_goes_before_the_rules(spark):
    rows = spark.createDataFrame([("contact?", '{"category": "portfolio", "confidence": 0.4}'), ("contact?", "no json"), ("contact?", '{"category": "unheard of"}'), ("rain", 'so: {"category": "off_topic"}')], "q string, a string")
    got = [(r.i.category, r.i.confidence, r.i.is_relevant) for r in rows.select(chat.model_intent(F.col("q"), F.col("a")).alias("i")).collect()]
    assert got == [("portfolio", 0.4, True), ("contact", 0.9, True), ("contact", 0.9, True), ("off_topic", 0.5, False)]


def test_responses_become_log_rows(spark):
    told = spark.createDataFrame([("q1", "hello", None, "general", 3, 0.7), ("q2", "", "Query cannot be empty", None, 0, 0.0)], "query_id string, query string, error string, category string, n_results long, confidence double")
    got = chat.interaction_log(told, F.lit(1.0), F.col("query_id"), F.lit(12)).collect()
    assert [(r.session_id, r.query_length, r.search_results_count, r.error_occurred, r.error_message) for r in got] == [("q1", 5, 3, False, None), ("q2", 0, 0, True, "Query cannot be empty")]


def test_tracker_tables_and_total_orders(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    tracker.create_tables(spark, root)
    rows = spark.createDataFrame([("a", 1.0, "INFO", "x"), ("a", 1.0, "INFO", "y")], "job_id string, ts double, level string, message string")
    tracker.record(rows, root, "logs")
    tracker.record(rows.withColumn("later", F.lit(1)), root, "logs")
    got = tracker.read(spark, root, "logs")
    assert got.count() == 4 and got.where("step_name is null").count() == 4 and tracker.read(spark, root, "jobs").count() == 0
    for n in (1, 3):  # ties in time go to the largest row, however the rows come
        assert tracker.latest(rows.repartition(n), "job_id", ["ts"]).first().message == "y"
    events = spark.createDataFrame([("a", "s", 1.0, "running", 0.5), ("a", "s", 1.0, "completed", None)], "job_id string, step_name string, ts double, status string, progress double")
    last = tracker.state(events).first()
    assert (last.status, last.progress) == ("running", 0.5)
    nested = rows.groupBy("job_id").agg(F.collect_list(F.struct("ts", "message")).alias("logs"))
    assert [r.message for r in tracker.flat_logs(nested).collect()] == ["x", "y"]


def test_reports_logs_and_snapshots(spark, tmp_path):
    at = f"file://{tmp_path}"
    scraped = spark.createDataFrame([("blog", 10, None), ("blog", 5, "status 500"), ("other", 7, None)], "page_type string, word_count int, error string")
    urls = spark.createDataFrame([("core", f"u{k}") for k in range(9)], "category string, url string")
    sinks.save_scrape(scraped, urls, f"{at}/r")
    assert {(r.page_type, r.pages, r.succeeded, r.words) for r in spark.read.json(f"{at}/r/scraping").collect()} == {("blog", 2, 1, 10), ("other", 1, 1, 7)}
    assert spark.read.json(f"{at}/r/discovery").first().examples == [f"u{k}" for k in range(5)]
    assert spark.read.json(f"{at}/r/summary").first().pages == 3
    sinks.log_metric(spark, f"{at}/m", "search", 0.25, "k=10", 1.0)
    sinks.log_metric(spark, f"{at}/m", "search", 0.5, "k=10", 2.0)
    assert spark.read.json(f"{at}/m").agg(F.sum("seconds")).first()[0] == 0.75
    for stamp in ("1", "2"):
        sinks.snapshot(spark.createDataFrame([(stamp, 1.0)], "stamp string, v double"), f"{at}/s", stamp)
    assert sorted(r.stamp for r in sinks.restore(spark, f"{at}/s", "stamp string, v double").collect()) == ["1", "2"]


def test_probes_and_samples(spark):
    def probe(url):
        if "down" in url:
            raise OSError(url)
        return 404 if "gone" in url else 200

    got = {r.url: r.ok for r in sources.accessible(spark.createDataFrame([("a",), ("gone",), ("down",)], "url string"), probe).collect()}
    assert got == {"a": True, "gone": False, "down": False}
    samples = analytics.system_samples(spark, lambda: {"cpu_percent": 97.0}, 2, pause=0)
    assert samples.count() == 2 and {r.severity for r in analytics.system_alerts(samples).collect()} == {"critical"}


def test_ratios_and_step_views(spark):
    runs = spark.createDataFrame([(4, 2, 4, 3, 1.0, 3.0, ["a"]), (0, 0, 0, 0, 1.0, None, [])], "total int, uploaded int, attempted int, succeeded int, start_time double, end_time double, sources array<string>")
    assert [(r.upload_rate, r.success_percent, r.duration_seconds, r.has_sources) for r in analytics.ratios(runs).collect()] == [(0.5, 75.0, 2.0, True), (0.0, 0.0, None, False)]
    steps = spark.createDataFrame([(1.0, 3.0, 10), (1.0, None, 8), (5.0, 5.0, 1)], "start_time double, end_time double, items_processed int").withColumn("now", F.lit(5.0))
    assert [(r.duration, r.items_per_second) for r in analytics.step_view(steps).collect()] == [(2.0, 5.0), (4.0, 2.0), (0.0, 0.0)]


def test_uniqueness_is_judged_run_by_run(spark):
    rows = [("r", 1, "the same text here", 0.9), ("r", 2, "the same text here", 0.9), ("r", 3, "the same text hero", 0.9), ("r", 4, "quite another one", None), ("r", 5, "quite another one", 0.9), ("s", 6, "the same text here", 0.9), (None, 7, None, 0.9)]
    df = spark.createDataFrame(rows, "run string, seq long, t string, others double").repartition(3)
    got = {r.seq: (r.uniqueness_score, r.similar_to) for r in dedup.uniqueness(df, "run", "seq", "t", "others").collect()}
    assert got == {1: (1.0, None), 2: (0.0, 1), 3: (0.2, 1), 4: (1.0, None), 5: (1.0, None), 6: (1.0, None), 7: (1.0, None)}


def test_fences_keep_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    out = text.fence(df, t=F.upper("t"), n=F.length("t"))
    assert out.columns == ["k", "t", "n"] and [tuple(r) for r in out.orderBy("k").collect()] == [(1, "A", 1), (2, None, None)]


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Far:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        crawl.shared_dir(Far())


def test_small_tables_are_spread_and_large_ones_left(spark, tmp_path, monkeypatch):
    from lodeworks.sources import spread, tables

    path = f"{tmp_path}/one"
    spark.range(1000).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(df).count() == 1000
    monkeypatch.setattr(tables, "CORE_BYTES", 0)
    assert spread(df).rdd.getNumPartitions() == df.rdd.getNumPartitions()
