"""Operators over tables: duplicates, vectors, chat, figures, tracker, pages, crawl, sources and streams."""

import gzip
import io
import json
import math
import random
import zipfile
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.functions import html
from lodeworks.operators import analytics, chat, crawl, dedup, tracker, vectors
from lodeworks.sources import pages as sources
from lodeworks.sources import sinks, web
from lodeworks.streaming import windows


def test_near_pairs_equal_brute_force(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("abcde ") for _ in range(r.randint(5, 80))) for _ in range(40)]
    texts += [t[:-2] + "zz" for t in texts[:15]] + [texts[0].upper(), texts[1] + "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    got = {(p.first, p.again): (round(p.similarity, 6), p.kind) for p in dedup.all_pairs(df).collect()}
    normal = [" ".join(t.lower().split()) for t in texts]
    first = {}
    want = {}
    for i, t in enumerate(normal):
        if t in first:
            want[first[t], i] = (1.0, "exact")
        else:
            for u, k in first.items():
                s = SequenceMatcher(None, u, t).ratio()
                if s >= 0.85:
                    want[k, i] = (round(s, 6), "near_duplicate")
            first[t] = i
    assert got == want and len(want) > 10
    kept = {x.seq for x in dedup.remove(df, dedup.all_pairs(df)).collect()}
    assert kept == set(range(len(texts))) - {b for _, b in want}


def test_chains_of_near_copies_leave_the_first(spark):
    df = spark.createDataFrame([(0, "a" * 20 + "bcd"), (1, "a" * 19 + "bcde"), (2, "a" * 18 + "bcdef")], "seq long, text string")
    pairs = dedup.all_pairs(df)
    assert [x.seq for x in dedup.remove(df, pairs).collect()] == [0]
    assert dedup.duplicate_map(pairs).where("keep = 0").first().duplicates[0].again == 1


def test_recent_similarity_looks_back_so_many(spark, monkeypatch):
    texts = ["alpha beta gamma", "other words here", "alpha beta gamme", "completely different"]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    whole = [r.recent_similarity for r in dedup.recent_similarity(df, 2).orderBy("seq").collect()]
    monkeypatch.setattr(dedup, "STRETCH", 2)
    assert [r.recent_similarity for r in dedup.recent_similarity(df, 2).orderBy("seq").collect()] == whole
    assert whole[0] == 0.0 and whole[2] > 0.9


def collection(spark, n=80, size=6, seed=1):
    r = np.random.default_rng(seed)
    rows = [(i, r.standard_normal(size).astype(float).tolist(), int(i % 3)) for i in range(n)]
    rows += [(n, rows[3][1], 0), (n + 1, None, 1)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, label int").repartition(3), rows


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid", "manhattan"])
def test_search_equals_numpy(spark, metric, monkeypatch):
    df, rows = collection(spark)
    q = rows[3][1]
    x = np.array([v for _, v, _ in rows if v])
    s = vectors.matrix(metric, np.array([q]), x)[0]
    order = sorted(range(len(s)), key=lambda i: (s[i] if vectors.ascending(metric) else -s[i], i))[:5]
    got = [r.id for r in vectors.search(df, q, 5, metric=metric).collect()]
    if metric != "euclid":
        assert set(got) == set(order)
    queries = df.where("id in (3, 7) and embedding is not null").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 1)
    many = [(r.query_id, r.rank, r.id) for r in vectors.batch_search(df, queries, 4, metric=metric).collect()]
    assert len(many) == 8 and {m[2] for m in many if m[0] == 3} == set(order[:4])


def test_search_edges(spark):
    df, rows = collection(spark)
    assert vectors.search(df, rows[0][1], 500).count() == len(rows)
    assert vectors.search(df, rows[0][1], 10, threshold=2.0).count() == 0
    assert vectors.search(df, [0.0] * 6, 10, threshold=0.1).count() == 0
    assert vectors.search(df, rows[0][1], 10, must={"label": 9}).count() == 0
    assert [r.id for r in vectors.search(df, rows[3][1], 2).collect()] == [3, 80]


def test_boost_and_distinct(spark):
    rows = [(1, 1, "a", 0.5, "https://x/blog", 10, 1), (1, 2, "b", 0.5, "https://x/services", 60, 4), (1, 3, "a", 0.4, None, 0, 0)]
    df = spark.createDataFrame(rows, "query_id int, rank int, text string, score double, source_url string, word_count int, sentence_count int")
    got = {r["rank"]: (r.new_rank, round(r.boosted, 6)) for r in vectors.boost(df).collect()}
    assert got[2] == (1, round(0.5 * 1.1 * 1.05 * 1.15, 6)) and got[1] == (2, 0.525) and got[3] == (3, 0.4)
    assert {r["rank"] for r in vectors.distinct_results(df).collect()} == {1, 2}


def test_collection_loads_each_text_once(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    batch = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "seq long, text string")
    assert vectors.upsert(spark, batch, path).first().uploaded == 2
    more = spark.createDataFrame([(5, "b"), (6, "c")], "seq long, text string")
    got = vectors.upsert(spark, more, path).first()
    assert (got.total, got.uploaded, got.in_collection) == (2, 1, 3)


def test_payloads(spark):
    p = F.lit(json.dumps({"text": "", "metadata": {"text": "deep"}, "chunk_text": "late"}))
    assert spark.range(1).select(vectors.payload_text(p).alias("x")).first().x == "deep"
    assert spark.range(1).select(vectors.payload_text(F.lit("{}")).alias("x")).first().x == "No content available"
    df = spark.createDataFrame([({"url": "u", "source": "own"},), ({},)], "payload map<string,string>")
    a, b = (r.payload for r in vectors.enrich(df).collect())
    assert a["page_url"] == "u" and a["source"] == "own" and b["content_type"] == "general" and "url" not in b


def test_embedding_is_stable_and_unit(spark):
    df = spark.createDataFrame([("a b c",), ("c b a",), (None,)], "t string")
    a, b, c = (r.e for r in df.select(vectors.embed(F.col("t"), 16).alias("e")).collect())
    assert a == b and math.isclose(sum(x * x for x in a), 1, rel_tol=1e-5) and sum(c) == 0


def test_result_cache_forgets():
    now = [0.0]
    cache = vectors.ResultCache(10, 2, clock=lambda: now[0])
    for k in "abc":
        cache.put(k, k)
    assert cache.get("a") is None and cache.get("c") == "c"
    now[0] = 11
    assert cache.get("c") is None


def test_intents(spark):
    asked = {"what services do you have": "services", "see your portfolio": "portfolio", "who are you": "company", "your email": "contact", "best practices for software": "general", "digital": "services", "is it raining": "off_topic"}
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    got = {r.q: r.i.category for r in df.select("q", chat.intent(F.col("q")).alias("i")).collect()}
    assert got == asked
    parsed = spark.range(1).select(chat.parsed_intent(F.lit('sure: {"category": "services", "confidence": 0.9}')).alias("p")).first().p
    assert parsed.category == "services" and parsed.confidence == 0.9


def test_query_errors(spark):
    df = spark.createDataFrame([("",), (None,), ("x" * 501,), (" a ",), ("<script>alert</script>",), ("fine query",)], "q string")
    got = [r.e for r in df.select(chat.query_error(F.col("q")).alias("e")).collect()]
    assert got[0] == got[1] == "Query cannot be empty" and "500" in got[2] and "short" in got[3] and "harmful" in got[4] and got[5] is None


def test_answers(spark):
    q = spark.createDataFrame([(1, "what do you offer"), (2, "x")], "query_id int, query string")
    r = spark.createDataFrame([(1, 1, "A...", 0.9, "u1"), (1, 2, "B", 0.8, "u1"), (1, 3, "C", 0.7, "u2")], "query_id int, rank int, text string, score double, source_url string")
    got = {x.query_id: x for x in chat.answers(q, r).collect()}
    assert got[1].answer == "Based on the information I have about our services:\n\nA.  B\n\nFor more information, you can visit: u1, u2"
    assert got[2].answer == chat.NO_CONTEXT and got[2].n_results == 0
    sure = spark.range(1).select(chat.confidence(F.lit(0.9), F.lit(3), F.lit(0.85)).alias("c"), chat.confidence(F.lit(None), F.lit(0), F.lit(1.0)).alias("d")).first()
    assert sure.c == pytest.approx(0.54 + 0.2 + 0.17) and sure.d == 0.1


def test_latency_places_are_those_of_the_sorted_list(spark):
    for values in ([7], [4, 1, 3, 2], [5] * 10, list(range(101))):
        df = spark.createDataFrame([(v,) for v in values], "response_time_ms long")
        got, s = analytics.latency(df).first(), sorted(values)
        assert (got.median, got.p95) == (s[len(s) // 2], s[int(len(s) * 0.95)])
    assert analytics.latency(spark.createDataFrame([], "response_time_ms long")).count() == 0


def test_stage_rates(spark):
    df = spark.createDataFrame([(10, 8, 15, 12, 10)], "a int, b int, c int, d int, e int")
    got = analytics.stage_rates(df, ("a", "b", "c", "d", "e")).first()
    assert (got.b_rate, got.c_rate, got.d_rate, got.e_rate) == (0.8, 1.875, 0.8, pytest.approx(10 / 12))
    assert analytics.stage_rates(spark.createDataFrame([(0, 1)], "a int, b int"), ("a", "b")).first().b_rate is None


def test_health_without_rows(spark):
    none = spark.createDataFrame([], "response_time_ms long, error_occurred boolean")
    got = analytics.health(none).first()
    assert got.status == "healthy" and got.alerts == [] and got.queries == 0


def test_observed_figures(spark):
    df = analytics.counted(spark.range(10), "counted", rows=F.count(F.lit(1)))
    df.collect()
    assert df.observation.get["rows"] == 10


def test_ties_of_last_metrics_count_twice(spark):
    jobs = spark.createDataFrame([(1, "completed", 0.0, 10.0), (2, "running", 5.0, None)], "job_id int, status string, start_time double, end_time double")
    metrics = spark.createDataFrame([(1, 1.0, 5, 1), (1, 2.0, 7, 1), (1, 2.0, 8, 1)], "job_id int, ts double, vectors int, urls int")
    got = tracker.job_stats(jobs, metrics).first()
    assert (got.total, got.completed, got.avg_duration, got.total_vectors) == (2, 1, 10.0, 15)


def test_state_of_events(spark):
    steps = tracker.step_dimension(spark)
    begun = tracker.started(spark.createDataFrame([(1, 0.0)], "job_id int, ts double"), steps).select("job_id", "step_name", "status", "progress", "ts")
    more = spark.createDataFrame([(1, "scraping", "running", 10.0, 1.0), (1, "scraping", "running", 60.0, 2.0), (1, "scraping", "failed", None, 3.0)], "job_id int, step_name string, status string, progress double, ts double")
    got = {r.step_name: r for r in tracker.state(begun.unionByName(more)).collect()}
    assert len(got) == 10 and got["merging"].status == "pending"
    s = got["scraping"]
    assert (s.status, s.progress, s.start_time, s.end_time) == ("failed", 60.0, 1.0, 3.0)


def test_retention_and_logs(spark):
    jobs = spark.createDataFrame([("a", 1.0, "completed"), ("b", 1.0, "running"), ("c", 9.0, "failed")], "job_id string, start_time double, status string")
    left = tracker.retained(jobs, F.lit(5.0))
    assert {r.job_id for r in left.collect()} == {"b", "c"}
    logs = spark.createDataFrame([("a", 3661.0, "s", "INFO", "m"), ("b", 1.0, "s", "ERROR", "n")], "job_id string, ts double, step_name string, level string, message string")
    assert tracker.step_logs(logs, "a").first().time == "01:01:01"
    assert tracker.without_jobs(logs, left).count() == 1 and tracker.last_errors(logs).count() == 1


PAGE = """<html lang="en"><head><title> T </title><meta name="description" content=" d "><meta property="og:title" content="o"><link rel="canonical" href="/c"></head>
<body><nav>skip</nav><!-- comment --><div class="download">kept by whole names</div>
<main><h2>Second</h2><h1>First</h1><p>One<p>Two <b>bold</b><br>line that is long enough to count as content</p><ul><li>a<li>b <ul><li>c</ul></ul><div class="ad">no</div></main>
<script>var u = "https://example.com/js"; fetch('/api')</script><a href="x">l</a><a href="mailto:a@b">m</a><a href="x">l</a><form action="/go"></form></body></html>"""


def test_extraction(spark):
    df = spark.createDataFrame([("https://example.com/a/", PAGE), ("https://example.com/", None), ("https://example.com/b", "<p>x</p")], "url string, html string")
    rows = html.pages_to_content(df).collect()
    r = rows[0]
    assert r.clean_text == "Second First One Two bold line that is long enough to count as content a b c"
    assert [(h.level, h.text) for h in r.headings] == [(1, "First"), (2, "Second")]
    assert [v["items"] for v in r.lists] == [["a", "b c"], ["c"]]
    assert r.metadata["title"] == "T" and r.metadata["description"] == "d" and r.metadata["og_title"] == "o" and r.metadata["canonical_url"] == "/c" and r.metadata["language"] == "en"
    assert rows[1].clean_text == "" and rows[1].error is None
    strict = html.pages_to_content(df, strict=True).first()
    assert "description" not in strict.metadata and "kept" not in strict.clean_text


def test_content_of_all_places(spark):
    df = spark.createDataFrame([("<body><article>" + "word " * 30 + "</article><p>" + "p" * 30 + "</p></body>",), ("<body><p>short</p><p>" + "q" * 21 + "</p></body>",), ("<body>tiny</body>",)], "html string")
    a, b, c = (r.x.raw_text for r in df.select(html.extract_all(F.col("html")).alias("x")).collect())
    assert a.count("word") == 30 and "p" * 30 not in a and b == "q" * 21 and c == "tiny"


def test_links(spark):
    df = spark.createDataFrame([("https://example.com/a/", PAGE)], "url string, html string")
    assert [r.link for r in html.links(df).orderBy("place").collect()] == ["https://example.com/a/x", "https://example.com/c", "https://example.com/js"]
    wide = {r.link for r in html.links(df, wide=True).collect()}
    assert {"https://example.com/go", "https://example.com/a/x", "https://example.com/js"} <= wide


def test_malformed_markup_never_fails():
    r = random.Random(8)
    for _ in range(300):
        markup = "".join(r.choice(["<p>", "</p>", "<div>", "</div", "<li>", "<ul>", "</ul>", "<!--", "-->", "<", ">", "text ", "&amp;", "<td>", "<script>", "</script>"]) for _ in range(40))
        root = html.parse(markup)
        html.prune(root)
        html.linear(html.main_content(root))


def test_crawl_is_breadth_first(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")], "url string, link string")
    seeds = spark.createDataFrame([("a",)], "url string")
    got = {r.url: r.depth for r in crawl.crawl(seeds, edges, depth=2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert crawl.crawl(seeds, edges, depth=9, most=3).count() == 3
    both = crawl.union_of_sources(seeds, spark.createDataFrame([("a",), ("z",)], "url string"))
    assert {(r.url, r.source) for r in both.collect()} == {("a", 0), ("z", 1)}


def test_scraped_layouts(spark, tmp_path):
    page = {"url": "u", "title": "t", "text": "x", "metadata": {"k": "v"}}
    for k, shape in enumerate(([page, page], {"pages": [page]}, {"scraped_pages": [page]}, page)):
        (tmp_path / f"{k}.json").write_text(json.dumps(shape))
    assert [sources.read_scraped(spark, f"file://{tmp_path}/{k}.json").count() for k in range(4)] == [2, 1, 1, 1]
    assert sources.read_scraped(spark, f"file://{tmp_path}/1.json").first().metadata == {"k": "v"}
    assert sources.latest_file(spark, f"file://{tmp_path}/*.json").endswith(".json")


def test_uploads(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hällo")
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(raw.getvalue())
    (tmp_path / "c.doc").write_bytes(b"\x00old\xfftext")
    (tmp_path / "d.bin").write_bytes(b"x")
    got = {r.title: (r.text, r.error) for r in sources.read_uploads(spark, f"file://{tmp_path}").collect()}
    assert got["a.txt"] == ("hällo", None) and got["b.docx"] == ("One\n\nTwo", None) and got["c.doc"][0] == "oldtext" and got["d.bin"][0] is None
    pages = spark.createDataFrame([("u", "x")], "url string, text string")
    assert sources.with_uploads(pages, sources.read_uploads(spark, f"file://{tmp_path}")).count() == 5


def test_sitemaps(spark, tmp_path):
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    (tmp_path / "a.xml").write_text(f"<urlset {space}><url><loc> https://e/1 </loc></url><url><loc>https://e/2</loc></url></urlset>")
    (tmp_path / "b.xml").write_bytes(gzip.compress(f"<sitemapindex {space}><sitemap><loc>https://e/s.xml</loc></sitemap></sitemapindex>".encode()))
    (tmp_path / "c.xml").write_text("not xml https://e/3 at all")
    got = {(r.kind, r.url) for r in sources.read_sitemaps(spark.read.format("binaryFile").load(f"file://{tmp_path}")).collect()}
    assert got == {("url", "https://e/1"), ("url", "https://e/2"), ("sitemap", "https://e/s.xml"), ("url", "https://e/3")}
    robots = spark.createDataFrame([("User-agent: *\nSitemap: https://e/s.xml\n",)], "text string")
    assert [r.url for r in sources.robots_sitemaps(robots).collect()] == ["https://e/s.xml"]


def test_fetch_gives_a_row_for_each_address(spark):
    def get(url):
        if "bad" in url:
            raise OSError("no route")
        return (503, "") if "busy" in url else (200, "<p>x</p>")

    df = spark.createDataFrame([("good",), ("bad",), ("busy",)], "url string")
    rows = web.fetch(df, get, at_once=2, pause=0, tries=2)
    got = {r.url: (r.status_code, r.error) for r in rows.collect()}
    assert got == {"good": (200, None), "bad": (None, "no route"), "busy": (503, "status 503")}
    assert sources.fetch_stats(rows).first().succeeded == 1


def test_catalogue_and_lines(spark):
    c = sources.url_catalogue(spark)
    assert sources.high_priority(c, 1).count() == 11
    assert sources.url_lines(spark.createDataFrame([(" https://a ",), ("x",)], "value string")).count() == 1


def test_sinks(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = spark.createDataFrame([("a", 3)], "chunk_id string, char_count int")
    sinks.write_results(rows, rows, rows, f"{at}/r")
    assert spark.read.json(f"{at}/r/summary").first().chunks == 1
    assert sinks.save_stage(rows, at, "chunks").count() == 1
    sinks.drop_stage(spark, at, "chunks")
    sinks.append_interactions(rows, f"{at}/log")
    sinks.append_interactions(rows, f"{at}/log")
    (tmp_path / "log" / "bad.json").write_text("{not json\n")
    assert sources.read_interactions(spark, f"{at}/log", "chunk_id string, char_count int").count() == 2
    sinks.snapshot(rows, at, "1")
    sinks.backup(rows, f"{at}/backup")


def events(spark):
    rows = [(i, f"2024-01-01 {i % 24:02d}:{i % 60:02d}:00", i % 4, "error" if i % 9 == 0 else "view", float(i)) for i in range(120)]
    return spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))


def test_streamed_windows_equal_batch(spark, tmp_path):
    e = events(spark)
    e.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = windows.read_events(spark, f"file://{tmp_path}/in", e.schema, late="10 days")
    windows.into(windows.tumbling(stream), lambda b, _: b.write.mode("overwrite").parquet(f"file://{tmp_path}/out"), f"file://{tmp_path}/ck", "complete")
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect())) == sorted(map(tuple, windows.tumbling(e).collect()))
    alerts = windows.windowed_alerts(windows.sliding(e, "1 hour", "1 hour"))
    assert alerts.count() > 0


def test_streamed_first_rows_and_last_values(spark, tmp_path):
    e = events(spark)
    e.withColumn("content_hash", (F.col("event_id") % 10).cast("string")).write.parquet(f"file://{tmp_path}/in")
    schema = spark.read.parquet(f"file://{tmp_path}/in").schema
    stream = windows.read_events(spark, f"file://{tmp_path}/in", schema, late="10 days")
    windows.into(windows.first_seen(stream), lambda b, _: b.write.mode("append").parquet(f"file://{tmp_path}/a"), f"file://{tmp_path}/cka")
    assert spark.read.parquet(f"file://{tmp_path}/a").count() == 10
    stream = windows.read_events(spark, f"file://{tmp_path}/in", schema, late="10 days")
    windows.into(windows.last_values(stream, 3), lambda b, _: b.write.mode("append").parquet(f"file://{tmp_path}/b"), f"file://{tmp_path}/ckb", "update")
    got = {r.user_id: (r.n, len(r.last)) for r in spark.read.parquet(f"file://{tmp_path}/b").collect()}
    assert got == {u: (30, 3) for u in range(4)}


def test_stream_into_collection(spark, tmp_path):
    spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "seq long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("seq long, text string").parquet(f"file://{tmp_path}/in")
    windows.into_collection(stream, f"file://{tmp_path}/c", f"file://{tmp_path}/ck", vectors.upsert)
    assert spark.read.parquet(f"file://{tmp_path}/c").count() == 2
