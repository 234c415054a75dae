"""Fetching in turns of hosts, and sitemaps through their indexes, against made-up servers."""

import collections
import glob
import gzip
import time

import pytest

from lodeworks.sources import web


def logging_server(folder):
    """Answers every address, and writes down when each host was asked."""

    def get(url, agent="none"):
        host = url.split("/")[2]
        with open(f"{folder}/{host}", "a") as f:
            f.write(f"{time.monotonic()} {agent}\n")
        return 200, f"<p>{url}</p>"

    return get


def calls(folder):
    return {f.rsplit("/", 1)[1]: sorted(float(x.split()[0]) for x in open(f)) for f in glob.glob(f"{folder}/*")}


def test_hosts_are_asked_with_pauses_while_others_are_asked(spark, tmp_path):
    urls = [f"https://h{k}.example/{n}" for k in range(6) for n in range(8)]
    df = spark.createDataFrame([(u,) for u in urls], "url string").repartition(5)
    got = web.fetch(df, logging_server(tmp_path), at_once=2, pause=0.2, agents=("a", "b")).collect()
    assert sorted(r.url for r in got) == sorted(urls) and all(r.error is None for r in got)
    seen = calls(tmp_path)
    assert len(seen) == 6
    for times in seen.values():
        assert len(times) == 8 and min(b - a for a, b in zip(times, times[1:], strict=False)) >= 0.2
    spent = max(t[-1] for t in seen.values()) - min(t[0] for t in seen.values())
    assert spent < 47 * 0.2 / 2  # hosts alternate; two tasks that ask one host after another would take longer
    assert {line.split()[1] for f in glob.glob(f"{tmp_path}/*") for line in open(f)} == {"a", "b"}


def test_pause_holds_from_batch_to_batch(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(f"https://one.example/{n}",) for n in range(7)], "url string")
        assert web.fetch(df, logging_server(tmp_path), pause=0.1).count() == 7
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    times = calls(tmp_path)["one.example"]
    assert min(b - a for a, b in zip(times, times[1:], strict=False)) >= 0.1


def test_lanes_share_a_host(spark, tmp_path):
    df = spark.createDataFrame([(f"https://one.example/{n}",) for n in range(16)], "url string")
    assert web.fetch(df, logging_server(tmp_path), at_once=8, pause=0.3, lanes=4).count() == 16
    times = calls(tmp_path)["one.example"]
    assert times[-1] - times[0] < 15 * 0.3  # faster than one lane
    # In less than a pause no more calls than lanes.
    assert all(sum(a <= b < a + 0.29 for b in times) <= 4 for a in times)


def test_rests_grow_and_other_hosts_go_on(tmp_path):
    asked = []

    def get(url):
        asked.append((url, time.monotonic()))
        return (503, "") if "busy" in url else (200, "x")

    turns = web.Turns(get, 0.1, 3)
    out = list(turns.ask(["b", "a", "a", "a"], ["busy", "a1", "a2", "a3"]))
    assert {o[0]: (o[1], o[4]) for o in out} == {"busy": (503, "status 503"), "a1": (200, None), "a2": (200, None), "a3": (200, None)}
    busy = [t for u, t in asked if u == "busy"]
    assert len(busy) == 3 and busy[1] - busy[0] >= 0.1 and busy[2] - busy[1] >= 0.2
    assert out[-1][0] == "busy"  # the others didn't wait for it


def test_odd_addresses(spark):
    df = spark.createDataFrame([(None,), ("",), ("no address",), ("http://[bad",), ("https://e.example/a",), ("https://e.example/a",)], "url string")
    got = collections.Counter((r.url, r.error) for r in web.fetch(df, lambda u: (404, "gone") if not u else (200, b"\xff ok"), pause=0).collect())
    assert got == {("", "status 404"): 1, ("no address", None): 1, ("http://[bad", None): 1, ("https://e.example/a", None): 2}
    assert web.fetch(df.limit(0), lambda u: (200, ""), pause=0).count() == 0


def index(*urls):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def pages(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def site(folder=None):
    held = {
        "https://e/robots.txt": "User-agent: *\nSITEMAP: https://e/root.xml\nSitemap: https://e/extra.txt\n",
        "https://e/root.xml": index("https://e/a.xml", "https://e/b.xml.gz", "https://e/root.xml"),
        "https://e/a.xml": index("https://e/deep.xml", "https://e/root.xml", "https://e/gone.xml"),
        "https://e/b.xml.gz": gzip.compress(pages("https://e/1", "https://e/2").encode()),
        "https://e/deep.xml": pages("https://e/2", "https://e/3"),
        "https://e/extra.txt": "https://e/4\nhttps://e/1",
        "https://e/broken.gz": gzip.compress(b"x" * 99)[:20],
        "https://e/none.xml": "<urlset/>",
    }

    def get(url):
        if folder:
            with open(f"{folder}/asked", "a") as f:
                f.write(url + "\n")
        return (200, held[url]) if url in held else (404, "")

    return get


def test_sitemaps_to_the_last_each_asked_once(spark, tmp_path):
    seeds = spark.createDataFrame([("https://e/root.xml",), ("https://e/broken.gz",), ("https://e/none.xml",), (None,)], "url string")
    entries = web.follow_sitemaps(seeds, site(tmp_path), pause=0, tries=1)
    assert {(r.url, r.sitemap) for r in web.sitemap_pages(entries).collect()} == {("https://e/1", "https://e/b.xml.gz"), ("https://e/2", "https://e/b.xml.gz"), ("https://e/3", "https://e/deep.xml")}
    kinds = {(r.sitemap, r.kind) for r in entries.where("kind IN ('failed', 'empty')").collect()}
    assert kinds == {("https://e/gone.xml", "failed"), ("https://e/broken.gz", "failed"), ("https://e/none.xml", "empty")}
    asked = collections.Counter(open(tmp_path / "asked").read().split())
    assert set(asked.values()) == {1} and len(asked) == 7


@pytest.mark.parametrize(("depth", "found"), [(0, set()), (1, set()), (2, {"https://e/1", "https://e/2"})])
def test_sitemap_depth(spark, depth, found):
    seeds = spark.createDataFrame([("https://e/root.xml",)], "url string")
    assert {r.url for r in web.sitemap_pages(web.follow_sitemaps(seeds, site(), depth, pause=0, tries=1)).collect()} == found


def test_discovery_by_robots(spark):
    hosts = spark.createDataFrame([("https://E/some/page?x=1",), ("https://e/",), ("nothing",)], "url string")
    entries = web.discover(hosts, site(), pause=0, tries=1)
    assert {r.url for r in web.sitemap_pages(entries).collect()} == {f"https://e/{k}" for k in (1, 2, 3, 4)}
