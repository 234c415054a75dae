"""A best-first crawl with quotas against a plain model."""

import os
import random
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import urls
from lodeworks.operators import crawl
from lodeworks.plans import pages

SF = "/root/testdata/sf0.001"


def score(c):
    return F.when(~F.contains(c, F.lit("unscored")), F.length(c) % 5)


def plain_score(u):
    return None if "unscored" in u else len(u) % 5


def model(seeds, links, each, rounds, most=None, by_host=False, plain_score=plain_score):
    """Sequential rule: round by round, the best open addresses."""
    known, taken, out, k = set(filter(None, seeds)), set(), [], 0
    while rounds is None or k < rounds:
        k += 1
        order = sorted(known - taken, key=lambda u: (plain_score(u) is None, -(plain_score(u) or 0), u))
        if by_host:
            used, now = {}, []
            for u in order:
                host = urlsplit(u).netloc.lower() or u
                used[host] = used.get(host, 0) + 1
                if used[host] <= each:
                    now.append(u)
        else:
            now = order[:each]
        if most is not None:
            now = now[: most - len(out)]
        if not now:
            break
        out += [(u, k, plain_score(u)) for u in now]
        taken |= set(now)
        known |= {b for a, b in links if a in now and b is not None}
    return out


def graph(seed):
    dice = random.Random(seed)
    names = [f"https://{dice.choice(['a.x', 'A.x', 'b.x'])}/{'p' * dice.randrange(9)}{k}" for k in range(40)] + ["https://b.x/unscored", "plain"]
    links = [(dice.choice(names), dice.choice([*names, None])) for _ in range(110)]
    return names, links + links[:9]


@pytest.mark.parametrize(("each", "rounds", "most", "by_host"), [(3, 4, None, False), (2, 3, None, True), (4, None, 9, False)])
def test_best_first_equals_the_model(spark, each, rounds, most, by_host):
    names, links = graph(each)
    seeds = [names[0], names[0], names[1], "plain", None]
    got = crawl.best_first(spark.createDataFrame([(s,) for s in seeds], "url string"), spark.createDataFrame(links, "url string, link string"), score, each, rounds, most, by_host)
    assert sorted(map(tuple, got.collect())) == sorted(model(seeds, links, each, rounds, most, by_host))


def test_nothing_to_crawl(spark):
    empty = spark.createDataFrame([], "url string")
    assert crawl.best_first(empty, spark.createDataFrame([], "url string, link string"), score).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_query_over_pages(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    links = con.execute(pages.LINKS_SQL + "SELECT url, link FROM f").fetchall()
    seeds = [r[0] for r in con.execute("SELECT url FROM pages").fetchall()]
    every = sorted({u for u in [*seeds, *(x for pair in links for x in pair)] if u is not None})
    df = spark.createDataFrame([(u,) for u in every], "url string")
    scores = {r.url: r.s for r in df.select("url", urls.priority_score(F.col("url")).cast("double").alias("s")).collect()}
    want = model(seeds, links, 10, 5, by_host=True, plain_score=scores.get)
    assert sorted(map(tuple, pages.crawl_best(spark, SF).collect())) == sorted(want) and max(w[1] for w in want) > 1
