"""Asking web servers in turns of their hosts; sitemaps followed through their indexes."""

from __future__ import annotations

import heapq
import time
import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators.crawl import _appended, scratch, written
from lodeworks.sources.pages import robots_sitemaps, sitemap_urls

#: Answers that are worth another try: fixed values of HTTP.
BUSY = (429, 500, 502, 503, 504)
#: Rows and characters that a task holds before it hands them on.
HELD_ROWS, HELD_CHARS = 256, 16 << 20


class Turns:
    """One task's calls: each lane (a host, or a share of it) is asked again `pause` seconds after its last call at the earliest.

    While one lane rests the others are asked, so that a task waits only if all of them rest. A busy answer lets its lane rest
    twice as long each time. Lanes are remembered from one batch of rows to the next for as long as they rest.
    """

    def __init__(self, get: Callable, pause: float, tries: int, agents: Sequence[str] = ()):
        self.get, self.pause, self.tries, self.agents = get, pause, tries, agents
        self.rest: dict[str, float] = {}
        self.calls = 0

    def call(self, url: str) -> tuple:
        """(status, body, error) of one call."""
        agent = (self.agents[self.calls % len(self.agents)],) if self.agents else ()
        self.calls += 1
        try:
            status, body = self.get(url, *agent)
            return status, body, None if status < 400 else f"status {status}"
        except Exception as reason:  # any failure of one address is that row's error
            return None, None, str(reason)

    def ask(self, lanes: Sequence[str], urls: Sequence[str]) -> Iterator[tuple]:
        """(url, status, body, seconds, error) of all addresses, as they come."""
        now = time.monotonic()
        self.rest = {lane: t for lane, t in self.rest.items() if t > now}
        waiting: dict[str, deque] = defaultdict(deque)
        for lane, url in zip(lanes, urls, strict=True):
            waiting[lane].append((url, 0, 0.0))
        turns = [(self.rest.get(lane, now), lane) for lane in waiting]
        heapq.heapify(turns)
        while turns:
            at, lane = heapq.heappop(turns)
            began = time.monotonic()
            if at > began:
                time.sleep(at - began)
                began = time.monotonic()
            url, tried, spent = waiting[lane].popleft()
            status, body, error = self.call(url)
            ended = time.monotonic()
            again = error is not None and (status is None or status in BUSY) and tried + 1 < self.tries
            self.rest[lane] = ended + self.pause * (2**tried if again else 1)
            if again:
                waiting[lane].appendleft((url, tried + 1, spent + ended - began))
            else:
                yield url, status, body, spent + ended - began, error
            if waiting[lane]:
                heapq.heappush(turns, (self.rest[lane], lane))


def asked(urls: DataFrame, get: Callable, make: Callable[..., list[tuple]], schema: str, at_once: int = 5, pause: float = 0.5, tries: int = 3, lanes: int = 1, agents: Sequence[str] = ()) -> DataFrame:
    """What `make(url, status, body, seconds, error)` gives for each address.

    All addresses of a host go to one of `at_once` tasks, in whose hands the pause between two calls is; within it they come in
    a mixed order, so that hosts alternate. `lanes` divides a host's addresses into as many shares with a pause each: so
    many calls at once the host bears. An address without a host is a host of its own; null addresses give no row. A task that
    is run again, or speculatively beside itself, asks again.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns = Turns(get, pause, tries, agents)
        held, chars = [], 0
        for batch in batches:
            for answer in turns.ask(batch["lane"].tolist(), batch["url"].tolist()):
                chars += len(answer[2] or "")
                held += make(*answer)
                if len(held) >= HELD_ROWS or chars >= HELD_CHARS:
                    yield pd.DataFrame(held, columns=columns)
                    held, chars = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)

    host = F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.col("url"))
    lane = F.concat_ws(" ", host, F.pmod(F.xxhash64("url"), F.lit(lanes)).cast("string"))
    rows = urls.where(F.col("url").isNotNull()).select("url", lane.alias("lane")).repartition(at_once, "lane")
    return rows.sortWithinPartitions(F.xxhash64("url"), "url").mapInPandas(run, schema)


FETCHED = "url string, status_code int, html string, content_length int, method_used string, seconds double, error string"


def _page(url, status, body, seconds, error) -> list[tuple]:
    text = body.decode("utf-8", "replace") if isinstance(body, bytes) else body
    return [(url, status, text if error is None else None, len(text or ""), "static", seconds, error)]


def fetch(urls: DataFrame, get: Callable, at_once: int = 5, pause: float = 0.5, tries: int = 3, lanes: int = 1, agents: Sequence[str] = ()) -> DataFrame:
    """Pages of addresses through a given function `get(url)`, or `get(url, agent)` with agents in rotation: see `asked`.

    Every address gives a row, a repeated one as often as it comes; one that fails has its error.
    """
    return asked(urls, get, _page, FETCHED, at_once, pause, tries, lanes, agents)


def _entries(url, status, body, seconds, error) -> list[tuple]:
    if error is not None:
        return [(url, "failed", None, error)]
    raw = body.encode() if isinstance(body, str) else body
    try:
        return [(url, kind, u, None) for kind, u in dict.fromkeys(sitemap_urls(raw))] or [(url, "empty", None, None)]
    except (OSError, EOFError, ValueError, zlib.error) as reason:  # a broken archive
        return [(url, "failed", None, str(reason) or type(reason).__name__)]


ENTRIES = "sitemap string, kind string, url string, error string"


def follow_sitemaps(seeds: DataFrame, get: Callable, depth: int | None = None, **polite) -> DataFrame:
    """(sitemap, kind, url, error): all that sitemaps say, and those that their indexes name, down to the last.

    A round asks for the frontier's sitemaps, each address once in all rounds, whatever indexes name it, themselves included;
    frontiers, visited addresses and entries are written tables. kind is url for a page, sitemap for what an index names, failed
    for a sitemap that couldn't be read, with its error, and empty for one without addresses. depth, if given, bounds the rounds.
    """
    spark = seeds.sparkSession
    visited, entries = scratch(spark, "visited"), scratch(spark, "entries")
    front = written(seeds.select("url").where("url IS NOT NULL").distinct(), "sitemaps")
    found, rounds = spark.createDataFrame([], ENTRIES), 0
    while (depth is None or rounds < depth) and not front.isEmpty():
        seen = _appended(front, visited)
        new = written(asked(front, get, _entries, ENTRIES, **polite), "entries")  # asked once, however often it is read
        found = _appended(new, entries)
        front = written(new.where("kind = 'sitemap'").select("url").distinct().join(seen, "url", "left_anti"), "sitemaps")
        rounds += 1
    return found


def sitemap_pages(entries: DataFrame) -> DataFrame:
    """(url, sitemap): each page that sitemaps name once, with the smallest sitemap that has it."""
    return entries.where("kind = 'url'").groupBy("url").agg(F.min("sitemap").alias("sitemap"))


def discover(hosts: DataFrame, get: Callable, paths: Sequence[str] = ("/sitemap.xml", "/sitemap_index.xml"), **polite) -> DataFrame:
    """Entries (see `follow_sitemaps`) of sites, given as addresses: of the usual places and those that robots.txt names."""
    site = F.concat(F.lower(F.try_parse_url("url", F.lit("PROTOCOL"))), F.lit("://"), F.lower(F.try_parse_url("url", F.lit("AUTHORITY"))))
    sites = written(hosts.select(site.alias("site")).where("site IS NOT NULL").distinct(), "sites")
    named = robots_sitemaps(fetch(sites.select(F.concat("site", F.lit("/robots.txt")).alias("url")), get, **polite), "html")
    usual = sites.select(F.explode(F.array(*(F.concat("site", F.lit(p)) for p in paths))).alias("url"))
    return follow_sitemaps(named.union(usual), get, **polite)
