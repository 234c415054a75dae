"""Whitening, URL filters and vector codes against plain versions."""

import hashlib
import math
import os
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import codes, multiindex, queries, urlfilter, whitening

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def vectors(n=300, dims=8, seed=3):
    r = random.Random(seed)
    mix = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(dims)]
    rows = []
    for k in range(n):
        z = [r.gauss(0, 0.05 * (j + 1)) for j in range(dims)]
        rows.append((k * 3, [sum(a * b for a, b in zip(z, m, strict=True)) for m in mix], k % 4 if k % 7 else None))
    rows += [(5, rows[4][1], 1), (5, rows[5][1], 2), (None, rows[6][1], None), (7, None, 1), (8, [0.0] * (dims - 1) + [None], 1), (10, [float("nan")] * dims, 1), (11, [float("inf")] + [0.0] * (dims - 1), 1), (13, [-0.0] * dims, 1)]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, e, k, "x") for k, (i, v, e) in enumerate(rows)], "vec_id long, embedding array<double>, label int, code int, whitened string").repartition(parts)


def plain_whitening(rows, dims):
    """Exact covariance in fractions, decomposed by numpy."""
    kept = [(i, tuple(math.floor(256 * c) for c in v)) for i, v, _ in rows if usable(v) and len(v) == dims]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = np.array([[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3)) for j in range(dims)] for i in range(dims)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    return kept, n, sums, e, u, np.trace(cov)


def check_whitening(got, rows, dims, components=4):
    kept, n, sums, e, u, trace = plain_whitening(rows, dims)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, min(components, dims) + 1))
    signs = {}
    for k, own in by.items():
        want = sorted((i is None, i or 0, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), float((np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)]) @ u[:, k - 1]) / e[k - 1] ** 0.5)) for i, x in kept)
        have = sorted((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened) for r in own)
        assert [w[:3] for w in want] == [h[:3] for h in have]
        near = lambda f: sorted((h[0], h[1], h[2], round(f * h[3], 6) + 0.0) for h in have) == sorted((w[0], w[1], w[2], round(w[3], 6) + 0.0) for w in want)
        signs[k] = near(1) or near(-1)
        assert {r.n for r in own} == {n} and all(abs(r.explained - e[k - 1] / trace) < 1e-9 for r in own)
        assert len({r.identity_error for r in own}) == 1 and own[0].identity_error < 1e-6
    assert all(signs.values())


@pytest.mark.parametrize("dims", [1, 2, 5, 8])
def test_whitening_matches_exact_arithmetic(spark, dims):
    rows = vectors(200, dims)
    check_whitening(whitening.whiten(frame(spark, rows), components=3).collect(), rows, dims, 3)


@tables
def test_whitening_of_a_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.op11_embedding_whitening(spark, SF).collect(), rows, 64)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    same = whitening.whiten(frame(spark, [(1, [0.5, 1.0], 1), (1, [0.5, 1.0], 1), (2, [0.5001, 1.0], None)])).collect()
    assert len(same) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in same)
    line = whitening.whiten(frame(spark, [(k, [float(k), 2.0 * k, -1.0], 1) for k in range(9)])).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and all(r.identity_error < 1e-9 for r in line)
    several = whitening.whiten(frame(spark, [*vectors(40, 5), (900, [1.0, 2.0], 1), (901, [2.0, 1.0], 1)])).collect()
    assert {(r.vec_id, r.component) for r in several if r.vec_id in (900, 901)} == {(i, k) for i in (900, 901) for k in (1, 2)}
    huge = {(r.vec_id, r.component): r for r in whitening.whiten(frame(spark, [(1, [1e300, 0.0], 1), (2, [-1e300, 3.0], 1), (3, [0.0, 1.0], 1)])).collect()}
    x = {1: (1 << 31, 0), 2: (-(1 << 31), 768), 3: (0, 256)}
    want = {i: sum((3 * a - s) ** 2 for a, s in zip(v, (0, 1024), strict=True)) for i, v in x.items()}
    assert {i: int(huge[i, 1].deviation_exact) for i in x} == want and huge[1, 1].deviation is None and huge[3, 1].deviation == want[3]


def plain_codes(rows, dims, parts=4, size=256, rounds=4):
    kept = sorted(((i is None, i or 0, [max(-(1 << 24), min(1 << 24, math.floor(max(-1e30, min(1e30, 1024 * c))))) for c in v], i, label) for i, v, label in rows if usable(v) and len(v) == dims), key=lambda r: r[:3])
    bounds = codes.cuts(dims, parts)
    books = [[r[2][b:e] for r in kept[:size]] for b, e in bounds]

    def near(part, book):
        d = [sum((a - c) ** 2 for a, c in zip(part, entry, strict=True)) for entry in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p, (b, e) in enumerate(bounds):
            own = {}
            for r in kept:
                own.setdefault(near(r[2][b:e], books[p])[0], []).append(r[2][b:e])
            for k, some in own.items():
                books[p][k] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    out, by = [], {}
    for _, _, x, i, label in kept:
        found = [near(x[b:e], books[p]) for p, (b, e) in enumerate(bounds)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), label))
        by[label] = by.get(label, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return sorted(((i, c, d, by[label], sha) for i, c, d, label in out), key=str)


def rows_of(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def test_codes_match_brute_force(spark, monkeypatch):
    rows = vectors()
    assert rows_of(codes.compress(frame(spark, rows))) == plain_codes(rows, 8)
    monkeypatch.setattr(codes, "TOGETHER", 50)
    assert rows_of(codes.compress(frame(spark, rows), size=20, rounds=2)) == plain_codes(rows, 8, size=20, rounds=2)


def test_codes_of_odd_tables(spark):
    assert codes.compress(frame(spark, [])).collect() == []
    for odd in ([(1, [0.25] * 6, 1), (1, [0.25] * 6, 1), (2, [0.5, -0.5] * 3, None)], [(k, [float(k % 3)], 1) for k in range(9)], [(1, [1e300, -1e300, 0.0, 1.0], 1), (2, [-1e300] * 4, 2), (3, [3.0] * 4, 2)], [(4, [], 1), (5, [], None)]):
        assert rows_of(codes.compress(frame(spark, odd))) == plain_codes(odd, len(odd[0][1]))
    mixed = [*vectors(30, 4), (901, [0.5] * 8, 1), (902, [0.5] * 7 + [0.25], 1)]
    got = codes.compress(frame(spark, mixed))
    assert got.count() == sum(usable(v) for _, v, _ in mixed) and got.select("codebooks_sha256").distinct().count() == 2
    wide = codes.compress(frame(spark, [(k, [float(k), float(k % 17)], 1) for k in range(400)]), parts=2, size=300, rounds=1).collect()
    assert {len(r.code) for r in wide} == {8} and sum(r.error == 0 for r in wide) >= 300


def test_tree_search_keeps_ties_of_lower_index():
    r = np.random.default_rng(5)
    for dims, span in ((1, 3), (2, 4), (16, 2), (4, 1 << 23)):
        entries = r.integers(-span, span + 1, (256, dims))
        x = r.integers(-span, span + 1, (3000, dims))
        d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        at, best = codes.KdTree(entries).nearest(x)
        assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    books = codes.Codebooks.__new__(codes.Codebooks)
    books.books = [np.array([[1, 2], [3, 4]]), np.array([[5], [6]])]
    assert books.decode("0100") == [3, 4, 5] and books.decode("0001") == [1, 2, 6]


URLS = ["https://www.Casino-Win.example.org/en/9", "http://example.org/en/1?x#y", "http://a.example.org/es/3", "http://example.org/es", "http://example.org", "https://b.example.com/fr/1", "https://b.example.com/de/", "http://notexample.org/es/", None, "", "no scheme/x", "x://", "://com/fr/", "a://b://com/de/", "http://bad.host.example.net/a", "http://host.example.net/a", "http://only.example.net/this/page?q=1", "http://only.example.net/this/page/2", "http://x.only.example.net/this/page", "http://adult.x_y.example.net:80/", "HTTP://U@ADULT-X.ÉX.NET/É?x", "http:///de/", "http://com/fr/#://org/es/", "http://" + "a." * 3000 + "evil/" + "p/" * 3000, "http://evil", "http://devil/", "http://.evil/", "http://evil./"]
LIST = ["casino-win.example.org", "BAD.host.example.net", "only.example.net/this/page", "evil", "", None, "evil", "adult-x.Éx.net"]


def plain_verdict(url, entries, rules=urlfilter.RULES):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    host, path = (fold(m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.host + r.path))
        return host, path, best.host + best.path, best.verdict
    held = {fold(e.partition("/")[0]) + "".join(e.partition("/")[1:]) for e in entries if e}
    labels = host.split(".")
    keys = {".".join(labels[k:]) for k in range(len(labels))} | {host + path} if host else set()
    return host, path, None, "block" if keys & {e for e in held if "/" not in e} or host + path in held and host else "allow"


@pytest.mark.parametrize("bytes_", [1 << 20, 0])
def test_url_verdicts_match_a_plain_version(spark, bytes_):
    pages = spark.createDataFrame([(k, u, "x", k) for k, u in enumerate(URLS * 2)], "page_id int, url string, Host string, verdict int").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, spark.createDataFrame([(e,) for e in LIST], "entry string"), mapped_bytes=bytes_).collect()}
    assert got == {k: plain_verdict(u, LIST) for k, u in enumerate(URLS * 2)}
    empty = spark.createDataFrame([], "entry string")
    assert {r.page_id: r.verdict for r in urlfilter.filter_urls(pages, empty, mapped_bytes=bytes_).collect()} == {k: plain_verdict(u, [])[3] for k, u in enumerate(URLS * 2)}
    out = urlfilter.filter_urls(pages.where("false"), empty, mapped_bytes=bytes_)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict", "listed"] and out.count() == 0
    named = {r.page_id: r.listed for r in urlfilter.filter_urls(pages, spark.createDataFrame([("example.org",), ("casino-win.example.org",), ("only.example.net/this/page",)], "entry string"), mapped_bytes=bytes_).collect()}
    assert named[0] == "casino-win.example.org" and named[1] == "example.org" and named[16] == "only.example.net/this/page" and named[17] is None


def test_large_lists_in_many_segments_and_both_ways_agree(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "SEGMENT_BYTES", 2000)
    entries = spark.range(5000).select(F.concat(F.lit("h"), F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(".example/p")).otherwise(F.lit(".example"))).alias("entry"))
    pages = spark.range(8000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://w.h"), F.col("id"), F.lit(".example/p?q=1")).alias("url")).union(spark.range(8000).select("id", F.concat(F.lit("https://h"), F.col("id"), F.lit(".example/p#x"))))
    ways = [urlfilter.filter_urls(pages, entries, mapped_bytes=b) for b in (1 << 30, 0)]
    got = [sorted((r.page_id, r.host, r.verdict, r.listed or "") for r in w.collect()) for w in ways]
    assert got[0] == got[1]
    blocked = {h for _, h, v, _ in got[0] if v == "block"}
    assert blocked == {f"h{k}.example" for k in range(5000)} | {f"w.h{k}.example" for k in range(5000) if k % 3}


def test_texts_that_share_a_digest_are_told_apart(tmp_path):
    keys, texts = np.array([3, 7, 7, 7, 9], "<u8"), [b"a", b"b", b"cc", b"d", b"e"]
    at = tmp_path / "list"
    at.write_bytes(np.array([5], "<i8").tobytes() + keys.tobytes() + np.cumsum([len(t) for t in texts]).astype("<i8").tobytes() + b"".join(texts))
    held = urlfilter.DigestArray(str(at))
    begin, end = held.candidates(np.array([7, 8, (1 << 64) - 1], np.uint64))
    assert (begin.tolist(), end.tolist()) == ([1, 4, 5], [4, 4, 5])
    assert held.has(b"cc", 1, 4) and held.has(b"d", 1, 4) and not held.has(b"x", 1, 4)


@tables
@pytest.mark.parametrize("name", ["op12_url_filters", "op13_vector_codes"])
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    result = con.execute(queries.oracle_sql()[name])
    assert [d[0] for d in result.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(result.fetchall(), key=str)


def plain_links(rows, threshold=0.95):
    """(id, links, component) of each row, whatever its id repeats."""
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    up = list(range(len(rows)))
    for a, b in zip(*np.nonzero(near), strict=True):
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    root = []
    for k in range(len(rows)):
        while up[k] != k:
            k = up[k]
        root.append(k)
    low = {}
    for (i, _), k in zip(rows, root, strict=True):
        low[k] = min(i, low.get(k, i))
    return sorted((i, int(n), low[k]) for (i, _), n, k in zip(rows, near.sum(axis=1), root, strict=True))


def test_vectors_that_repeat_an_id_are_nodes_of_their_own(spark):
    some = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.001]), (7, [-1.0, 0.0])]
    r = random.Random(8)
    many = []
    for k in range(40):
        v = [r.gauss(0, 1) for _ in range(6)]
        for _ in range(r.randint(1, 5)):
            many.append((r.randint(0, 30), [c + r.gauss(0, 0.12) for c in v]))
    many += many[:9]
    for rows in (some, many):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in multiindex.near_vectors(df, recall=1).collect())
        assert got == plain_links(rows)


def test_exact_search_loses_no_pair_on_a_large_grid(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "PER_CELL", 8)
    r = np.random.default_rng(12)
    base = r.standard_normal((400, 10))
    side = r.standard_normal((400, 10))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    t = 0.95 + r.choice([1e-9, -1e-9, 0.004], 400)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, t[:, None] * base + (1 - t[:, None] ** 2) ** 0.5 * side]))]
    assert multiindex.MultiIndex(np.array([v for _, v in rows]), len(rows), 0.95, 1).k ** 2 >= 100
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in multiindex.near_vectors(df, recall=1).collect())
    assert got == plain_links(rows)
    monkeypatch.setattr(multiindex, "MOST", 1)  # a grid too fine for the visits tried goes the exact way by itself
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in multiindex.near_vectors(df, recall=0.9999).collect()) == got
