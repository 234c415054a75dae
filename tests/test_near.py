"""Near pairs against brute force: bounds that lose nothing, thresholds, very short and very long texts, shared passages."""

import os
import random
from difflib import SequenceMatcher

import pytest

from lodeworks.operators import dedup
from lodeworks.plans import search

SF = "/root/testdata/sf0.001"


def edited(r, t, share, letters):
    out = list(t)
    for _ in range(max(1, int(len(t) * share))):
        k = r.randrange(len(out) + 1)
        out[k : k + r.randint(0, 1)] = r.choice(letters) if r.random() < 0.7 else ""
    return "".join(out)


def brute(texts, threshold):
    return {(i, j): round(s, 9) for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if a != b and 2 * min(len(a), len(b)) >= threshold * (len(a) + len(b)) and (s := SequenceMatcher(None, a, b).ratio()) >= threshold}


def test_what_a_pair_shares_is_never_less_than_its_bound():
    r = random.Random(1)
    for _ in range(300):
        letters = r.choice(["ab", "abcdefgh ", "etaoinshrdlucmfwyp     ", "0123456789abcdef"])
        a = "".join(r.choice(letters) for _ in range(r.choice([1, 3, 9, 30, 150, 250, 900])))
        b = edited(r, a, r.choice([0.01, 0.05, 0.1, 0.2]), letters) or "x"
        ratio = SequenceMatcher(None, a, b).ratio()
        assert dedup.common(a, b, ratio * (len(a) + len(b)) / 2 - 1e-6) and not dedup.common(a, b, min(len(a), len(b)) + 1)
        if ratio < 0.06:
            continue
        bounds = dedup.Bounds(threshold := ratio - 1e-9)
        _, starts, _ = bounds.of(b)
        for window in dedup.CLASSES:
            mine = set(dedup._least(a, window)[0].tolist())
            marks, served = dedup._least(b, window)
            shared = sum(n for m, n in zip(marks.tolist(), served.tolist(), strict=True) if m in mine)
            assert shared >= bounds.shared(window, len(a) + len(b), starts) - 1e-6, (threshold, window)


@pytest.mark.parametrize("threshold", [0.5, 0.85, 0.97, 1.0])
def test_pairs_equal_brute_force_at_any_threshold(spark, monkeypatch, threshold):
    monkeypatch.setattr(dedup, "BITS", 1 << 15)  # bits are shared by many hashes
    r = random.Random(2)
    texts = ["a", "b", "ab", "ba", "abc", "abd", "aab", "x" * 400, "x" * 401, "y" * 350 + "x"]
    for n in (6, 12, 40, 120, 199, 200, 260, 700, 2500):
        base = "".join(r.choice("etaoinshrdlu     ") + r.choice(["", "", "q", "7"]) for _ in range(n))
        texts += [base, *(edited(r, base, share, "etaoin qz") for share in (0.005, 0.03, 0.08, 0.15))]
    passage = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300))
    texts += [passage + "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k)) for k in (20, 40, 60, 300, 900)]
    texts = list(dict.fromkeys(" ".join(t.split()) for t in texts))
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string").repartition(3)
    got = {(p.first, p.again): round(p.similarity, 9) for p in dedup.near_pairs(df, threshold).collect()}
    assert got == brute(texts, threshold)


def test_nothing_and_odd_rows(spark):
    df = spark.createDataFrame([], "seq long, text string")
    assert dedup.near_pairs(df).count() == 0 and dedup.all_pairs(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (None, "a text without a place"), (5, "a text without a place!"), (6, "a text without a place?")], "seq long, text string")
    assert [(p.first, p.again) for p in dedup.near_pairs(df).collect()] == [(5, 6)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_whole_documents_equal_brute_force(spark):
    rows = sorted((r.doc_id, " ".join((r.text or "").lower().split())) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if r.doc_id is not None)
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    texts = [(i, t) for t, i in first.items() if t]
    letters = [{c: t.count(c) for c in set(t)} for _, t in texts]
    want = {}
    for j, (b, u) in enumerate(texts):
        for i, (a, t) in enumerate(texts[:j]):
            total = len(t) + len(u)
            if 2 * sum(min(n, letters[i].get(c, 0)) for c, n in letters[j].items()) >= 0.85 * total and (s := SequenceMatcher(None, t, u).ratio()) >= 0.85:
                want[a, b] = round(s, 6)
    got = {(p.first, p.again): p.similarity for p in search.near_dup_pairs(spark, SF).collect() if p.kind != "exact"}
    assert got == want and want


@pytest.mark.parametrize("held, last, seed", [(5, 3, 1), (12, 8, 2), (40, 2, 3)])
def test_stretches_agree_with_the_sequential_rule(spark, monkeypatch, held, last, seed):
    monkeypatch.setattr(dedup, "STRETCHES", 1)
    r = random.Random(seed)
    bases = ["".join(r.choice("abcdefg ") for _ in range(40)) for _ in range(9)]
    rows = []
    for k in range(260):
        t = r.choice(bases)
        rows.append((r.choice(["hot"] * 8 + ["b", None]), k, edited(r, t, 0.04, "abc") if r.random() < 0.7 else t, r.choice([None, 0.4, 0.55, 0.6, 0.75])))
    df = spark.createDataFrame(rows, "run string, seq long, t string, others double").repartition(5)
    got = {x.seq: (x.uniqueness_score, x.similar_to) for x in dedup.uniqueness(df, "run", "seq", "t", "others", last=last, held=held).collect()}
    want, runs = {}, {}
    for run, k, t, others in rows:
        recent, t = runs.setdefault(run, {}), " ".join(t.lower().split())
        found = recent.get(t)
        score = 0.0 if t in recent else 1.0
        if t not in recent:
            found = next((p for u, p in list(recent.items())[-last:] if SequenceMatcher(None, t, u).ratio() >= 0.85), None)
            score = 1.0 if found is None else 0.2
        want[k] = (score, found)
        if others is not None and others + 0.2 * score >= 0.7 and t not in recent:
            recent[t] = k
            if len(recent) > held:
                recent.pop(next(iter(recent)))
    assert got == want


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_slices_lose_no_pair_and_leave_nothing_on_disk(spark, monkeypatch, threshold):
    import os

    from lodeworks.operators.crawl import shared_dir

    monkeypatch.setattr(dedup, "SLICES", 5)
    monkeypatch.setattr(dedup, "SLICE_CHARS", 1000)
    monkeypatch.setattr(dedup, "TEXTS", 3)
    r = random.Random(4)
    texts = ["a", "ab", "abc", "abd"]
    for n in (12, 40, 120, 260, 700, 2500):
        base = "".join(r.choice("etaoinshrdlu     ") + r.choice(["", "", "q", "7"]) for _ in range(n))
        texts += [base, *(edited(r, base, share, "etaoin qz") for share in (0.005, 0.03, 0.08, 0.15))]
    texts = list(dict.fromkeys(" ".join(t.split()) for t in texts))
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string").repartition(3)
    got = {(p.first, p.again): round(p.similarity, 9) for p in dedup.near_pairs(df, threshold).collect()}
    assert got == brute(texts, threshold) and len(got) > 10
    assert not [x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if x.startswith("later-")]


def test_many_texts_at_once_have_the_common_subsequences_of_each():
    import numpy as np

    r = random.Random(5)
    for _ in range(60):
        letters = r.choice(["ab", "abcdefgh ", "日本語😀x"])
        a, *texts = ["".join(r.choice(letters) for _ in range(r.choice([1, 5, 63, 64, 65, 129, 199]))) for _ in range(6)]
        held = np.full((5, max(map(len, texts))), 0xFFFFFFFF, np.uint32)
        for row, t in zip(held, texts, strict=True):
            row[: len(t)] = [ord(c) for c in t]
        for enough in (3, 20, 50, 100):
            assert dedup._enough(a, held, {}, np.full(5, enough)).tolist() == [dedup.common(a, t, enough) for t in texts]


def test_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_LEAST", 1000)
    monkeypatch.setattr(dedup, "TEXTS", 4)
    r = random.Random(6)
    bases = ["".join(r.choice("etaoinshrdlu    ") for _ in range(n)) for n in (30, 90, 150, 400)]
    texts = list(dict.fromkeys(" ".join(edited(r, b, share, "etaoin ").split()) for b in bases for share in (0.01, 0.04, 0.08, 0.12) for _ in range(3)))
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string").repartition(3)
    got = {(p.first, p.again): round(p.similarity, 9) for p in dedup.near_pairs(df, 0.85).collect()}
    assert got == brute(texts, 0.85) and len(got) > 10


def test_what_stretches_hand_on_is_read_once_a_table(spark, monkeypatch):
    monkeypatch.setattr(dedup, "STRETCHES", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    leaves, write = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, tag: (leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size()) if tag == "judged" else None) or write(df, tag))
    try:
        rows = [("a", k, f"text {k * 7919 % 10007} of {k}", 0.7) for k in range(240)]
        got = dedup.uniqueness(spark.createDataFrame(rows, "run string, seq long, t string, others double"), "run", "seq", "t", "others", last=2, held=10).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == 240 and len(leaves) > 1 and max(leaves) <= 1 + len(leaves)


def test_short_texts_have_the_common_subsequences_and_characters_of_each():
    import numpy as np

    r = random.Random(7)
    for _ in range(120):
        letters = r.choice(["ab", "abcdefgh ", "etaoinshrdlu    ", "日本語😀x"])
        base = "".join(r.choice(letters) for _ in range(r.choice([1, 5, 40, 100, 190])))
        new = [edited(r, base, r.choice([0.01, 0.1, 0.2]), letters)[:199] or "x" for _ in range(6)]
        old = [edited(r, base + r.choice(["", base[:60]]), r.choice([0.01, 0.1, 0.2]), letters) or "x" for _ in range(5)]
        short, threshold = dedup._Short(new), r.choice([0.6, 0.85, 0.97, 1.0])
        x, y = (v.ravel() for v in np.meshgrid(np.arange(5), np.arange(6), indexing="ij"))
        want = [dedup.common(old[i], new[j], threshold * (len(old[i]) + len(new[j])) / 2 - 1e-6) for i, j in zip(x, y, strict=True)]
        assert short.enough(old, x, y, threshold).tolist() == want
        assert all(n == sum(min(a.count(c), b.count(c)) for c in set(a)) for a, row in zip(old, short.shared(old), strict=True) for b, n in zip(new, row, strict=True))


def test_an_index_without_common_windows_loses_nothing():
    import numpy as np

    r = random.Random(8)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 7))) for _ in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(60, 200))) for _ in range(12)]
    texts += [edited(r, t, 0.03, "etaoin ") for t in texts]
    for window in dedup.CLASSES:
        marks = [dedup._least(t, window) for t in texts]
        need = np.array([0.3 * (len(t) - window + 1) for t in texts])
        index = dedup._Index(texts, np.array([len(t) for t in texts], float), window, need, 1 << 20)
        bound = index.shared(texts) + index.left
        assert index.left.sum() > 0 and (index.left <= need / 2).all()
        if window > 3:
            assert all(bound[i, j] >= sum(n for m, n in zip(*marks[j], strict=True) if m in marks[i][0]) for i in range(0, len(texts), 5) for j in range(len(texts)))
