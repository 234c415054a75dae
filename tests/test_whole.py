"""Queries do the whole job on small tables that the driver's tables don't show."""

import random
from difflib import SequenceMatcher

from lodeworks.operators import dedup
from lodeworks.plans import pages, search


def written(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_every_user_turn_is_asked_with_its_own_text(spark, tmp_path):
    said = ["javascript: x", "word " * 120, "Which  mobile app?", "fine\u2026 \u00a7 #now!"]
    rows = [(conv, k, role, text) for conv in range(3, 6) for k, text in enumerate(said) for role in ("user", "assistant")]
    at = written(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    asked = {(c, k): search.LEADS[(c + k) % len(search.LEADS)] + said[k] for c in range(3, 6) for k in range(4)}
    errors = {(r.conv_id, r.turn): r.error for r in search.query_validate(spark, at).collect()}
    assert errors.keys() == asked.keys()
    for (c, k), q in asked.items():
        harmful = "javascript:" in q or "sql injection" in q
        want = "Query too long. Maximum 500 characters allowed." if k == 1 else "Query contains potentially harmful content" if harmful else None
        assert errors[c, k] == want
    assert {(r.conv_id, r.turn): r.error for r in search.query_process(spark, at).collect()} == errors
    processed = {(r.conv_id, r.turn): r.processed for r in search.query_preprocess(spark, at).collect()}
    assert all(processed[c, 2].endswith("which mobile app?") and processed[c, 3].endswith("fine  now!") for c in range(3, 6))
    assert all(r.is_relevant for r in search.query_intent(spark, at).where("turn = 2").collect())


def test_near_copies_of_documents_are_found_removed_and_mapped(spark, tmp_path):
    r = random.Random(4)
    words = ["".join(r.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(r.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(n)) + "." for n in (8, 30, 90, 90, 300, 300, 900)]
    for t in list(texts):
        parts = t.split(" ")
        for change in (1, len(parts) // 40, len(parts) // 12, len(parts) // 7, len(parts) // 4):
            new = list(parts)
            for k in r.sample(range(len(parts)), min(change, len(parts))):
                new[k] = r.choice(words)
            texts.append(" ".join(new))
    texts.append(texts[2].upper())
    at = written(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    want, first = {}, {}
    for i, t in enumerate(map(str.lower, texts)):
        if t in first:
            want[first[t], i] = (1.0, "exact")
            continue
        for u, k in first.items():
            s = SequenceMatcher(None, u, t).ratio()
            assert s < 0.85 or dedup.may_reach(u, t, 0.85)
            if s >= 0.85:
                want[k, i] = (round(s, 6), "near_duplicate")
        first[t] = i
    assert {(p.first, p.again): (round(p.similarity, 6), p.kind) for p in search.near_dup_pairs(spark, at).collect()} == want
    assert {x.seq for x in search.near_dup_removed(spark, at).collect()} == set(range(len(texts))) - {b for _, b in want}
    mapped = {(x.keep, int(y.split(":")[0])): y.split(":")[1] for x in search.duplicate_map_all(spark, at).collect() for y in x.again.split(",")}
    assert mapped == {k: kind for k, (_, kind) in want.items()} and set(mapped.values()) == {"exact", "near_duplicate"}


def test_turns_of_long_conversations_keep_their_own_keys(spark, tmp_path):
    rows = [(1, k, f"{k:04d}" * 12) for k in range(103)]  # turn 100 of conversation 1 and turn 0 of conversation 2
    rows += [(2, 0, rows[100][2][:-1] + "x"), (2, 1, rows[101][2]), (2, 2, "a turn like no other one")]
    at = written(spark, tmp_path, "conversations", rows, "conv_id long, turn long, text string")
    pairs = {((p.first_conv, p.first_turn), (p.again_conv, p.again_turn)): p.kind for p in search.near_dup_turn_pairs(spark, at).collect()}
    assert pairs[(1, 100), (2, 0)] == "near_duplicate" and pairs[(1, 101), (2, 1)] == "exact"
    gone = {again for _, again in pairs}
    kept = sorted((x.conv_id, x.turn) for x in search.near_dup_turns_removed(spark, at).collect())
    assert kept == sorted({(c, k) for c, k, _ in rows} - gone) and (2, 2) in kept and not {(2, 0), (2, 1)} & set(kept)
    assert (1, 102) in kept


def test_links_of_pages_are_crawled_to_the_end(spark, tmp_path):
    site = "https://example.com/"
    rows = [(k, f"{site}p{k}", f"<html><body><a href='/p{k + 1}'>next</a></body></html>") for k in range(23)]
    at = written(spark, tmp_path, "pages", rows, "page_id long, url string, html string")
    got = {r.url: r.depth for r in pages.crawl_links(spark, at).collect()}
    assert got == {f"{site}p{k}": k for k in range(24)}
