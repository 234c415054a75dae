"""Queries without SQL against plain Python over whole tables."""

import math
import os
import re
import zlib
from collections import OrderedDict
from difflib import SequenceMatcher

import numpy as np
import pytest

from lodeworks.functions import chunking, metadata, quality
from lodeworks.operators import chat
from lodeworks.plans import pages, pipeline, search
from lodeworks.plans import text as texts
from tests.test_functions import brute_chunks, plain_clean, plain_normal

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def vector(t, size=64):
    out = np.zeros(size, np.float32)
    for w in t.lower().split():
        h = zlib.crc32(w.encode())
        out[h % size] += 1 if h >> 31 else -1
    return (out / max(np.linalg.norm(out), 1e-12)).astype(np.float32)


def cosine(a, b):
    a, b = a.astype(float), b.astype(float)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else None


def chunk_table(items, sizes):
    out = []
    for page, t in items:
        for k, c in enumerate(brute_chunks(plain_clean(t), sizes)):
            tidy = plain_normal(c)
            found = chunking.split_sentences(tidy)
            s = quality.sanity_of(tidy, len(found), sizes.least)
            if len(tidy) >= sizes.least and s["score"] >= 0.3:
                out.append((page, k, tidy, len(tidy), len(tidy.split()), len(found), round(s["score"], 6)))
    return out


def test_live_chunks(spark):
    want = chunk_table([(f"example.com_documents_{d.doc_id}", d.text) for d in rows(spark, "documents")], chunking.Sizes())
    got = [(r.chunk_id.rsplit("_", 1)[0], r.chunk_index, r.clean_text, r.char_count, r.word_count, r.sentence_count, r.score) for r in texts.chunk_live(spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) > 300


def test_smart_chunks(spark):
    def pack(parts, glue):
        out, now = [], ""
        for p in parts:
            if now and len(now) + len(glue) + len(p) > 800:
                out.append(now)
                now = p
            else:
                now = now + glue + p if now else p
        return out + [now] * (len(now) >= 100)

    want = []
    for d in rows(spark, "documents"):
        found = [c for p in pack([x.strip() for x in d.text.split("\n\n") if x.strip()], "\n\n") for c in (pack(chunking.split_sentences(p), " ") if len(p) > 800 else [p])]
        want += [(d.doc_id, k, c) for k, c in enumerate(found)]
    got = [(r.doc_id, r.chunk_index, r.chunk) for r in texts.QUERIES["chunk_smart"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def article(markup):
    """The texts of a page's article, by its tags alone: these pages have one and nothing to prune in it."""
    body = re.search(r"<article>(.*?)</article>", markup, re.S).group(1)
    import html

    parts = []
    for tag, text in re.findall(r"<(/?[a-z0-9]+)[^>]*>|([^<]+)", re.sub(r"<!--.*?-->", "", body, flags=re.S)):
        if text and text.strip():
            parts.append(html.unescape(text).strip())
        elif tag in ("p", "br", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li"):
            parts.append("\n")
    return " ".join(parts)


def plain_extracted(t):
    from lodeworks.functions import text

    t = " ".join(t.split())
    for entity, by in text.ENTITIES:
        t = t.replace(entity, by)
    for p, by in ((text.URL, ""), (text.EMAIL, ""), (text.PHONE, ""), (r"[.]{3,}", "..."), (r"[-]{3,}", "---")):
        t = re.sub(p, by, t)
    return t.strip()


def test_extracted_pages(spark):
    found = rows(spark, "pages")
    want = {p.page_id: plain_extracted(article(p.html)) for p in found}
    got = {r.page_id: r for r in pages.html_extract(spark, SF).collect()}
    assert {k: r.clean_text for k, r in got.items()} == want
    measured = {r.page_id: (r.character_count, r.word_count) for r in pages.html_metrics(spark, SF).collect()}
    assert measured == {k: (len(t), len(t.split())) for k, t in want.items()}
    good = {r.page_id: r.is_quality for r in pages.html_quality(spark, SF).collect()}
    assert good == {p.page_id: len(p.html) >= 100 and len(want[p.page_id].split()) >= 20 and bool(got[p.page_id].title) for p in found}


def test_all_content_of_pages(spark):
    want = {}
    for p in rows(spark, "pages"):
        strings = " ".join(x.strip() for x in article(p.html).split("\n") if x.strip())
        want[p.page_id] = " ".join(strings.split())
    got = {r.page_id: r.content for r in pages.html_extract_all(spark, SF).collect()}
    long = {k for k, t in want.items() if len(t) > 100}
    assert got.keys() == want.keys() and len(long) > 10
    assert {k: got[k] for k in long} == {k: want[k] for k in long}


def test_ingested_pages(spark):
    import hashlib

    content = [(p.page_id, p.url.replace("https://", "").replace("/", "_"), plain_extracted(article(p.html))) for p in sorted(rows(spark, "pages"), key=lambda p: p.page_id)]
    sizes = chunking.Sizes(1000, 100, 100)
    chunks = [(page, own, c) for page, own, t in content for c in chunk_table([(own, t)], sizes)]
    frame = spark.createDataFrame([(f"{own}_{c[1]}", c[2]) for _, own, c in chunks], "id string, t string")
    from pyspark.sql import functions as F

    issues = {r.id: r.issues for r in quality.measured(frame, "t", F.lit("en")).collect()}
    seen, want = set(), []
    for _, own, c in chunks:
        key = hashlib.md5(c[2].encode()).hexdigest()
        if key not in seen and all(i.startswith("non_english_content") for i in issues[f"{own}_{c[1]}"]):
            seen.add(key)
            want.append((f"{own}_{c[1]}", c[1], key, "kb_" + key[:12], 64))
    got = [tuple(r) for r in pipeline.ingest_pages(spark, SF).select("chunk_id", "chunk_index", "content_hash", "record_id", "size").collect()]
    assert sorted(got) == sorted(want) and len(got) > 50


def test_embedded_search(spark):
    docs = [(d.doc_id, vector(d.text)) for d in rows(spark, "documents")]
    got = {}
    for r in search.embed_search(spark, SF).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
    for q in rows(spark, "benchmark"):
        v = vector(q.text)
        scored = sorted(((-cosine(x, v) if cosine(x, v) is not None else math.inf), i) for i, x in docs)[:3]
        assert [got[q.item_id][k + 1][1] for k in range(3)] == pytest.approx([-s for s, _ in scored], abs=2e-5)


def test_recent_uniqueness(spark):
    parts = {r.doc_id: r for r in texts.quality_scores(spark, SF).collect()}
    docs = sorted(rows(spark, "documents"), key=lambda d: d.doc_id)
    got = {r.doc_id: (r.uniqueness_score, r.similar_to) for r in texts.quality_recent(spark, SF).collect()}
    assert len(got) == len(docs)
    for source in {d.source for d in docs}:
        recent = OrderedDict()
        for d in (d for d in docs if d.source == source):
            t = re.sub(r"\s+", " ", d.text.lower().strip())
            score, found = 1.0, None
            if t in recent:
                score, found = 0.0, recent[t]
            else:
                for old, k in list(recent.items())[-50:]:
                    if SequenceMatcher(None, t, old).ratio() >= 0.85:
                        score, found = 0.2, k
                        break
            assert got[d.doc_id] == (score, found)
            p = parts[d.doc_id]
            others = p.length_score * 0.2 + p.language_score * 0.15 + p.readability_score * 0.25 + p.completeness_score * 0.2
            harmful = [i for i in p.issues.split("; ") if i and not i.startswith(("non_english_content", "duplicate_content"))]
            if not harmful and others + 0.2 * score >= 0.7 and t not in recent:
                recent[t] = d.doc_id


def test_metadata_structs(spark):
    top = {}
    for r in texts.keywords_topk(spark, SF).collect():
        top.setdefault(r.doc_id, {})[r["rank"]] = r.keyword
    terms = {r.doc_id: r for r in texts.terms(spark, SF).collect()}
    kinds = {d.doc_id: d for d in rows(spark, "documents")}
    found = texts.metadata_struct(spark, SF).collect()
    assert {r.doc_id for r in found} == set(kinds)
    right = 0
    for r in found:
        d = kinds[r.doc_id]
        assert r.keywords == ",".join(top.get(r.doc_id, {}).get(k, "") for k in sorted(top.get(r.doc_id, {})))
        assert r.technical_terms == terms[r.doc_id].technical_terms
        assert r.tags == " ".join(f"{x['token']}/{x['tag']}" for x in metadata.tags_of(d.text, 500))
        language, sure = metadata.language_of(d.text, metadata.PROFILES)
        assert r.language == language and r.language_confidence == pytest.approx(sure, abs=2e-5)
        right += r.language == d.lang
    assert right > 0.8 * len(found)


def test_entities_and_tags_by_hand():
    assert metadata.entities_of("We met Ada Lovelace in Paris, with Ada Lovelace.", 1000) == [{"text": "Ada Lovelace", "type": "PERSON_OR_ORG"}, {"text": "Paris", "type": "NAME"}]
    assert [x["tag"] for x in metadata.tags_of("The 3 cats quickly jumped on it", 500)] == ["DT", "CD", "NNS", "RB", "VBD", "IN", "PRP"]
    assert metadata.entities_of(None, 10) == [] == metadata.tags_of(None, 10)
    assert metadata.language_of("", metadata.PROFILES) == ("en", 0.5) and metadata.language_of("le chat est dans la maison", metadata.PROFILES)[0] == "fr"


def test_batch_of_chats(spark):
    docs = {d.doc_id: d for d in rows(spark, "documents")}
    vectors = [(k, vector(d.text)) for k, d in sorted(docs.items())]
    asked = [(f"{t.conv_id}:{t.turn}", search.LEADS[(t.conv_id + t.turn) % len(search.LEADS)] + t.text) for t in rows(spark, "conversations") if t.role == "user"]
    told = {r.query_id: r for r in search.chat_batch(spark, SF).collect()}
    checked = {f"{r.conv_id}:{r.turn}": r for r in search.query_process(spark, SF).collect()}
    assert told.keys() == {k for k, _ in asked} == checked.keys()
    n_hits = 0
    for k, q in asked:
        r, c = told[k], checked[k]
        assert r.error == c.error and r.category == c.category
        if c.error:
            assert r.answer == c.error and r.confidence == 0.0
            continue
        if c.category == "off_topic":
            assert r.answer == chat.DECLINED and r.follow_ups == ""
            continue
        v = vector(re.sub(r"[^\w\s.?!,\-:]", "", " ".join(q.split())).lower())
        least = 0.2 if any(t in q.lower() for t in chat.CONTACT_TERMS) else 0.3
        best = sorted((-cosine(x, v), i) for i, x in vectors if cosine(x, v) is not None)[:10]
        hits = [i for s, i in best if -s >= least]
        assert r.n_results == len(hits) and r.follow_ups == c.follow_ups
        assert (r.answer == chat.NO_CONTEXT) == (not hits) and (r.confidence == 0.1) == (not hits)
        if hits:
            n_hits += 1
            assert any(docs[i].text[:40].replace("...", ". ") in r.answer for i in hits)
    assert n_hits > 5 and {r.level for r in told.values()} <= {"HIGH", "MEDIUM", "LOW"}


def plain_library(t):
    """Markup, Unicode, noise, white space and punctuation, as the rules say it."""
    import html
    import unicodedata

    from lodeworks.functions import text

    t = html.unescape(re.sub(r"<[^>]+>", "", t or ""))
    for p in (r"(?s)<!--.*?-->", r"(?is)<style[^>]*>.*?</style>", r"(?is)<script[^>]*>.*?</script>"):
        t = re.sub(p, "", t)
    t = re.sub(r"""\s+(class|id|style|href|src|alt|title)=["'][^"']*["']""", "", t)
    t = unicodedata.normalize("NFC", t).translate(str.maketrans("´`\t–—―•◦‣", "'' ---***")).replace("…", "...")
    t = "".join(ch for ch in t if ch.isprintable() or ch in "\n\t")
    for p in text.BOILERPLATE:
        t = re.sub("(?im)" + p, "", t)
    for p in (text.URL, text.EMAIL, text.PHONE, text.PHONE_PARENS, text.PHONE_PLUS):
        t = re.sub(p, "", t)
    for p, by in ((r"[.]{3,}", "..."), (r"[-]{3,}", "---"), (r"[!]{2,}", "!"), (r"[?]{2,}", "?"), (r"\n[.!?*-]+\n", "\n"), (r"[ \t]+", " "), (r"\n\s*\n\s*\n+", "\n\n")):
        t = re.sub(p, by, t)
    t = "\n".join(map(str.strip, t.split("\n"))).strip()
    for p, by in (
        (r"([.!?])\s*([A-Z])", r"\1 \2"), (r"([,;:])\s*([A-Za-z])", r"\1 \2"), (r"\s+([,.!?;:])", r"\1"), (r"([,.!?;:])\s*([^\s])", r"\1 \2"),
        (r"([,.!?;:])\1+", r"\1"), (r"\s*,\s*", ", "), (r"\s*\.\s*", ". "), (r"\n[,.!?;:]+\s*", "\n"),
    ):
        t = re.sub(p, by, t)
    return t.strip()


def test_library_cleaning_of_a_table(spark):
    got = {r.doc_id: (r.clean_text, r.reduction_ratio) for r in texts.text_clean_library(spark, SF).collect()}
    for d in rows(spark, "documents"):
        want = plain_library(d.text)
        assert got[d.doc_id][0] == want
        assert got[d.doc_id][1] == pytest.approx((len(d.text) - len(want)) / len(d.text) if d.text else 0.0)
