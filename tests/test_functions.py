"""Scalar rules against values worked out by hand and against plain Python."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeworks.functions import chunking, metadata, quality, text, urls


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def each(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").repartition(2)
    return [r.x for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


ODD = [None, "", "  ", "\xa0\t\n", "a", "Hello   world", "x" * 1000, "<p>A &amp; B</p>", "see https://x.example/y?z=1 now", "mail a.b@c.example.com!", "call 555-123-4567", "wait.... what!!! no??? --- ----", "Ünïcödé ½ ﬁ", " . , ; x", "a,b.c!d?e:f"]


def plain_clean(t):
    t = re.sub(r"&[a-zA-Z0-9#]+;", " ", re.sub(r"<[^>]+>", " ", t or ""))
    t = unicodedata.normalize("NFKD", t)
    for p, by in ((text.URL, " [URL] "), (text.EMAIL, " [EMAIL] "), (text.PHONE, " [PHONE] "), (r"[.]{3,}", "..."), (r"[-]{3,}", "---"), (r"[!]{2,}", "!"), (r"[?]{2,}", "?")):
        t = re.sub(p, by, t)
    return re.sub(r"\s+", " ", t).strip()


def plain_normal(t):
    for p, by in ((r" {2,}", " "), (r"\n +", "\n"), (r" +\n", "\n"), (r" +([,.!?;:])", r"\1"), (r"([,.!?;:])([a-zA-Z])", r"\1 \2")):
        t = re.sub(p, by, t or "")
    return (t or "").strip()


def test_clean_equals_python(spark):
    assert each(spark, text.clean, ODD) == [plain_clean(t) for t in ODD]


def test_normalise_equals_python(spark):
    assert each(spark, text.normalise, ODD) == [plain_normal(t) for t in ODD]


def test_clean_is_idempotent_on_odd_texts(spark):
    r = random.Random(1)
    values = ["".join(r.choice("ab .,!?\n\t<>&;-éß½ ") for _ in range(80)) for _ in range(60)]
    once = each(spark, text.normalise, values)
    assert each(spark, text.normalise, once) == [plain_normal(t) for t in once]


def test_extracted_cleaning_deletes_addresses(spark):
    assert one(spark, text.clean_extracted(F.col("t")), t="a  b &amp; c a@b.example.com 555-123-4567 x....") == "a b & c   x..."


def test_library_cleaning(spark):
    got = one(spark, text.clean_fully(F.col("t")), t="Good text here.\nCopyright © 2024 Someone\n<b>Bold</b> &euro; word , next…\nShare this with all\n")
    assert "Copyright" not in got and "Share" not in got and "Bold" in got and "word, next" in got


def test_preview_cuts_at_sentences_and_words(spark):
    assert one(spark, text.preview(F.col("t"), 10), t="short") == "short"
    assert one(spark, text.preview(F.col("t"), 10), t="abcdefgh. more") == "abcdefgh...."
    assert one(spark, text.preview(F.col("t"), 10), t="a bcdefgh ijkl") == "a bcdefgh..."
    assert one(spark, text.preview(F.col("t"), 10), t="a bcdefghijkl") == "a bcdefghi..."


def test_hashes_and_ids(spark):
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert one(spark, text.content_hash(F.col("t")), t="  A \n b ") == md5("a b")
    assert one(spark, text.record_id(F.col("t"), F.lit(4)), t="abc") == "kb_" + md5("abc")[:12]
    assert one(spark, text.record_id(F.col("t"), F.lit(4)), t="") == "kb_4"


def test_metrics(spark):
    m = one(spark, text.content_metrics(F.col("t")), t="One two. Three four five! Six?")
    assert (m.word_count, m.sentence_count, m.paragraph_count, m.avg_sentence_length) == (6, 3, 1, 2.0)


GOOD = "This is a proper sentence about the history of the town. It goes on with details that readers want to know, and it ends well. " * 3


@pytest.mark.parametrize(("value", "want"), [("x" * 99, 0.0), ("word " * 1100, 0.5), ("abcdefghij " * 12, 0.3), (GOOD, 1.0), (GOOD * 4, 0.9), (GOOD * 8, 0.8)])
def test_length_score(spark, value, want):
    assert one(spark, quality.length_score(F.col("t")), t=value) == want


def test_language_score(spark):
    en, de = F.lit("en"), F.lit("de")
    assert one(spark, quality.language_score(F.col("t"), de), t="the and") == 1.0
    assert one(spark, quality.language_score(F.col("t"), de), t="xyz") == 0.2
    assert one(spark, quality.language_score(F.col("t"), en), t="é" * 30 + "x" * 70) == 0.5
    assert one(spark, quality.language_score(F.col("t"), en), t="é" * 20 + "x" * 80) == 1.0


def test_readability_and_completeness(spark):
    assert one(spark, quality.readability_score(F.col("t")), t="aaaaaa b. This is a fine sentence.") == 0.5
    assert one(spark, quality.readability_score(F.col("t")), t="aaaaa b. This is a fine sentence.") == 1.0
    assert one(spark, quality.readability_score(F.col("t")), t="a. b! c? d, e;") == 0.7
    assert one(spark, quality.completeness_score(F.col("t")), t="Some longer words follow...") == pytest.approx(0.8)
    assert one(spark, quality.completeness_score(F.col("t")), t="a bc def ghij") == pytest.approx(0.6)
    noisy = "Cookie policy, privacy policy, terms and conditions apply. Longer words follow here."
    assert one(spark, quality.completeness_score(F.col("t")), t=noisy) == pytest.approx(0.5)


def test_good_text_scores_above_poor(spark):
    poor = "lol omg!!! ???? zzzzzzzzzzzz"
    total = lambda t: sum(one(spark, f, t=t) for f in (quality.length_score(F.col("t")), quality.readability_score(F.col("t")), quality.completeness_score(F.col("t"))))
    assert total(GOOD) > total(poor)


def test_answer_quality(spark):
    q = one(spark, quality.answer_quality(F.col("t")), t="maybe possibly probably")
    assert q.score == pytest.approx(0.3) and len(q.issues) == 2
    assert one(spark, quality.answer_quality(F.col("t")), t="Our team can help you with that.").issues == []


def test_syllables_and_readability(spark):
    words = {"time": 1, "table": 1, "banana": 3, "rhythm": 1, "": 0, "!!": 0, "area": 2, "the": 1}
    assert each(spark, metadata.syllables, list(words)) == list(words.values())
    assert one(spark, metadata.readability(F.col("t")), t="no end") == 0.0
    assert one(spark, metadata.readability(F.col("t")), t="The cat sat.") == 100.0


def test_keywords_rank_by_score_and_first_place(spark):
    df = spark.createDataFrame([(1, "apple zebra apple Zebra docker server"), (2, "")], "id int, t string")
    got = [(r["rank"], r.keyword) for r in metadata.keywords(df, "id", "t").orderBy("rank").collect()]
    assert got == [(1, "zebra"), (2, "apple"), (3, "docker"), (4, "server")]


def test_terms_and_content_type(spark):
    assert "react" in one(spark, metadata.technical_terms(F.col("t")), t="We use React.")
    assert one(spark, metadata.content_type(F.col("t"), F.lit("https://a/blog/x")), t="we offer") == "blog_post"
    assert one(spark, metadata.content_type(F.col("t"), F.lit(None)), t="We offer help") == "service_description"
    assert one(spark, metadata.content_type(F.col("t"), F.lit("")), t="nothing") == "general_content"


@pytest.mark.parametrize(
    ("url", "kind", "by_path", "valid", "depth"),
    [
        ("https://example.com/", "homepage", "homepage", True, 1),
        ("https://example.com", "other", "homepage", True, 1),
        ("https://example.com/about-us", "about", "about", True, 1),
        ("https://example.com/a/b/c/d", "other", "other", True, 4),
        ("https://example.com/a/b/c/d/e", "other", "other", False, 5),
        ("https://example.com/x.pdf", "other", "other", False, 1),
        ("https://sub.example.com/blog", "blog", "blog", True, 1),
        ("https://other.org/services", "services", "services", False, 1),
        ("https://example.com/a?page=2", "other", "other", False, 1),
    ],
)
def test_urls(spark, url, kind, by_path, valid, depth):
    u = F.col("u")
    got = spark.createDataFrame([(url,)], "u string").select(urls.page_type(u).alias("a"), urls.page_type_of_path(u).alias("b"), urls.valid(u).alias("c"), urls.depth(u).alias("d")).first()
    assert (got.a, got.b, got.c, got.d) == (kind, by_path, valid, depth)


def test_url_names(spark):
    assert one(spark, urls.title(F.col("u")), u="https://a.b/our-great_work/") == "Our Great Work"
    assert one(spark, urls.title(F.col("u")), u="") == "Unknown Source"
    assert one(spark, urls.page_id(F.col("u")), u="https://a.b/c/d") == "a.b_c_d"
    assert one(spark, urls.with_scheme(F.col("u")), u=" a.b ") == "https://a.b"


def test_url_lists(spark):
    df = spark.createDataFrame([(0, " https://example.com/a#x"), (1, "https://example.com/a"), (2, "https://example.com/b.css"), (3, None)], "pos int, url string")
    assert [(r.url, r.pos) for r in urls.filtered(df, "pos").collect()] == [("https://example.com/a", 0)]
    good, bad = urls.split_valid(df)
    assert good.count() == 3 and bad.count() == 1
    assert urls.matching(df, ["B[.]css"]).count() == 1
    hosts = spark.createDataFrame([("a.example",), ("b.example",)], "host string")
    made = [r.url for r in urls.generated(hosts).collect()]
    assert len(made) == len(set(made)) == 2 * 56 and all(u.startswith(("https://a.example", "https://b.example")) for u in made)


SIZES = chunking.Sizes(100, 10, 20)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=600))
def test_chunks_hold_the_limits(t):
    chunks = chunking.Packer(SIZES).chunks(t)
    longest = max(map(len, chunking.split_sentences(t)), default=0)
    assert all(len(c) <= max(SIZES.most, longest + SIZES.overlap + 2) for c in chunks)
    assert not chunks or len(t) >= SIZES.least
    kept = set("".join(chunks).split())
    assert all(w in t for w in kept)


def test_chunk_overlap_and_long_words():
    p = chunking.Packer(chunking.Sizes(40, 5, 17))
    got = p.chunks("One short line. Two short line. Three short line. Four line.")
    assert len(got) > 1 and got[1].startswith("Two short line.")
    assert p.of_words("x" * 90) == ["x" * 40]
    assert p.overlap("no sentence end at all here") == "end at all here"
    assert p.chunks("abc") == [] and p.chunks(None) == []


def fits_behind(chunk, sizes):
    """What may stand before the next chunk's units: the longest of all whole endings that the rules allow."""
    if not sizes.overlap:
        return None
    if len(chunk) <= sizes.overlap:
        return chunk
    found = chunking.split_sentences(chunk)
    endings = [" ".join(found[k:]) for k in range(len(found))]
    allowed = [e for k, e in enumerate(endings) if len(e) <= sizes.overlap and len(found[-1]) < sizes.overlap]
    if allowed:
        return max(allowed, key=len)
    last = chunk[-sizes.overlap :]
    return last if " " not in last or last.startswith(" ") else last[last.index(" ") + 1 :]


def brute_words(text, sizes):
    words, out, begin, at = text.split(), [], 0, 0
    while at < len(words) and len(words[at]) + 1 > sizes.most:
        out.append(words[at][: sizes.most])
        at = begin = at + 1
    while at < len(words):
        at = max(j for j in range(at + 1, len(words) + 1) if j == at + 1 or all(len(" ".join(words[begin:k])) <= sizes.most for k in range(at + 2, j + 1)))
        out.append(" ".join(words[begin:at]))
        begin = max(begin, at - 10) if sizes.overlap else at
    return out


def brute_pack(units, gap, sizes, begin=None):
    out, at, forced = [], 0, begin is None
    while at < len(units) or not forced:
        least = at + forced
        at, before = max(j for j in range(least, len(units) + 1) if all(len(parts_of(begin, units, at, k, gap)) <= sizes.most for k in range(least + 1, j + 1))), at
        out.append(parts_of(begin, units, before, at, gap))
        begin, forced = fits_behind(out[-1], sizes), True
    return out


def parts_of(begin, units, i, j, gap):
    return gap.join([*([] if begin is None else [begin]), *units[i:j]])


def brute_chunks(text, sizes):
    """The chunks of a text, each end found by trying all of them."""
    if not text or len(text) < sizes.least:
        return []
    out, run, last = [], [], False
    for p in [*(p.strip() for p in text.split("\n\n") if p.strip()), None]:
        if p is not None and len(p) <= sizes.most:
            run.append(p)
            continue
        if run:
            out += brute_pack(run, "\n\n", sizes)
            last = p is None
            run = []
        if p is not None:
            units, begin = chunking.split_sentences(p), None
            if len(units[0]) + 1 > sizes.most:
                *done, begin = brute_words(units.pop(0), sizes)
                out += done
            out += [c.strip() for c in brute_pack(units, " ", sizes, begin)]
    return out[:-1] if last and len(out[-1]) < sizes.least else out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abc .!?\n\n", max_size=400), st.sampled_from([(60, 10, 20), (30, 5, 0), (40, 1, 39), (25, 0, 7)]))
def test_chunks_equal_brute_force(t, sizes):
    sizes = chunking.Sizes(*sizes)
    assert chunking.Packer(sizes).chunks(t) == brute_chunks(t, sizes)


def test_chunks_of_long_texts_equal_brute_force():
    r = random.Random(6)
    for _ in range(30):
        t = "".join(r.choice(["word", "longerword", "x" * r.randint(1, 120), "Ends. ", "Why? ", "\n\n", " ", " ", ", "]) for _ in range(r.randint(0, 500)))
        for sizes in (chunking.Sizes(), chunking.Sizes(100, 20, 30), chunking.Sizes(100, 20, 0)):
            assert chunking.Packer(sizes).chunks(t) == brute_chunks(t, sizes)


def test_worker_measures_equal_the_columns(spark):
    values = [v for v in ODD if v] + [GOOD, "One. Two! Three?", "a a a a a a a a a a a", "ab, cd. " * 40]
    c = F.col("t")
    rows = each(spark, lambda c: F.struct(text.normalise(c).alias("normal"), quality.sanity(c).alias("s"), F.size(text.sentences(c)).alias("n")), values)
    for v, row in zip(values, rows, strict=True):
        own = quality.sanity_of(v, len(chunking.split_sentences(v)))
        assert text.normalised(v) == row.normal and row.n == len(chunking.split_sentences(v))
        assert all(own[k] == pytest.approx(row.s[k]) for k in own)


def test_packing_in_the_jvm(spark):
    c = F.col("t")
    t = "\n\n".join(f"para {i} " + "x" * 20 for i in range(6))
    assert one(spark, F.to_json(chunking.by_paragraphs(c, 60, 10)), t=t).count("para") == 6
    assert one(spark, chunking.by_paragraphs(c, 60, 10), t="") == []
    assert one(spark, chunking.by_sentences(c, 20, 1), t="A one. B two. C three. D four.") == ["A one. B two.", "C three. D four."]
    assert one(spark, chunking.simple(c), t="short line\n" + "a" * 300 + ". " + "b" * 300) == ["a" * 300 + ".", "b" * 300 + "."]


def test_chunk_rows_are_the_same_however_partitioned(spark):
    pages = spark.createDataFrame([(f"https://example.com/{i}", GOOD * (i + 1)) for i in range(8)], "url string, text string")
    rows = lambda n: sorted(map(tuple, chunking.chunk_pages(pages.repartition(n)).select("chunk_id", "clean_text").collect()))
    assert rows(1) == rows(5) and len(rows(1)) > 8


def test_missing_metadata_names_counts_twice(spark):
    df = spark.createDataFrame([("a", "u", 0, 0, 5, {"page_title": "t"})], "id string, u string, i int, c int, w int, m map<string,string>")
    got = df.select(quality.missing_metadata(*(F.col(x) for x in ("id", "u", "i", "c", "w", "m"))).alias("x")).first().x
    assert got == ["char_count (invalid)", "metadata.page_type", "metadata.content_type", "metadata.language", "metadata.timestamp", "char_count (invalid)"]


def test_terms_are_what_their_patterns_find(spark):
    texts = [None, "", "Our API/CI/CD on node.js; apis not", "xAPI_ ai éai UX WEB-application", "nodexjs Kubernetes c++ KKubernetes", "scaling scale CI/CDs team's"]
    got = each(spark, lambda c: metadata.technical_terms(c), texts)
    low = lambda t: {x.lower() for p in metadata.TECH_PATTERNS for x in re.findall(p, t, re.IGNORECASE)} | {v for v in metadata.TECH_TERMS if v in t.lower()}
    assert got == [None if t is None else sorted(low(t)) for t in texts]
    own = each(spark, lambda c: metadata.terms(c, [r"\bx+\b", r"\b(?:b|c)\b"], ["zz"]), ["a XX b Czz"])
    assert own == [["b", "xx", "zz"]]
