"""The fitted language model: held-out accuracy, equality with a plain version, odd rows."""

import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import language, metadata
from lodeworks.plans import text

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plain_grams(t):
    t = f" {re.sub(r'[\W\d_]+', ' ', (t or '').lower()).strip()} "
    return Counter(t[i : i + 3] for i in range(len(t) - 2))


@tables
def test_held_out_documents_get_their_language(spark):
    rows = text.language_fitted(spark, SF).collect()
    own = [r for r in rows if r.held_out and r.lang is not None]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and len(own) > 100
    assert sum(r.lang == r.language for r in own) >= 0.98 * len(own)


@tables
def test_scores_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(language, "HELD", 500)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    rows = [(r.text, r.lang) for r in docs.collect() if r.text is not None and r.lang is not None]
    counts = {}
    for t, lang in rows:
        counts.setdefault(lang, Counter()).update(plain_grams(t))
    assert model.names == sorted(counts)
    key = {}
    for own in counts.values():
        for g in own:
            x = 0
            for ch in g:
                x = (x * 0x9E3779B97F4A7C15 + ord(ch)) % (1 << 64)
            x ^= x >> 29
            key[g] = x - (1 << 64) if x >> 63 else x
    held = {g for own in counts.values() for g in sorted(own, key=lambda g: (-own[g], key[g]))[:500]}
    top = {lang: set(sorted(own, key=lambda g: (-own[g], key[g]))[:500]) for lang, own in counts.items()}
    n = Counter(lang for _, lang in rows)
    for t, _ in rows[:60]:
        total = {lang: math.log(n[lang]) + sum(k * math.log(((own[g] if g in top[lang] else 0) + 1) / (sum(own.values()) + len(held))) for g, k in plain_grams(t).items() if g in held) for lang, own in counts.items()}
        best = max(sorted(total), key=total.get)
        share = 1 / sum(math.exp(min(700, v - total[best])) for v in total.values())
        got = model.scores(t)
        assert got[0] == best and got[1] == pytest.approx(share, abs=2e-6)


def test_odd_rows(spark):
    schema = "text string, lang string"
    none = language.fit(spark.createDataFrame([(None, "en"), ("a text", None)], schema))
    assert none.scores("x") == (None, 0.0)
    model = language.fit(spark.createDataFrame([("the house and the garden", "en"), ("das haus und der garten", "de"), ("", "en"), ("der die das", "de"), ("123", "en")], schema))
    assert model.scores("the garden")[0] == "en" and model.scores("der garten und")[0] == "de"
    assert model.scores(None)[0] == model.scores("")[0] == "en"
    df = spark.createDataFrame([("und das haus",), (None,)], "text string")
    got = [r.metadata.language.language for r in metadata.describe(df, "text", F.lit("https://example.com"), language.detect(F.col("text"), model)).collect()]
    assert got == ["de", "en"]
