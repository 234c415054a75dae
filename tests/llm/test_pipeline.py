"""The pipeline's stages against plain versions, and the registration of its queries."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lodeworks.llm import mixing, simhash, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_queries_are_registered():
    names = entry.queries()
    assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 13 and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_effect(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out, _ = corpus_pipeline.staged(stage(spark, at, SF), "test")
        seen.append((name, at, out))
        if name != "token files":
            assert out.columns == docs.columns
        at = out
    (_, _, clean), (_, _, single), (_, before, fresh), (_, _, mix), (_, _, files) = seen
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad
    groups = brute.simhash_groups([(r.doc_id, r.text) for r in clean.collect()])
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in groups.items() if i == c}
    judged = brute.contamination([(r.doc_id, r.text) for r in before.collect()], [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert {r.doc_id for r in fresh.collect()} == {j[0] for j in judged if not j[-1]}
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(fresh).collect()}
    times = {}
    for r in mix.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {i: n for i, (t, s) in taken.items() if (n := int(t / s + 0.5) if s else 1)}
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    order = sorted(((r.doc_id, r.text) for r in mix.collect()), key=lambda r: r[0])
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in files.collect()) == sorted(brute.token_files(order, lambda x: t.encode(x, add_special_tokens=False).ids))
    assert simhash.keep_first(single).count() == single.count()


def test_stages_take_odd_and_empty_tables(spark):
    pytest.importorskip("public_tokenizers")
    rows = [(1, "a good text of some words", "en", "s"), (1, "a good text of some words", "en", "s"), (None, "no id here at all", None, None), (2, None, "en", "s"), (3, "", "en", None), (None, None, None, None), (4, "you worthless idiot scum. " * 9, "en", "s"), (5, "word " * 20_000, "en", "t")]
    schema = "doc_id long, text string, lang string, source string"
    odd = spark.createDataFrame(rows, schema).withColumn("score", F.lit(1)).withColumn("Times", F.lit("x"))
    for docs in (odd, spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "token files" or out.columns == docs.columns
            got = [r.doc_id for r in out.collect()]
            assert (len(got) > 0) == (docs is odd)
            assert name != "toxicity" or docs is not odd or 4 not in got and got.count(1) == 2 and got.count(None) == 2


def test_a_run_leaves_one_table(spark):
    pytest.importorskip("public_tokenizers")
    from lodeworks.llm import common

    at = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    out = corpus_pipeline.run(spark, SF)
    left = set(os.listdir(at)) - before
    assert len(left) == 1 and left.pop().startswith("token-files") and out.count() > 0 and not common._MADE
