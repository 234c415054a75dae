"""The fitted tagger: rounds against plain forward and backward sums, paths against all paths, context that decides, odd rows."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.functions import metadata, tagging
from lodeworks.functions.tagging import TAGS
from lodeworks.plans import text

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plain_round(sentences, model, allowed):
    """One round of expectation and maximisation, a word at a time, unscaled."""
    k, n = len(TAGS), model.emits.shape[1]
    first, moves, emits, likely = np.zeros(k), np.zeros((k, k)), np.zeros((k, n)), 0.0
    for s in sentences:
        a = [model.first * model.emits[:, s[0]]]
        for o in s[1:]:
            a.append(np.array([sum(a[-1][i] * model.moves[i, j] for i in range(k)) * model.emits[j, o] for j in range(k)]))
        b = [np.ones(k)]
        for o in reversed(s[1:]):
            b.insert(0, np.array([sum(model.moves[i, j] * model.emits[j, o] * b[0][j] for j in range(k)) for i in range(k)]))
        p = a[-1].sum()
        likely += np.log(p)
        first += a[0] * b[0] / p
        for t, o in enumerate(s):
            emits[:, o] += a[t] * b[t] / p
            if t:
                moves += np.outer(a[t - 1], model.emits[:, o] * b[t]) * model.moves / p
    first, moves, emits = first + tagging.SMOOTH, moves + tagging.SMOOTH, (emits + tagging.SMOOTH) * allowed
    return tagging.TagModel(model.symbols, first / first.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True), [*model.history, likely])


def sentences_of(seed=3, n=120):
    r = random.Random(seed)
    things, acts, kinds = "dog cat house river watch book".split(), "see take watch book find".split(), "famous red small careful".split()
    return [r.choice([f"the {r.choice(kinds)} {r.choice(things)} and a {r.choice(things)} of the {r.choice(things)}", f"they {r.choice(acts)} the {r.choice(things)} quickly", f"you {r.choice(acts)} this {r.choice(kinds)} {r.choice(things)} on {r.choice(things)} {r.randint(1, 9)}", "watching is finding"]) for _ in range(n)]


def test_rounds_equal_plain_ones(spark):
    rows = sentences_of()
    df = spark.createDataFrame([(". ".join(rows[i : i + 5]),) for i in range(0, len(rows), 5)], "text string").repartition(3)
    plain = tagging.begin(df)
    allowed = plain.emits > 0
    own = [s for r in df.collect() for s in plain.sentences(r.text)[1]]
    assert len(own) == len(rows)
    for _ in range(3):
        plain = plain_round(own, plain, allowed)
    got = tagging.fit(df, rounds=3)
    assert got.symbols == plain.symbols and got.history == pytest.approx(plain.history, abs=1e-2)
    for a, b in ((got.first, plain.first), (got.moves, plain.moves), (got.emits, plain.emits)):
        assert a == pytest.approx(b, rel=1e-3, abs=1e-6)


def test_paths_are_the_best_of_all_paths():
    r = np.random.default_rng(5)
    first, moves, emits = r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(5), 3)
    emits[1, 2] = 0
    some = [r.integers(0, 5, n).astype(np.int32) for n in (1, 2, 3, 6, 6, 4)]

    def chance(s, path):
        p = first[path[0]] * emits[path[0], s[0]]
        for t in range(1, len(s)):
            p *= moves[path[t - 1], path[t]] * emits[path[t], s[t]]
        return p

    for s, got in zip(some, tagging.best_paths(some, first, moves, emits), strict=True):
        assert chance(s, got) == pytest.approx(max(chance(s, p) for p in itertools.product(range(3), repeat=len(s))))


def test_the_neighbours_decide_a_words_tag(spark):
    """watch and book stand both behind pronouns and behind articles: what they are is learned from these alone."""
    df = spark.createDataFrame([(". ".join(sentences_of(n=400)),)], "text string")
    model = tagging.fit(df, rounds=20)
    assert all(b >= a - 1e-3 * abs(a) for a, b in itertools.pairwise(model.history)) and model.history[-1] > model.history[0]

    def tag(s):
        return {t["token"]: t["tag"] for t in model.tags_of(s)}

    for w in ("watch", "book"):
        assert tag(f"they {w} the dog")[w] == tag("they take the dog")["take"]
        assert tag(f"the {w} of the river")[w] == tag("the house of the river")["house"]
        assert tag(f"they {w} the dog")[w] != tag(f"the {w} of the river")[w]
    assert tag("the 7 of it") == {"the": "DT", "7": "CD", "of": "IN", "it": "PRP"}


@tables
def test_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").cache()
    rows = text.tags_fitted(spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = tagging.fit(docs)
    assert len(rows) == len(texts)
    for r in rows:
        words, some = model.sentences(texts[r.doc_id])
        assert r.n_words == len(words)
    for r in rows[:15]:
        assert r.tags.split() == [t["tag"] for t in model.tags_of(texts[r.doc_id])]


@tables
def test_held_out_documents_become_likelier(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").cache()
    fitted, held = tagging.fit(docs.where("doc_id % 5 <> 0")), docs.where("doc_id % 5 = 0").collect()
    start = tagging.begin(docs.where("doc_id % 5 <> 0"))

    def likely(m):
        return sum(x[4] for r in held for x in tagging.expectations(m.sentences(r.text)[1], m.first, m.moves, m.emits))

    assert likely(fitted) > likely(start)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (3, "The dog. The dog"), (None, "run " * 30_000), (4, "7 . !")], "id long, text string")
    model = tagging.fit(df, rounds=2)
    got = {(r.id, r.text): r.tags for r in df.select("id", "text", tagging.tags(F.col("text"), model).alias("tags")).collect()}
    assert got[1, None] == got[2, ""] == got[3, "..."] == "" and got[4, "7 . !"] == "CD"
    assert got[3, "The dog. The dog"].split()[0] == "DT" and len(got[None, "run " * 30_000].split()) == 30_000
    none = tagging.fit(df.where("id = 9"), rounds=1)
    assert [t["tag"] for t in none.tags_of("the 5")] and np.isfinite(none.emits).all()
    tagged = df.where("id = 3").select(metadata.pos_tags(F.col("text"), tag=model.tags_of).alias("t")).collect()
    assert sorted(len(r.t) for r in tagged) == [0, 4]
