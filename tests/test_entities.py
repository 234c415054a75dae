"""Fitted entities: counts against plain ones, paths against all paths, what casing and cues decide, held-out names, odd rows."""

import itertools
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import entities, metadata
from lodeworks.plans import text

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
PEOPLE, PLACES, FIRMS = "Miller Jones Weber Novak Rossi Silva".split(), "Berlin Lisbon Oslo Prague Vienna Madrid".split(), "Acme Globex Initech Umbra Vandelay Hooli".split()
THINGS, ACTS = "house water letter garden bridge market".split(), "saw painted sold found watched left".split()


def corpus(seed, n=600):
    """Sentences with the names that are in them and their kinds."""
    r, out = random.Random(seed), []
    for _ in range(n):
        who, where, firm, thing, act = map(r.choice, (PEOPLE, PLACES, FIRMS, THINGS, ACTS))
        out.append(r.choice([
            (f"Yesterday Dr {who} {act} the {thing} in {where}", [(who, "PERSON"), (where, "GPE")]),
            (f"The {thing} of {firm} Inc was {act} again", [(f"{firm} Inc", "ORGANIZATION")]),
            (f"{thing.title()} and {r.choice(THINGS)} were {act} by {who}", [(who, "PERSON")]),
            (f"{where} has a {thing}, and {firm} {act} it", [(where, "GPE"), (firm, "ORGANIZATION")]),
            (f"Again they {act} the {thing} yesterday", []),
            (f"We {act} the Bank of {where} again", [(f"Bank of {where}", "ORGANIZATION")]),
        ]))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = [s for s, _ in corpus(1)]
    return entities.fit(spark.createDataFrame([(". ".join(rows[i : i + 6]),) for i in range(0, len(rows), 6)], "text string").repartition(3))


def test_names_of_other_sentences(model):
    right = wanted = found = 0
    for s, names in corpus(2, 300):
        got = Counter((e["text"], e["type"]) for e in model.entities_of(s))
        right, wanted, found = right + sum((got & Counter(names)).values()), wanted + len(names), found + sum(got.values())
    assert right >= 0.95 * wanted and right >= 0.95 * found


def test_casing_decides_where_a_sentence_begins(model):
    assert model.entities_of("Berlin has a house.") == [{"text": "Berlin", "type": "GPE"}]
    assert model.entities_of("Water has a house. Yesterday was water.") == []
    assert model.entities_of("They left. Mr Unknownname saw it.") == [{"text": "Unknownname", "type": "PERSON"}]
    assert "of" in model.joins and "the" not in model.joins


def test_german_nouns_are_no_names(model):
    s = "Gestern hat der Mann das Haus und die Straße mit dem Hund gesehen und Herr Weber hat den Garten gekauft"
    assert model.entities_of(s) == [{"text": "Weber", "type": "PERSON"}]


def test_paths_are_the_best_of_all_paths(model):
    """Labels: outside, head, within, connector. Every labelling is scored by the rules; spans have the best score."""
    go, end = math.log(model.follow), math.log(1 - model.follow)

    def score(words, emit, path):
        total, last = 0.0, 0
        for (w, begins), e, s in zip(words, emit, path, strict=True):
            if s in (0, 1):
                if last == 3:
                    return -math.inf
                total += (end if last in (1, 2) else 0.0) + (e - entities.NEED - (entities.PARTED if last and not begins else 0.0) if s == 1 else 0.0)
            elif begins or last == 0 or (s == 3 and (last == 3 or w not in model.joins)) or (s == 2 and e == -math.inf):
                return -math.inf
            else:
                total += (0.0 if last == 3 else go) + (max(e, -1.0) if s == 2 else entities.JOINED)
            last = s
        return -math.inf if last == 3 else total + (end if last in (1, 2) else 0.0)

    r = random.Random(4)
    for _ in range(25):
        words = list(entities.tokens_of(" ".join(r.choice([*PEOPLE[:2], *PLACES[:2], "Bank", "of", "the", "Water", "sold", "Dr", "Inc"]) for _ in range(6))))
        emit = model.scores(words)
        path = [0] * len(words)
        for k, n, _ in model.spans(" ".join(w for w, _ in words)):
            path[k:n] = [1, *(3 if not words[i][0][0].isupper() else 2 for i in range(k + 1, n))]
        assert score(words, emit, path) == pytest.approx(max(score(words, emit, p) for p in itertools.product(range(4), repeat=len(words))))


@tables
def test_counts_and_query_over_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    capital, small = Counter(), Counter()
    for t in texts.values():
        for w, begins in entities.tokens_of(t):
            if not begins and w[0].isalpha():
                (capital if w[0].isupper() else small)[w.lower()] += 1
    model = entities.fit(docs)
    assert set(model.odds) == set(sorted(capital, key=lambda w: (-capital[w], w))[: entities.HELD])
    for w, o in model.odds.items():
        p = (capital[w] + 0.5) / (capital[w] + small[w] + 1)
        assert o == pytest.approx(max(-entities.MOST, min(entities.MOST, math.log(p / (1 - p)))))
    want = Counter((i, k, e["text"], e["type"]) for i, t in texts.items() for k, e in enumerate(model.entities_of(t)))
    got = Counter(map(tuple, text.entities_fitted(spark, SF).collect()))
    assert got == want and got


def test_odd_rows(spark, model):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "... !", 0), (4, "Berlin", 0), (4, "Berlin", 0), (None, "the Berlin " * 20_000, 0)], "id long, text string, type int")
    got = [(r.id, [tuple(e) for e in r.e]) for r in df.select("id", entities.entities(F.col("text"), model).alias("e")).collect()]
    assert [e for i, e in got if i in (1, 2, 3)] == [[], [], []] and got[3][1] == got[4][1] == [("Berlin", "GPE")]
    none = entities.fit(df.where("id = 9"))
    assert none.entities_of("the Mr Smith") is not None and none.entities_of(None) == []
    rows = df.where("id = 4").select(metadata.named_entities(F.col("text"), recognise=model.entities_of).alias("e")).collect()
    assert all(r.e[0].text == "Berlin" for r in rows)


def test_words_are_found_once_a_text(monkeypatch):
    calls, tokens_of = [], entities.tokens_of
    monkeypatch.setattr(entities, "tokens_of", lambda t: calls.append(t) or tokens_of(t))
    model = entities.EntityModel({"anna": 3.0, "berg": 3.0}, {}, frozenset(), 0.5, -3.0)
    assert model.entities_of("we saw Anna Berg there and then went on") == [{"text": "Anna Berg", "type": "PERSON"}] and len(calls) == 1
