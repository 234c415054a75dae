"""Operators do the whole job on small tables that the driver's tables don't show."""

from collections import Counter

from pyspark.sql import functions as F

from lodeworks.llm import licenses, mixing, multiindex


def test_repeated_rows_share_the_copies_of_a_cut(spark):
    rows = [(7, f"a{k} " * 10, "a") for k in range(10)] + [(7, f"b{k} " * 10, "b") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for frame in (docs, docs.withColumn("doc_id", F.lit(None).cast("long"))):
        out = mixing.mixed(frame)
        assert out.columns == docs.columns
        got = Counter(r.text for r in out.collect())
        by = {s: sum(n for t, n in got.items() if t.startswith(s)) for s in "ab"}
        assert by == {"a": 7, "b": 13}  # budgets of 66 and 133 words; before, every row came as often as the best placed
        assert {n for t, n in got.items() if t.startswith("b")} == {1, 2} and set(got.values()) == {1, 2}


def test_vectors_of_every_length_link(spark):
    rows = [(k, [1.0, 0.01 * k, 2.0, 3.0]) for k in range(5)] + [(10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [2.0, 4.0]), (13, [-1.0, 0.5])]
    rows += [(20, [0.5]), (21, [7.0]), (22, [-1.0]), (23, [-3.0]), (24, [-3.0]), (30, [1.0, 1.0, 1.0]), (40, [0.0]), (41, [])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multiindex.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[k][:2] for k in range(5)] == [(4, 0)] * 5
    assert [got[k][:2] for k in (10, 11, 12, 13)] == [(2, 10), (2, 10), (2, 10), (0, 13)]
    assert [got[k][:2] for k in (20, 21, 22, 23, 24)] == [(1, 20), (1, 20), (2, 22), (2, 22), (2, 22)]
    assert [got[k] for k in (30, 40, 41)] == [(0, k, True) for k in (30, 40, 41)] and not got[11][2] and len(got) == len(rows)


def test_license_bodies_and_every_notice_are_found(spark):
    notice, filler = licenses.TEMPLATES["isc"], " one two three four five six seven eight nine ten eleven twelve thirteen "
    bodies = [(100 * k + j, label, p) for k, (label, body) in enumerate(licenses.BODIES.items()) for j, p in enumerate(body)]
    rows = [(i, p) for i, _, p in bodies] + [(9000, filler.join([notice] * 3)), (9001, f"{notice} {notice} {notice}")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score == 1.0 for i, label, _ in bodies)
    n = len(licenses.lexical(notice))
    for i, gap in ((9000, n + 13), (9001, n)):
        assert [(s.begin, s.end) for s in got[i].spans if s.label == "isc"] == [(k * gap, k * gap + n) for k in range(3)]
