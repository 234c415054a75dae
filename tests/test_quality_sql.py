"""Quality queries against their SQL on odd documents: empty and null texts, repeated ids, rare letters and line ends."""

import collections

import pytest

from lodeworks.plans.catalog import ORACLES, QUERIES
from tests.test_oracles import plain

NOISE = "terms{0}and conditions, all rights{0}reserved, {1}kip to content, {1}ubscribe to our newsletter, back to top. "
ROWS = [
    (1, "", "en"), (2, "", "de"), (3, "  ", "en"), (4, None, "en"), (5, None, "fr"), (6, None, None),
    (7, "A text that the whole table has twice under one id, of more than a hundred characters, so that no issue is found in it.", "en"),
    (7, "A text that the whole table has twice under one id, of more than a hundred characters, so that no issue is found in it.", "en"),
    (None, "A text without a place.", "en"), (None, "A text without a place.", "en"),
    *((10 + k, NOISE.format(end, s) * 2, "en") for k, (end, s) in enumerate([("\n", "s"), ("\r", "s"), (" ", "s"), (" ", "ſ"), ("\r", "ſ")])),
    (20, "ΟΔΟΣ text", "el"), (21, "οδοσ text", "el"), (22, "οδος text", "el"), (23, "İT İS", "tr"), (24, "it is", "tr"), (25, "\x1c\x1d\x1e\x1f\x1c x", "en"),
]


@pytest.mark.parametrize("name", ["quality_scores", "quality_report", "quality_pass", "quality_issues_topk"])
def test_odd_documents_equal_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rows = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert got == collections.Counter(tuple(map(plain, r)) for r in rows)
