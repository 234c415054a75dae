"""Differences of snapshots against a plain model, and maintained tables against a full rebuild after random edits."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lodeworks.operators.incremental import Maintained, Step, changes

SCHEMA = "page_id long, site string, text string"


def model(old, new):
    """Keys (page_id, site) whose bags of rows differ."""
    bags = [collections.defaultdict(collections.Counter) for _ in (old, new)]
    for bag, rows in zip(bags, (old, new), strict=True):
        for r in rows:
            bag[r[:2]][r] += 1
    out = {}
    for k in {*bags[0], *bags[1]}:
        if bags[0][k] != bags[1][k]:
            out[k] = "added" if not bags[0][k] else "removed" if not bags[1][k] else "changed"
    return out


def found(df):
    rows = [((r.page_id, r.site), r.change) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def edited(rows, dice):
    """Rows with some gone, changed, repeated and new ones."""
    out = []
    for r in rows:
        what = dice.random()
        if what < 0.15:
            continue
        out.append(r if what < 0.7 else (*r[:2], dice.choice([None, "", "  ", "a b c", "a  b c", "x " * dice.randrange(9)])))
        if what > 0.95:
            out.append(out[-1])
    return out + [(dice.choice([None, *range(100, 140)]), dice.choice([None, "s"]), "new words here") for _ in range(5)]


START = [(k, "s" if k % 3 else None, f"text of {k} a b c") for k in range(30)] + [(None, None, "no key"), (None, "s", None)]


def test_changes_equal_the_model(spark):
    dice, rows = random.Random(11), START
    for _ in range(3):
        new = edited(rows, dice)
        want = model(rows, new)
        assert set(want.values()) == {"added", "changed", "removed"}
        assert found(changes(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(new, SCHEMA), ["page_id", "site"])) == want
        rows = new


def test_nulls_and_places_count(spark):
    """A value that moves to the next column, a null that becomes empty, copies."""
    schema = "k long, a string, b string"
    old = spark.createDataFrame([(1, "x", None), (2, None, None), (3, "ab", "c"), (4, "a", "a"), (5, "p", "q"), (5, "r", "s"), (6, "t", "t")], schema)
    new = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "a", "bc"), (4, "a", "a"), (4, "a", "a"), (5, "r", "s"), (5, "p", "q"), (6, "t", "t")], schema)
    assert {r.k: r.change for r in changes(old, new, ["k"]).collect()} == {1: "changed", 2: "changed", 3: "changed", 4: "changed"}
    # The order of columns doesn't count; a column that the old snapshot lacks is null there; names of the operator's own don't clash.
    assert changes(old.select("b", "a", "k"), old, ["k"]).count() == 0
    assert changes(old.withColumn("gone", F.lit(1)), old, ["k"]).count() == 0
    assert changes(old, old.withColumn("sign", F.lit(None).cast("int")), ["k"]).count() == 0
    assert changes(old, old.withColumn("before", F.when(F.col("k") == 6, 1)), ["k"]).first().k == 6
    assert changes(old.limit(0), old, ["k"]).groupBy("change").count().collect() == [("added", 6)]
    assert changes(old, old.limit(0), ["k"]).groupBy("change").count().collect() == [("removed", 6)]


def test_maps_and_long_texts(spark):
    df = spark.range(3).select("id", F.create_map(F.lit("a"), F.col("id"), F.lit("b"), F.lit(0)).alias("m"), F.repeat(F.lit("w "), 400_000).alias("t"))
    turned = df.withColumn("m", F.create_map(F.lit("b"), F.lit(0).cast("long"), F.lit("a"), F.col("id")))
    assert changes(df, turned, ["id"]).count() == 0
    longer = df.withColumn("t", F.when(F.col("id") == 1, F.concat("t", F.lit("w"))).otherwise(F.col("t")))
    assert [(r.id, r.change) for r in changes(df, longer, ["id"]).collect()] == [(1, "changed")]


def words(pages):
    """A row for each word; white space leaves none, and doesn't count."""
    parts = pages.distinct().select("page_id", "site", F.posexplode(F.split(F.trim("text"), " +")).alias("place", "word"))
    return parts.where("word <> ''").groupBy("page_id", "site", "place").agg(F.max("word").alias("word"))


def vectors(rows):
    return rows.select("page_id", "site", "place", F.array(F.length("word"), F.crc32("word")).alias("vector"))


KEYS = ["page_id", "site"]
STEPS = [Step("words", [*KEYS, "place"], words), Step("vectors", [*KEYS, "place"], vectors)]


def bag(df):
    return collections.Counter(tuple(map(str, r)) for r in df.collect())


def test_maintained_tables_equal_a_rebuild(spark, tmp_path):
    kept = Maintained(spark, f"file://{tmp_path}/m", KEYS, STEPS)
    dice, rows, snapshots = random.Random(3), START, []
    for turn in range(4):
        source = spark.createDataFrame(rows, SCHEMA)
        kept.refresh(source)
        snapshots.append(rows)
        assert kept.version() == turn + 1
        assert bag(kept.read()) == bag(source)
        assert bag(kept.read(level="words")) == bag(words(source))
        assert bag(kept.read(level="vectors")) == bag(vectors(words(source)))
        rows = edited(rows, dice)
    # Older versions stay readable; a merge changes nothing but the files.
    assert bag(kept.read(2, "words")) == bag(words(spark.createDataFrame(snapshots[1], SCHEMA)))
    number = kept.merge()
    assert number == 5 and bag(kept.read(level="vectors")) == bag(kept.read(4, "vectors"))
    kept.vacuum()
    kept.refresh(spark.createDataFrame(rows, SCHEMA))
    assert bag(kept.read(level="vectors")) == bag(vectors(words(spark.createDataFrame(rows, SCHEMA))))


def test_only_what_differs_goes_on(spark, tmp_path):
    kept = Maintained(spark, f"file://{tmp_path}/m", KEYS, STEPS)
    rows = [(k, "s", f"one two three{k}") for k in range(10)]
    first = {r.level: tuple(r)[1:] for r in kept.refresh(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert first == {"source": (10, 0, 0, 10), "words": (30, 0, 0, 30), "vectors": (30, 0, 0, 30)}
    rows[0] = (0, "s", "one   two three0")  # white space only: words stay
    rows[1] = (1, "s", "one zwei three1 four")
    del rows[2]
    second = {r.level: tuple(r)[1:] for r in kept.refresh(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert second == {"source": (0, 2, 1, 2), "words": (1, 1, 3, 2), "vectors": (1, 1, 3, 2)}
    assert kept.refresh(spark.createDataFrame(rows, SCHEMA)).agg(F.sum("derived")).first()[0] == 0
    assert kept.version() == 2  # a refresh without changes is no version


def test_empty_snapshots_and_races(spark, tmp_path, monkeypatch):
    kept = Maintained(spark, f"file://{tmp_path}/m", KEYS, STEPS)
    assert kept.read() is None
    empty = spark.createDataFrame([], SCHEMA)
    kept.refresh(empty)
    assert kept.version() == 0
    kept.refresh(spark.createDataFrame(START, SCHEMA))
    kept.refresh(empty)
    assert kept.version() == 2 and kept.read().count() == kept.read(level="vectors").count() == 0
    monkeypatch.setattr(Maintained, "_commit", lambda *_: False)
    with pytest.raises(RuntimeError, match="another refresh"):
        kept.refresh(spark.createDataFrame(START, SCHEMA))
    assert kept.version() == 2 and kept.read().count() == 0
