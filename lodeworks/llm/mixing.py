"""Mixing sources to target weights by distributed prefix sums over hash-random keys. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.common import positional, running_before, staged

EPOCHS = 3
BLANK = "[\\x20\\x09-\\x0D]"


def size_of(text: Column) -> Column:
    """White-space words of a text; null: 0."""
    parts = F.size(F.split(text, BLANK + "+")) - F.substring(text, 1, 1).rlike(BLANK).cast("int") - F.substring(text, -1, 1).rlike(BLANK).cast("int")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(parts).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) with target: shares of the whole by weight, none above epochs times its source's size.

    Sources take the weights by turns in code point order, null last. What a capped source can't take goes to the others
    by weight. In the order of cap by weight, a source is capped exactly if the level that would hold with all before it
    capped still lies above its own cap by weight; the last such level holds for the rest. One row per source: one task
    orders the sources, of which there may be some millions, not the documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.withColumns({"total": F.sum("source_size").over(whole), "weights": F.sum("weight").over(whole), "caps_before": F.coalesce(F.sum("cap").over(order), F.lit(0)), "weights_before": F.coalesce(F.sum("weight").over(order), F.lit(0))})
    rows = rows.withColumn("level", (F.col("total") - F.col("caps_before")).cast("double") / (F.col("weights") - F.col("weights_before")).cast("double"))
    rows = rows.withColumn("capped", F.col("level") > F.col("cap") / F.col("weight"))
    held = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), held * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """One row per document: id, size, source_size, target and taken, the words of it that the mix takes.

    Each document gets a hash-random key, its id's MD5. Within its source, documents are range-sorted by key and get the
    prefix sum of the sizes before them. A source's budget is its target's whole words: all documents as often as it
    holds the source's size, and then documents in key order up to the rest, the last of them in part. So the words taken
    of a source are its budget exactly, and no document is taken more than epochs times.

    Null texts have size 0 and nothing is taken; a null source is a source of its own; null ids share one key and are
    told apart by size. Rows that repeat id and size are interchangeable: the set of results is the same on each run. An
    empty table gives no rows; other columns are ignored.
    """
    return _mix(docs, id_col, source_col, text_col, weights, epochs).drop("__source", "__key", "__rounds")


def _key(id_col: Column) -> Column:
    return F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def _mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """mix with the documents' sources and keys as __source and __key, and the whole rounds of their source as __rounds."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    sized = sized.withColumn("key", _key(F.col("doc_id")))
    sized, _ = staged(sized, "sizes")  # texts are read and counted once
    placed, _ = running_before(sized, ["source"], ["key", "doc_id", "size"], {"before": "size"}, "mix")
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs).withColumnRenamed("source", "s")
    # One row per source, broadcast only if Spark finds it below its threshold.
    rows = placed.join(goals, F.col("source").eqNullSafe(F.col("s")), "left")
    budget = F.floor("target")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget - rounds * F.col("source_size") - F.col("before")))
    return rows.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (rounds * F.col("size") + rest).cast("long").alias("taken"), F.col("source").alias("__source"), F.col("key").alias("__key"), rounds.cast("int").alias("__rounds"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents as often as the mix takes them, to the nearest whole document, with their own columns.

    A document of which less than half is taken goes; one that is taken twice comes twice. Documents without words stay:
    they cost no budget. In the order of key, id and size a source's documents come once more than its whole rounds up to
    a cut, and then as often as those, so that a plan of one row per source says it all and no text is shuffled. Rows that
    are equal in key, id, size and source at the cut share the copies that fall to them, the first by their texts' hash
    ahead; only these rows are counted off.

    Null ids and sources count as in mix, an empty table stays empty, columns of any name pass unchanged.
    """
    plan, at = _mix(docs, id_col, source_col, text_col), [c.lower() for c in docs.columns]
    more = F.col("taken") - F.col("__rounds") * F.col("size")
    place = F.struct(F.col("__key").alias("key"), F.col(id_col).alias("id"), F.col("size").alias("size"))
    rows = plan.where("size > 0").select("__source", "__rounds", place.alias("place"), (2 * more >= F.col("size")).cast("int").alias("once_more"))
    # One row per source and place: rows that share a place are told from the cut by how many of them it takes.
    places = rows.groupBy("__source", "__rounds", "place").agg(F.sum("once_more").alias("over"), F.count("*").alias("n"))
    cuts = places.groupBy("__source", "__rounds").agg(F.max(F.when(F.col("over") > 0, F.struct("place", "over", "n"))).alias("cut"))
    cuts, _ = staged(cuts.select(F.col("__source").alias("cut_source"), F.col("__rounds").alias("rounds"), "cut.place", "cut.over", "cut.n"), "cuts")
    names = [f"c{i}" for i in range(len(at))]
    i, source, text = (F.col(names[at.index(c.lower())]) for c in (id_col, source_col, text_col))
    full = F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    wide = positional(docs).join(cuts, source.eqNullSafe(F.col("cut_source")), "left").withColumn("key", _key(i))
    # Sizes are counted only where key and id are the cut's own.
    edge = (F.col("key") == F.col("place.key")) & i.eqNullSafe(F.col("place.id"))
    own = F.when(edge, F.struct(F.col("key"), i.alias("id"), size_of(text).alias("size")))
    side = F.when(F.col("place").isNull(), 1).when(~edge, F.when(F.struct(F.col("key"), i.alias("id")) < F.struct(F.col("place.key"), F.col("place.id")), -1).otherwise(1))
    side = F.coalesce(side, F.when(own == F.col("place"), 0).when(own < F.col("place"), -1).otherwise(1))
    wide = wide.withColumn("side", F.when(~full, 2).otherwise(side))
    times = F.when(F.col("side") == 2, F.lit(1)).otherwise(F.col("rounds") + (F.col("side") < 1).cast("int"))
    out = wide.where("side <> 0 or over = n").select(*names, times.alias("times"))
    if not cuts.where("over < n").isEmpty():
        shared = wide.where("side = 0 and over < n").withColumns({"one": F.lit(1), "hash": F.xxhash64(text), "row": F.monotonically_increasing_id()})
        shared, _ = running_before(shared.select(*names, "cut_source", "rounds", "over", "one", "hash", "row"), ["cut_source"], ["hash", "row"], {"ahead": "one"}, "shared")
        out = out.unionAll(shared.select(*names, (F.col("rounds") + (F.col("ahead") < F.col("over")).cast("int")).alias("times")))
    copies = out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select(*names)
    return copies.toDF(*docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
      coalesce(sum(cap) OVER p, 0) AS caps_before, coalesce(sum(weight) OVER p, 0) AS weights_before
      FROM w WINDOW p AS (ORDER BY cap::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - caps_before)::DOUBLE / (weights - weights_before)::DOUBLE AS level FROM o),
c AS (SELECT *, level > cap::DOUBLE / weight AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE
      ELSE least(cap::DOUBLE, max(CASE WHEN NOT capped THEN level END) OVER () * weight) END AS target FROM c),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d),
j AS (SELECT b.doc_id, b.size::BIGINT AS size, t.source_size, t.target, b.before, floor(t.target)::BIGINT AS budget,
      CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS rounds
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (rounds * size + greatest(0, least(size, budget - rounds * source_size - before)))::BIGINT AS taken FROM j
"""
