"""Chat formatting after a collapse of cumulative snapshots. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.common import drop_path, partitions, staged


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def _mark(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _offsets(rows: DataFrame, amounts: dict[str, Column]) -> DataFrame:
    """For each key and part the sums of the amounts over the key's earlier parts, and over all its parts (total_)."""
    sums = rows.groupBy("key", "part").agg(*(F.sum(c).alias(n) for n, c in amounts.items()))
    whole = Window.partitionBy("key")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("key", "part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in amounts), *(F.sum(n).over(whole).alias(f"total_{n}") for n in amounts))


def collapse(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The conversations that no longer one continues: (first id, n_turns, n_equal).

    A turn's prefix hash is the running sum, over its conversation, of two 64-bit hashes of place, role and text: 128
    bits that roll along without any conversation being in one task. Conversations of equal length and hash are equal
    and the smallest id stands for them; one whose length and hash are a longer one's prefix at that length goes. Texts
    stand in for themselves as their MD5; they aren't shuffled. Turns are range-partitioned over conversation and order
    once; places and hashes are summed up within the parts, and what a conversation's earlier parts hold is added.

    Rows that repeat all four columns count once; null ids are one conversation, and null roles and texts differ from any
    given ones. An empty table gives no rows; other columns are ignored.
    """
    spark, text = turns.sparkSession, F.col(text_col)
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), _mark(text).alias("mark"), text.isNull().alias("none")).distinct()
    order = ["turn", "role", "mark", "none"]
    ranged = rows.repartitionByRange(partitions(spark), "conv", *order).withColumn("part", F.spark_partition_id())
    ranged, ranged_at = staged(ranged.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))), "turns")
    placed = ranged.join(_offsets(ranged, {"one": F.lit(1)}), ["key", "part"])
    inside = Window.partitionBy("key", "part").orderBy(*order)
    placed = placed.withColumn("n", F.col("one") + F.row_number().over(inside))
    seen = [F.col("n"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("mark"), F.col("none")]
    h, g = F.xxhash64(F.lit(1), *seen), F.xxhash64(F.lit(2), *seen)
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    parts = {"h0": low(h), "h1": F.shiftrightunsigned(h, 32), "h2": low(g), "h3": F.shiftrightunsigned(g, 32)}
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.withColumns(parts).select("conv", "key", "part", "n", F.col("total_one").alias("n_turns"), *parts, *(F.sum(k).over(upto).alias(f"s{k}") for k in parts))
    rolled, _ = staged(rolled, "rolling")
    drop_path(spark, ranged_at)
    ahead = _offsets(rolled, {f"o{k}": F.col(k) for k in parts}).select("key", "part", *(f"o{k}" for k in parts))
    prefix = rolled.join(ahead, ["key", "part"]).select("conv", "n", "n_turns", *((F.col(f"s{k}") + F.col(f"o{k}")).alias(k) for k in parts))
    longer = prefix.where("n < n_turns").select("n", *parts).distinct()
    whole = prefix.where("n = n_turns").groupBy("n", *parts).agg(F.min("conv").alias("first"), F.count("*").alias("n_equal"))
    return whole.join(longer, ["n", *parts], "left_anti").select("first", F.col("n").alias("n_turns"), "n_equal")


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation that remains: id, n_turns, n_equal (logged copies, itself included) and rendered text.

    Turns follow each other by turn, role and the text's MD5; rows that repeat all four columns count once. A null role
    renders as "unknown", a null text as an empty one, and both differ from any given value; a null id is a conversation
    of its own. An empty table gives no rows; other columns are ignored. The rendered text is as long as its conversation.
    """
    kept, _ = staged(collapse(turns, id_col, turn_col, role_col, text_col), "conversations")
    text = F.col(text_col)
    rows = turns.select(F.col(id_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), _mark(text).alias("mark"), text.isNull().alias("none"), text.alias("text")).alias("said"))
    own = rows.join(kept, F.col("conv").eqNullSafe(F.col("first")))
    whole = own.groupBy("conv", "n_turns", "n_equal").agg(F.array_sort(F.array_distinct(F.collect_list("said"))).alias("said"))
    body = F.array_join(F.transform("said", lambda x: render_turn(x["role"], x["text"])), "")
    return whole.select(F.col("conv").alias(id_col), F.col("n_turns").cast("long").alias("n_turns"), "n_equal", body.alias("text"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) AS place FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY place) AS seq,
      string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS text
      FROM s GROUP BY conv_id),
g AS (SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_equal, any_value(text) AS text, seq FROM c GROUP BY seq)
SELECT conv_id, n_turns, n_equal, text FROM g
WHERE NOT EXISTS (SELECT 1 FROM g AS b WHERE b.n_turns > g.n_turns AND b.seq[1] = g.seq[1] AND b.seq[1:g.n_turns] = g.seq)
"""
