"""Sharding by weighted rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import drop_path, running_before, staged


def draw(key: Column, number: Column, weight: Column) -> Column:
    """A shard's draw for a key with the shard's number: -ln(u) / weight, u uniform from the MD5 of key and number."""
    unit = (F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), number.cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.struct((-F.ln(unit) / weight).alias("draw"), number.cast("int").alias("shard"))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The least draw of all shards for a key, a struct of draw and shard.

    A draw depends on nothing but the key, the shard's number and its weight, so that a new shard takes rows only into
    itself, in proportion to its weight, and a removed one's rows alone move. Ties go to the smaller number.
    """
    share = F.array(*(F.lit(float(w)) for w in weights))
    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: draw(key, s, F.element_at(share, s + 1))))


def shard(docs: DataFrame, shards: int = 40, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size (UTF-8 bytes of the text and 16), text_crc32, law, shard, slot, grown_shard.

    law is always "key": id and shard count decide, and equal texts (the groups one could keep together) are dealt by their
    own ids, as text_crc32 shows. grown_shard is the shard with one more of mean weight. slot counts a
    shard's documents in the order of id, from 0 without gaps, by distributed prefix sums: no shard is ever in one task.
    Null texts count as empty ones. Null ids share the shard of the empty key; rows that repeat an id share a shard and
    get slots in the order of their checksum and size. An empty table gives no rows; other columns are ignored.
    """
    own = [1.0] * shards if weights is None else list(weights)
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.withColumns({"now": rendezvous(key, own), "new": draw(key, F.lit(len(own)), F.lit(sum(own) / len(own)))})
    rows = rows.select("doc_id", "size", "text_crc32", F.col("now.shard").alias("shard"), F.when(F.col("new.draw") < F.col("now.draw"), F.col("new.shard")).otherwise(F.col("now.shard")).alias("grown_shard"), F.lit(1).alias("one"))
    rows, draws_at = staged(rows, "draws")  # drawn once, though range partitioning reads its input twice
    placed, _ = running_before(rows, ["shard"], ["doc_id", "text_crc32", "size"], {"slot": "one"}, "shards")
    drop_path(docs.sparkSession, draws_at)
    return placed.select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
