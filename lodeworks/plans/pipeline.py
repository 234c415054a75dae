"""The ingest pipeline from end to end, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions import chunking, html, quality, text
from lodeworks.operators import vectors
from lodeworks.plans.text import CHUNK_SIMPLE_SQL, SCORED_SQL
from lodeworks.sources import spread, table


def chunk_quality(docs: DataFrame) -> DataFrame:
    """Documents to simple chunks with sub-scores, without a shuffle."""
    rows = text.unnested(docs, chunking.simple(F.col("text")), "chunk_index", "chunk").select("doc_id", "chunk_index", "chunk")
    return quality.measured(rows, "chunk", F.lit("en"))


def flagship(spark, sf_dir) -> DataFrame:
    """Documents, chunked and scored: passed chunks and mean scores by length class."""
    rows = chunk_quality(spread(table(spark, sf_dir, "documents")))
    score = quality.overall(F.col("length_score"), F.col("language_score"), F.col("readability_score"), F.col("completeness_score"), F.lit(1.0))
    rows = rows.withColumns({"score": score, "size": F.floor(F.length("chunk") / 100).cast("int")})
    return rows.groupBy("size").agg(F.count("*").alias("chunks"), F.count_if(F.col("score") >= 0.6).alias("passed"), F.round(F.avg("score"), 6).alias("avg_score"))


def chunk_sizes(spark, sf_dir) -> DataFrame:
    rows = text.unnested(spread(table(spark, sf_dir, "documents")), chunking.simple(F.col("text")), "place", "chunk")
    return rows.groupBy(F.floor(F.length("chunk") / 100).cast("int").alias("size")).agg(F.count("*").alias("chunks"))


CHUNK_SIZES_SQL = CHUNK_SIMPLE_SQL.replace("SELECT doc_id, (row_number()", ", c AS (SELECT doc_id, (row_number()", 1).rstrip() + ") SELECT floor(length(chunk) / 100)::INT AS size, count(*) AS chunks FROM c GROUP BY size"


#: The chunks as a table of texts, and the scoring of texts over it.
FLAGSHIP_SQL = (
    CHUNK_SIMPLE_SQL.replace("SELECT doc_id, (row_number()", ", c AS (SELECT doc_id, (row_number()", 1).rstrip()
    + "), ct AS (SELECT doc_id, chunk AS text, 'en' AS lang FROM c), "
    + SCORED_SQL.strip().removeprefix("WITH ").replace("FROM documents", "FROM ct").replace("s AS (SELECT doc_id, first,", "sc AS (SELECT doc_id, length(text) AS text_length, first,").replace("FROM s)", "FROM sc)")
    + ", z AS (SELECT text_length, length_score * 0.2::DOUBLE + language_score * 0.15::DOUBLE + readability_score * 0.25::DOUBLE + completeness_score * 0.2::DOUBLE + 0.2::DOUBLE AS score FROM q)"
    + " SELECT floor(text_length / 100)::INT AS size, count(*) AS chunks, count_if(score >= 0.6)::BIGINT AS passed, round(avg(score), 6) AS avg_score FROM z GROUP BY size"
)


def ingest(pages: DataFrame, size: int = 64, threshold: float = 0.6) -> DataFrame:
    """Pages to vectors in one plan: extraction, chunks, quality, first of equal chunks, embedding.

    With this threshold a chunk passes exactly if nothing but harmless issues is found.
    """
    content = html.pages_to_content(pages).select("page_id", "url", F.col("clean_text").alias("text"))
    chunks = chunking.chunk_pages(content, sizes=chunking.Sizes(1000, 100, 100))
    scored = quality.measured(chunks, "clean_text", F.lit("en"))
    # Another language or a copy harms nobody.
    kept = scored.drop("content_hash").where(~F.exists("issues", lambda i: ~i.startswith("non_english_content"))).withColumn("seq", F.struct("page_id", "chunk_index"))
    fresh = vectors.new_rows(kept, None, "clean_text")
    c = F.col("clean_text")
    return fresh.select("chunk_id", "url", "chunk_index", c, "content_hash", text.record_id(c, F.concat_ws("_", "page_id", "chunk_index")).alias("record_id"), vectors.embed(c, size).alias("embedding"))


def ingest_pages(spark, sf_dir) -> DataFrame:
    return ingest(spread(table(spark, sf_dir, "pages"))).select("chunk_id", "chunk_index", "content_hash", "record_id", F.size("embedding").alias("size"))


QUERIES = {"flagship": flagship, "chunk_sizes": chunk_sizes, "ingest_pages": ingest_pages}

ORACLES = {"flagship": FLAGSHIP_SQL, "chunk_sizes": CHUNK_SIZES_SQL}
