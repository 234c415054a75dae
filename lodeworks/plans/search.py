"""Queries of vectors, duplicates, chat and sessions; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import quality, text
from lodeworks.operators import chat, dedup, latent, store, vector_index, vectors
from lodeworks.operators.crawl import scratch, written
from lodeworks.plans.text import WS, _any, strip_sql
from lodeworks.sources import spread, table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _query(spark, sf_dir) -> list[float]:
    """The vector with id 0 as the query."""
    return list(_vectors(spark, sf_dir).where("id = 0").first()["embedding"])


def _topk(metric: str, **more):
    def run(spark, sf_dir):
        return vectors.search(_vectors(spark, sf_dir), _query(spark, sf_dir), 10, metric=metric, **more).select("id", F.round("score", 6).alias("score"))

    return run


_D = {
    "cosine": "list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))",
    "dot": "list_dot_product(v, q)",
    "euclid": "list_distance(v, q)",
    "manhattan": "list_sum(list_transform(generate_series(1, len(v)), lambda i: abs(v[i] - q[i])))",
}
_V = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS id, label, {d} AS score FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q)\n"


def _topk_sql(metric: str, where: str = "") -> str:
    order = "score" if vectors.ascending(metric) else "score DESC"
    return _V.replace("{d}", _D[metric]) + f"SELECT id, round(score, 6) AS score FROM s {where} ORDER BY {order}, id LIMIT 10"


def vec_batch_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    queries = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.batch_search(v, queries, 5).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


VEC_BATCH_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_dot_product(a.v, b.v) / (a.n * b.n) AS score FROM e a, e b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 5
"""


def vec_index_topk(spark, sf_dir):
    """The same queries through an index that is built over all vectors first; held against exact search in the tests."""
    v = _vectors(spark, sf_dir)
    queries = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return vector_index.build(v, scratch(spark, "vector-index"), 64).search(queries, 10).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def versioned_load(spark, sf_dir):
    """Loads of documents into a store: those in English, all, all once more, and the turns of conversations."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text", "lang")
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text", F.lit("").alias("lang"))
    return store.Store(spark, scratch(spark, "store")).load_all([docs.where("lang = 'en'"), docs, docs, turns])


VERSIONED_LOAD_SQL = """
WITH b AS (SELECT 0 AS batch, text FROM documents WHERE lang = 'en' UNION ALL SELECT unnest([1, 2]), text FROM documents UNION ALL SELECT 3, text FROM conversations),
f AS (SELECT text, min(batch) AS batch FROM b WHERE text IS NOT NULL GROUP BY text),
n AS (SELECT batch, count(*) AS total FROM b GROUP BY batch), u AS (SELECT batch, count(*) AS uploaded FROM f GROUP BY batch),
r AS (SELECT batch, total, coalesce(uploaded, 0) AS uploaded FROM n LEFT JOIN u USING (batch))
SELECT batch::INT AS batch, total, uploaded, (sum(uploaded) OVER (ORDER BY batch))::BIGINT AS in_collection, (count_if(uploaded > 0) OVER (ORDER BY batch))::BIGINT AS version, NULL::VARCHAR AS failure FROM r
"""


def _hits(spark, sf_dir) -> DataFrame:
    """Search results of some queries, dressed as chunks with text, address and sizes by id."""
    rows = vec_batch_topk(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("services/a", "about", "blog/x", "other"))), (F.col("id") % 4 + 1).cast("int"))
    return rows.withColumns({"source_url": F.concat(F.lit("https://example.com/"), kind), "word_count": (F.col("id") % 100).cast("int"), "sentence_count": (F.col("id") % 6).cast("int"), "text": F.concat(F.lit("text "), (F.col("id") % 7).cast("string"))})


_HITS_SQL = (
    VEC_BATCH_SQL.replace("SELECT query_id, rank::INT", ", h AS (SELECT query_id, rank::INT").rstrip()
    + """),
h2 AS (SELECT *, 'https://example.com/' || ['services/a', 'about', 'blog/x', 'other'][id % 4 + 1] AS source_url, (id % 100)::INT AS word_count, (id % 6)::INT AS sentence_count, 'text ' || id % 7 AS text FROM h)
"""
)


def vec_boost_rerank(spark, sf_dir):
    return vectors.boost(_hits(spark, sf_dir)).select("query_id", "id", F.round("boosted", 6).alias("boosted"), "new_rank")


VEC_BOOST_SQL = (
    _HITS_SQL
    + """, b AS (SELECT query_id, id, rank, score * (CASE WHEN word_count > 50 THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN sentence_count > 3 THEN 1.05::DOUBLE ELSE 1 END
  * CASE WHEN contains(source_url, 'service') THEN 1.15::DOUBLE WHEN contains(source_url, 'about') THEN 1.1::DOUBLE WHEN contains(source_url, 'blog') THEN 1.05::DOUBLE ELSE 1 END) AS boosted FROM h2)
SELECT query_id, id, round(boosted, 6) AS boosted, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rank)::INT AS new_rank FROM b"""
)


def vec_result_dedup(spark, sf_dir):
    return vectors.distinct_results(_hits(spark, sf_dir)).select("query_id", "rank", "id", "text")


VEC_RESULT_DEDUP_SQL = _HITS_SQL + "SELECT query_id, rank, id, text FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY rank) AS k FROM h2) WHERE k = 1"


def vec_filtered_count(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return vectors.filtered_count(rows, [F.col("label") == 1, F.col("label") == 3, F.col("id") == 7], F.col("label") == 2)


VEC_FILTERED_COUNT_SQL = "SELECT count_if(label = 1 OR label = 3 OR vec_id = 7)::BIGINT AS direct, count_if(label = 2)::BIGINT AS held, count(*) AS total, count_if(label IN (1, 2, 3) OR vec_id = 7) > 0 AS exists FROM embeddings"


def vec_validation(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return vectors.validate_load(v, v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")))


VEC_VALIDATION_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
a AS (SELECT p.vec_id, max(list_dot_product(p.v, e.v) / nullif(p.n * e.n, 0)) AS best FROM e p, e WHERE p.vec_id % 20 = 0 GROUP BY p.vec_id)
SELECT (SELECT count(*) FROM e) AS vectors, (SELECT count(*) FROM e WHERE vec_id % 20 = 0) AS probes, count(best) AS answered, count(best) = (SELECT count(*) FROM e WHERE vec_id % 20 = 0) AND (SELECT count(*) FROM e) > 0 AS valid FROM a
"""


def vec_health(spark, sf_dir):
    return vectors.health(_vectors(spark, sf_dir), 64)


VEC_HEALTH_SQL = "SELECT count(*) AS vectors, count_if(len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL), true))::BIGINT AS usable, CASE WHEN usable = 0 THEN 'unhealthy' WHEN usable < vectors THEN 'degraded' ELSE 'healthy' END AS status FROM embeddings"


def vec_info(spark, sf_dir):
    return vectors.info(_vectors(spark, sf_dir))


VEC_INFO_SQL = "SELECT count(*) AS vectors_count, max(len(embedding))::INT AS vector_size, count_if(embedding IS NULL)::BIGINT AS without_vector, CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'empty' END AS status FROM embeddings"


def embed_search(spark, sf_dir):
    """Documents and a few queries through the same embedder; the best documents of each query."""
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), vectors.embed(F.col("text"), 64).alias("embedding"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), vectors.embed(F.col("text"), 64).alias("query"))
    return vectors.batch_search(docs, asked, 3).select("query_id", "rank", "id", F.round("score", 5).alias("score"))


def embed_latent(spark, sf_dir):
    """The same search with an embedder that is fitted on all documents; held against a dense decomposition in the tests."""
    docs = written(spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), latent.counted(F.col("text")).alias("features")), "features")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), latent.counted(F.col("text")).alias("features"))
    sent = spark.sparkContext.broadcast(latent.fit(docs))
    docs = docs.select("id", latent.embed(F.col("features"), sent.value, sent).alias("embedding"))
    return vectors.batch_search(docs, asked.select("query_id", latent.embed(F.col("features"), sent.value, sent).alias("query")), 3).select("query_id", "rank", "id", F.round("score", 5).alias("score"))


def ingest_dedup(spark, sf_dir):
    """Documents that are new to a collection that holds the benchmark's texts, and new in the batch."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")
    held = table(spark, sf_dir, "benchmark").select(text.raw_hash(F.col("text")).alias("content_hash"))
    return vectors.new_rows(docs, held).select(F.col("seq").alias("doc_id"), "content_hash")


INGEST_DEDUP_SQL = """
WITH d AS (SELECT doc_id, md5(text) AS content_hash FROM documents)
SELECT min(doc_id) AS doc_id, content_hash FROM d WHERE content_hash NOT IN (SELECT md5(text) FROM benchmark WHERE text IS NOT NULL) GROUP BY content_hash
"""


def _chunks(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("seq"), "text")


def exact_dedup(spark, sf_dir):
    return dedup.exact_distinct(_chunks(spark, sf_dir)).select(F.col("seq").alias("doc_id"))


_NORMAL = f"md5(regexp_replace({strip_sql('lower(text)')}, '{WS}+', ' ', 'g'))"
EXACT_DEDUP_SQL = f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_NORMAL}"


def exact_pairs(spark, sf_dir):
    return dedup.exact_pairs(_chunks(spark, sf_dir))


EXACT_PAIRS_SQL = f"WITH d AS (SELECT doc_id, {_NORMAL} AS h FROM documents) SELECT * FROM (SELECT min(doc_id) OVER (PARTITION BY h) AS first, doc_id AS again FROM d) WHERE again > first"


def near_dup_pairs(spark, sf_dir):
    return dedup.all_pairs(_chunks(spark, sf_dir)).select("first", "again", F.round("similarity", 6).alias("similarity"), "kind")


def near_dup_removed(spark, sf_dir):
    rows = _chunks(spark, sf_dir)
    return dedup.remove(rows, dedup.all_pairs(rows)).select("seq")


def _turns(spark, sf_dir) -> DataFrame:
    """Conversation turns as short chunks, keyed and ordered by conversation and turn; no two turns share a key."""
    return table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("seq"), "text")


def near_dup_turn_pairs(spark, sf_dir):
    pairs = dedup.all_pairs(_turns(spark, sf_dir))
    return pairs.select(F.col("first.conv_id").alias("first_conv"), F.col("first.turn").alias("first_turn"), F.col("again.conv_id").alias("again_conv"), F.col("again.turn").alias("again_turn"), F.round("similarity", 6).alias("similarity"), "kind")


def near_dup_turns_removed(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    return dedup.remove(rows, dedup.all_pairs(rows)).select("seq.conv_id", "seq.turn")


def duplicate_map(spark, sf_dir):
    return dedup.duplicate_map(exact_pairs(spark, sf_dir).withColumns({"similarity": F.lit(1.0), "kind": F.lit("exact")})).select(F.col("keep"), F.array_join(F.transform("duplicates", lambda d: d["again"].cast("string")), ",").alias("again"))


DUPLICATE_MAP_SQL = "WITH p AS (" + EXACT_PAIRS_SQL + ") SELECT first AS keep, string_agg(again::VARCHAR, ',' ORDER BY again) AS again FROM p GROUP BY first"


def duplicate_map_all(spark, sf_dir):
    """Each first document with its exact and near copies."""
    return dedup.duplicate_map(dedup.all_pairs(_chunks(spark, sf_dir))).select("keep", F.array_join(F.transform("duplicates", lambda d: F.concat_ws(":", d["again"].cast("string"), d["kind"])), ",").alias("again"))


# Chat: the users' turns as queries, with a few words in front that meet every class.
LEADS = ("", "What services do you offer? ", "Show me your portfolio ", "Tell me about your team ", "How to contact you ", "best practices for software ", "sql injection ", "javascript: ", "is it raining ", "ok ")


def _asked(spark, sf_dir) -> DataFrame:
    """Every user turn's own text behind its lead."""
    lead = F.element_at(F.array(*map(F.lit, LEADS)), ((F.col("conv_id") + F.col("turn")) % len(LEADS) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(lead, "text").alias("query"))


_leads = "[" + ", ".join("'" + x + "'" for x in LEADS) + "]"
ASKED_SQL = f"WITH a AS (SELECT conv_id, turn, {_leads}[(conv_id + turn) % {len(LEADS)} + 1] || text AS query FROM conversations WHERE role = 'user')\n"


def query_validate(spark, sf_dir):
    return _asked(spark, sf_dir).select("conv_id", "turn", chat.query_error(F.col("query")).alias("error"))


_harm = " OR ".join(f"regexp_matches(lower(query), '{p}')" for p in chat.HARMFUL)
QUERY_VALIDATE_SQL = (
    ASKED_SQL
    + f"""SELECT conv_id, turn, CASE WHEN {strip_sql('query')} = '' THEN 'Query cannot be empty' WHEN length(query) > 500 THEN 'Query too long. Maximum 500 characters allowed.'
  WHEN length({strip_sql('query')}) < 3 THEN 'Query too short. Please provide more details.' WHEN {_harm} THEN 'Query contains potentially harmful content' END AS error FROM a"""
)


def query_preprocess(spark, sf_dir):
    return _asked(spark, sf_dir).select("conv_id", "turn", chat.preprocess(F.col("query")).alias("processed"))


QUERY_PREPROCESS_SQL = ASKED_SQL + f"SELECT conv_id, turn, lower(regexp_replace(regexp_replace({strip_sql('query')}, '{WS}+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_ .?!,:-]', '', 'g')) AS processed FROM a"


def query_intent(spark, sf_dir):
    return _asked(spark, sf_dir).select("conv_id", "turn", chat.intent(F.col("query")).alias("i")).select("conv_id", "turn", "i.*")


_classes = "".join(f"WHEN {_any('l', keys)} THEN '{name}' " for name, keys in chat.INTENTS)
QUERY_INTENT_SQL = (
    ASKED_SQL
    + f""", l AS (SELECT *, lower(query) AS l FROM a), m AS (SELECT *, {_any('l', chat.MENTIONS)} AS mention, {_any('l', chat.GENERAL)} AS general, {_any('l', chat.TECHNICAL)} AS technical,
  CASE {_classes} END AS named FROM l),
c AS (SELECT *, CASE WHEN named IS NOT NULL THEN named WHEN mention OR (general AND technical) THEN 'general' WHEN technical THEN 'services' ELSE 'off_topic' END AS category FROM m)
SELECT conv_id, turn, category, (CASE WHEN named = 'contact' THEN 0.9 WHEN named IS NOT NULL AND mention THEN 0.85 WHEN named IS NOT NULL THEN 0.75 WHEN mention THEN 0.8
  WHEN general AND technical THEN 0.65 WHEN technical THEN 0.7 ELSE 0.8 END)::DOUBLE AS confidence, category <> 'off_topic' AS is_relevant FROM c"""
)


def query_process(spark, sf_dir):
    rows = chat.process(_asked(spark, sf_dir))
    return rows.select("conv_id", "turn", "error", F.col("intent.category").alias("category"), chat.confidence_level(F.col("intent.confidence")).alias("level"), F.array_join(chat.follow_ups(F.col("intent.category")), "|").alias("follow_ups"))


def _knowledge(spark, sf_dir) -> DataFrame:
    """Documents as the chunks of a collection."""
    c = F.col("text")
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), vectors.embed(c, 64).alias("embedding"), "text", F.concat(F.lit("https://example.com/"), "source").alias("source_url"), text.word_count(c).alias("word_count"), F.size(text.sentences(c)).alias("sentence_count"))


def chat_batch(spark, sf_dir):
    """All user turns through the whole service, with the documents as its knowledge."""
    asked = _asked(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), "query")
    told = chat.respond(asked, _knowledge(spark, sf_dir), lambda c: vectors.embed(c, 64))
    return told.select("query_id", "error", "category", "answer", "n_results", F.round("confidence", 5).alias("confidence"), "level", F.array_join("follow_ups", "|").alias("follow_ups"))


def session_counts(spark, sf_dir):
    return chat.session_counts(table(spark, sf_dir, "conversations"))


SESSION_COUNTS_SQL = "SELECT conv_id, count(*) AS messages, count_if(role = 'user')::BIGINT AS query_count FROM conversations GROUP BY conv_id"


def session_context(spark, sf_dir):
    return chat.session_context(table(spark, sf_dir, "conversations"))


SESSION_CONTEXT_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Human: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS context FROM r WHERE k <= 5 GROUP BY conv_id
"""


def session_running(spark, sf_dir):
    return chat.running_queries(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "queries_so_far")


SESSION_RUNNING_SQL = "SELECT conv_id, turn, count_if(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS queries_so_far FROM conversations"


def _questions(spark, sf_dir) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, LEADS)), (F.col("query_id") % len(LEADS) + 1).cast("int"))
    return _hits(spark, sf_dir).select("query_id").distinct().withColumn("query", F.concat(lead, F.lit("please")))


def answer_template(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    rows = chat.answers(_questions(spark, sf_dir), hits)
    return rows.select("query_id", "answer", "n_results", F.round(chat.confidence(F.col("top"), F.col("n_results"), F.lit(0.75)), 5).alias("confidence"))


_intros = "".join(f"WHEN {_any('lower(query)', keys)} THEN '{said.replace(chr(39), chr(39) * 2)}' " for said, keys in chat.INTROS)
ANSWER_TEMPLATE_SQL = (
    _HITS_SQL
    + f""", g AS (SELECT query_id, max(score) AS top, count(*) AS n, list(text ORDER BY rank) AS texts, list(source_url ORDER BY rank) AS urls FROM h2 GROUP BY query_id),
u AS (SELECT query_id, string_agg(url, ', ' ORDER BY k) AS sources FROM (SELECT query_id, url, k, row_number() OVER (PARTITION BY query_id ORDER BY k) AS j FROM
  (SELECT query_id, url, min(k) AS k FROM (SELECT query_id, unnest(urls[1:3]) AS url, generate_subscripts(urls[1:3], 1) AS k FROM g) GROUP BY ALL)) WHERE j <= 2 GROUP BY query_id),
a AS (SELECT g.*, sources, {_leads}[query_id % {len(LEADS)} + 1] || 'please' AS query FROM g JOIN u USING (query_id))
SELECT query_id, (CASE {_intros} ELSE 'Based on the information I have:' END) || chr(10) || chr(10) || array_to_string(texts[1:2], ' ') || chr(10) || chr(10) || 'For more information, you can visit: ' || sources AS answer,
  n AS n_results, round(least(1, greatest(0, top * 0.6::DOUBLE + least(n / 3.0::DOUBLE, 1) * 0.2::DOUBLE + 0.75::DOUBLE * 0.2::DOUBLE)), 5) AS confidence FROM a"""
)


def context_prompt(spark, sf_dir):
    return chat.context_prompt(_hits(spark, sf_dir))


CONTEXT_PROMPT_SQL = _HITS_SQL + "SELECT query_id, string_agg('Context ' || rank || ':' || chr(10) || text || chr(10) || 'Source: ' || source_url || chr(10), chr(10) ORDER BY rank) AS context FROM h2 WHERE rank <= 5 GROUP BY query_id"


def answer_quality(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", quality.answer_quality(F.col("text"), 500).alias("q"))
    return q.select("conv_id", "turn", F.round("q.score", 6).alias("score"), "q.is_valid", F.array_join("q.issues", "; ").alias("issues"))


_hedge = " + ".join("contains(lower(text), '{}')::INT".format(h.replace("'", "''")) for h in quality.HEDGES)
ANSWER_QUALITY_SQL = f"""
WITH t AS (SELECT conv_id, turn, length(text) < 10 AS a, length(text) > 500 AS b, ({_hedge}) > 2 AS c, NOT {_any('lower(text)', quality.RELEVANT)} AS d FROM conversations),
s AS (SELECT *, 0.8::DOUBLE - CASE WHEN a THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN b THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN c THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN d THEN 0.3::DOUBLE ELSE 0 END AS score FROM t)
SELECT conv_id, turn, round(score, 6) AS score, score > 0.3 AS is_valid, array_to_string(list_filter([CASE WHEN a THEN 'Response too short' END, CASE WHEN b THEN 'Response too long' END,
  CASE WHEN c THEN 'Too many uncertain phrases' END, CASE WHEN d THEN 'No company context in response' END], lambda x: x IS NOT NULL), '; ') AS issues FROM s
"""

QUERIES = {f"vec_topk_{m}": _topk(m) for m in _D} | {
    "vec_threshold_filter": _topk("cosine", threshold=0.1, must={"label": 1}),
    "vec_batch_topk": vec_batch_topk,
    "vec_boost_rerank": vec_boost_rerank,
    "vec_result_dedup": vec_result_dedup,
    "vec_filtered_count": vec_filtered_count,
    "vec_info": vec_info,
    "embed_search": embed_search,
    "embed_latent": embed_latent,
    "ingest_dedup": ingest_dedup,
    "exact_dedup": exact_dedup,
    "vec_index_topk": vec_index_topk,
    "versioned_load": versioned_load,
    "exact_pairs": exact_pairs,
    "near_dup_pairs": near_dup_pairs,
    "near_dup_removed": near_dup_removed,
    "near_dup_turn_pairs": near_dup_turn_pairs,
    "near_dup_turns_removed": near_dup_turns_removed,
    "duplicate_map": duplicate_map,
    "duplicate_map_all": duplicate_map_all,
    "query_validate": query_validate,
    "query_preprocess": query_preprocess,
    "query_intent": query_intent,
    "query_process": query_process,
    "chat_batch": chat_batch,
    "vec_validation": vec_validation,
    "vec_health": vec_health,
    "session_counts": session_counts,
    "session_context": session_context,
    "session_running": session_running,
    "answer_template": answer_template,
    "context_prompt": context_prompt,
    "answer_quality": answer_quality,
}

ORACLES = {f"vec_topk_{m}": _topk_sql(m) for m in _D} | {
    "vec_threshold_filter": _topk_sql("cosine", "WHERE label = 1 AND score >= 0.1"),
    "vec_batch_topk": VEC_BATCH_SQL,
    "vec_boost_rerank": VEC_BOOST_SQL,
    "vec_result_dedup": VEC_RESULT_DEDUP_SQL,
    "vec_filtered_count": VEC_FILTERED_COUNT_SQL,
    "vec_info": VEC_INFO_SQL,
    "vec_validation": VEC_VALIDATION_SQL,
    "vec_health": VEC_HEALTH_SQL,
    "ingest_dedup": INGEST_DEDUP_SQL,
    "exact_dedup": EXACT_DEDUP_SQL,
    "versioned_load": VERSIONED_LOAD_SQL,
    "exact_pairs": EXACT_PAIRS_SQL,
    "duplicate_map": DUPLICATE_MAP_SQL,
    "query_validate": QUERY_VALIDATE_SQL,
    "query_preprocess": QUERY_PREPROCESS_SQL,
    "query_intent": QUERY_INTENT_SQL,
    "session_counts": SESSION_COUNTS_SQL,
    "session_context": SESSION_CONTEXT_SQL,
    "session_running": SESSION_RUNNING_SQL,
    "answer_template": ANSWER_TEMPLATE_SQL,
    "context_prompt": CONTEXT_PROMPT_SQL,
    "answer_quality": ANSWER_QUALITY_SQL,
}
