"""Queries of vector search, hybrid search and access by scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import vectors as V
from folioscope.operators import search as S
from folioscope.registry import query
from folioscope.tables import chunks, entities, relationships, table

#: SQL of the deduplicated tables, shared by the twins.
CHUNKS = "c AS (SELECT * FROM chunks WHERE id IN (SELECT max(id) FROM chunks GROUP BY scope, kind, ref, chunk_idx))"
ENTITIES = "e AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY replace(updated_at, 'T', ' ') DESC) AS rn FROM entities) WHERE rn = 1)"
RELATIONS = "r AS (SELECT DISTINCT * FROM relationships)"
_QUERY = "q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id = 0)"
_COSINE = "list_dot_product(list_transform(coalesce(c.embedding, []), lambda x: coalesce(x::DOUBLE, 0)), q.v) / sqrt(list_dot_product(list_transform(coalesce(c.embedding, []), lambda x: coalesce(x::DOUBLE, 0)), list_transform(coalesce(c.embedding, []), lambda x: coalesce(x::DOUBLE, 0))) * list_dot_product(q.v, q.v))"
_SCORED = f"s AS (SELECT id, scope, kind, ref, section, content, CASE WHEN list_dot_product(list_transform(coalesce(c.embedding, []), lambda x: coalesce(x::DOUBLE, 0)), list_transform(coalesce(c.embedding, []), lambda x: coalesce(x::DOUBLE, 0))) > 0 THEN round({_COSINE}, 6) ELSE 0 END AS score FROM c, q WHERE len(c.embedding) = 64)"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return S.query_vector(spark, table(spark, d, "embeddings"), "vec_id", 0)


@query("vector_search_topk", f"WITH {CHUNKS}, {_QUERY}, {_SCORED} SELECT id, scope, kind, ref, section, score, content FROM s ORDER BY score DESC, id LIMIT 10", "G1 W4 S12 S13 X1")
def vector_search_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_search(chunks(spark, d), _query_vector(spark, d), 10)


@query("vector_search_scoped", f"WITH {CHUNKS}, {_QUERY}, {_SCORED} SELECT id, scope, kind, ref, section, score, content FROM s WHERE scope IN ('family', 'public') ORDER BY score DESC, id LIMIT 10", "G1 F1 F3 S12")
def vector_search_scoped(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_search(chunks(spark, d), _query_vector(spark, d), 10, ["family", "public"])


@query("chunk_stats", f"WITH {CHUNKS} SELECT scope, kind, count(*) AS n_chunks, count(DISTINCT ref) AS n_refs, count(embedding) AS n_embedded FROM c GROUP BY scope, kind", "A1")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("scope", "kind").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("ref").alias("n_refs"), F.count("embedding").alias("n_embedded"))


@query("doc_refs", f"WITH {CHUNKS} SELECT scope, kind, ref, count(*) AS n_chunks, max(chunk_idx)::INT AS last_idx FROM c GROUP BY ALL", "A1 A6")
def doc_refs(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("scope", "kind", "ref").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("chunk_idx").alias("last_idx"))


@query("normalized_vectors", "WITH v AS (SELECT id, list_transform(embedding, lambda x: coalesce(x::DOUBLE, 0)) AS e FROM chunks WHERE len(embedding) > 0), n AS (SELECT id, e, list_sum(list_transform(e, lambda x: x * x)) AS s FROM v) SELECT id, round(sqrt(s), 4) AS norm, round(e[1] / sqrt(s), 5) AS first_value FROM n WHERE s > 0", "X3 F17")
def normalized_vectors(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where((F.size("embedding") > 0) & (V.norm("embedding") > 0))
    return c.select("id", F.round(V.norm("embedding"), 4).alias("norm"), F.round(F.col("embedding")[0].cast("double") / V.norm("embedding"), 5).alias("first_value"))


@query("labelled_cosine", "SELECT a.label, round(avg(list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE))), 4) AS mean_score, count(*) AS n FROM embeddings a, embeddings q WHERE q.vec_id = 0 GROUP BY a.label", "X1 X2")
def labelled_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    s = V.scored(e, S.query_vector(spark, e, "vec_id", 0), "embedding", ["vec_id", "label"])
    return s.groupBy("label").agg(F.round(F.avg("score"), 4).alias("mean_score"), F.count(F.lit(1)).alias("n"))


_PAGES = f"top AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM s WHERE scope IN ('family', 'public') ORDER BY score DESC, id LIMIT 30)), pages AS (SELECT scope || '/' || ref AS wiki_page, min(rank) AS rank FROM top WHERE kind = 'wiki' GROUP BY 1 ORDER BY 2 LIMIT 8)"


@query("graph_pages_bridge", f"WITH {CHUNKS}, {_QUERY}, {_SCORED}, {ENTITIES}, {_PAGES} SELECT rank::INT AS rank, wiki_page, id, label, entity_type FROM pages JOIN e USING (wiki_page)", "G11 J12 U4")
def graph_pages_bridge(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    hits = S.vector_search(chunks(spark, d), _query_vector(spark, d), 30, ["family", "public"])
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    pages = ranked.where("kind = 'wiki'").groupBy(F.concat_ws("/", "scope", "ref").alias("wiki_page")).agg(F.min("rank").alias("rank")).orderBy("rank").limit(8)
    return S.bridge(pages, entities(spark, d))


_HYBRID = f"""WITH {CHUNKS}, {_QUERY}, {_SCORED}, {ENTITIES}, {RELATIONS}, {_PAGES},
ends AS (SELECT source_id AS id FROM r WHERE valid_until IS NULL UNION SELECT target_id FROM r WHERE valid_until IS NULL),
kg AS (SELECT 'graph' AS origin, id AS hit, label AS title, 0.45::DOUBLE AS score FROM pages JOIN e USING (wiki_page) WHERE id IN (FROM ends) ORDER BY rank, id LIMIT 3)
SELECT origin, hit, title, score FROM kg UNION ALL
SELECT 'vector', id::VARCHAR, coalesce(section, ref), score FROM top WHERE rank <= 10 - (SELECT count(*) FROM kg)"""


@query("hybrid_search", _HYBRID, "G12 U3 U4 J12 F18")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return S.hybrid_search(chunks(spark, d), entities(spark, d), relationships(spark, d), _query_vector(spark, d), ["family", "public"], 10)


_PATTERNS = [(0, "discord:direct:1", ["private", "family", "public"]), (1, "discord:", ["family", "public"]), (2, "cron:", ["public", "archive"])]
_KEYS = "k AS (SELECT DISTINCT 'agent:main:' || CASE o_custkey % 4 WHEN 0 THEN 'discord:direct:' WHEN 1 THEN 'discord:group:' WHEN 2 THEN 'cron:' ELSE 'web:' END || o_custkey || CASE o_custkey % 3 WHEN 0 THEN ':active-memory:x' WHEN 1 THEN ':subagent:y' ELSE '' END AS session_key FROM orders)"


@query("scope_resolution", f"WITH {_KEYS} SELECT session_key, CASE WHEN contains(session_key, 'discord:direct:1') THEN 'private,family,public' WHEN contains(session_key, 'discord:') THEN 'family,public' ELSE 'public' END AS scopes FROM k", "S15 S16")
def scope_resolution(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("discord:direct:"), F.lit("discord:group:"), F.lit("cron:"), F.lit("web:")), (F.col("o_custkey") % 4 + 1).cast("int"))
    tail = F.element_at(F.array(F.lit(":active-memory:x"), F.lit(":subagent:y"), F.lit("")), (F.col("o_custkey") % 3 + 1).cast("int"))
    keys = table(spark, d, "orders").select(F.concat(F.lit("agent:main:"), kind, F.col("o_custkey").cast("string"), tail).alias("session_key")).distinct()
    patterns = spark.createDataFrame(_PATTERNS, "ordinal int, pattern string, scopes array<string>")
    return S.scopes_of_session(keys, patterns).select("session_key", F.array_join("scopes", ",").alias("scopes"))


_SLUG = "(SELECT min(split_part(ref, '/', -1)) FROM documents WHERE kind = 'wiki' AND scope = 'public' AND regexp_matches(split_part(ref, '/', -1), '^[a-z0-9-]{1,100}$'))"


@query("page_slice", f"SELECT doc_id, ref, kind, len(string_split(text, chr(10)))::INT AS n_lines, array_to_string(list_slice(string_split(text, chr(10)), 2, 6), chr(10)) AS page FROM documents WHERE scope IN ('public') AND split_part(ref, '/', -1) = {_SLUG} ORDER BY CASE kind WHEN 'wiki' THEN 0 ELSE 1 END, doc_id LIMIT 1", "S17 S18")
def page_slice(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    slug = F.element_at(F.split("ref", "/"), -1)
    wanted = documents.where((F.col("kind") == "wiki") & (F.col("scope") == "public") & slug.rlike("^[a-z0-9-]{1,100}$")).agg(F.min(slug)).first()[0]
    return S.page_lines(documents, wanted, ["public"], 2, 5)


@query("search_snippets", f"WITH {CHUNKS} SELECT id, CASE WHEN section IS NULL OR section = '_preamble_' THEN ref ELSE ref || ' – ' || section END AS title, substr(regexp_replace(content, '\\s+', ' ', 'g'), 1, 300) AS snippet FROM c WHERE kind = 'wiki'", "T22")
def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).where("kind = 'wiki'")
    title = F.when(F.col("section").isNull() | (F.col("section") == "_preamble_"), F.col("ref")).otherwise(F.concat("ref", F.lit(" – "), "section"))
    return c.select("id", title.alias("title"), F.substring(F.regexp_replace("content", r"[\t\n\f\r ]+", " "), 1, 300).alias("snippet"))


@query("content_hash_state", "SELECT id, sha256(content) AS fresh_hash, CASE WHEN content_hash IS NULL OR content_hash = '' THEN 'missing' WHEN lower(content_hash) = sha256(content) THEN 'current' ELSE 'stale' END AS state FROM chunks", "X25 K1")
def content_hash_state(spark: SparkSession, d: str) -> DataFrame:
    fresh = F.sha2("content", 256)
    state = F.when(F.coalesce("content_hash", F.lit("")) == "", "missing").when(F.lower("content_hash") == fresh, "current").otherwise("stale")
    return table(spark, d, "chunks").select("id", fresh.alias("fresh_hash"), state.alias("state"))


@query("stable_ids", f"WITH {ENTITIES}, n AS (SELECT id, entity_type, regexp_replace(replace(replace(replace(replace(lower(trim(label)), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g') AS l FROM e) SELECT id, substr(sha256(entity_type || '::' || regexp_replace(regexp_replace(l, '[\\s_]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 12) AS stable_id FROM n", "X25")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("id", T.stable_entity_id("entity_type", "label").alias("stable_id"))


@query("relationship_ids", f"WITH {RELATIONS} SELECT id, substr(sha256(source_id || '::' || target_id || '::' || relation_type), 1, 16) AS triple_id FROM r", "X25")
def relationship_ids(spark: SparkSession, d: str) -> DataFrame:
    return relationships(spark, d).select("id", T.relationship_id("source_id", "target_id", "relation_type").alias("triple_id"))
