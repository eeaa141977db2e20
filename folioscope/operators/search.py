"""Vector search, the bridge from pages to the graph, hybrid search and scope-based access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.constants import KG_SCORE, SCOPES
from folioscope.functions.vectors import scored


def vector_search(chunks: DataFrame, query: list[float], k: int = 5, scopes: list[str] | None = None) -> DataFrame:
    """The k chunks most similar to a query vector, ties by id; contents are fetched for these only.

    The k narrow rows come to the driver, so that their ids reach the second scan as a pushed filter and
    all other row groups of the contents are skipped.
    """
    rows = chunks if scopes is None else chunks.where(F.col("scope").isin(scopes))
    narrow = scored(rows, query, "embedding", ["id", "scope", "kind", "ref", "section"]).withColumn("score", F.round("score", 6))
    found = narrow.orderBy(F.desc("score"), "id").limit(k)
    best = found.collect()
    top = chunks.sparkSession.createDataFrame(best, found.schema)
    return rows.where(F.col("id").isin([r["id"] for r in best])).select("id", "content").join(F.broadcast(top), "id").select("id", "scope", "kind", "ref", "section", "score", "content")


def scopes_of_session(keys: DataFrame, patterns: DataFrame) -> DataFrame:
    """(session_key, scopes): the first pattern, by ordinal, that a key or its parent key contains; else public.

    ``patterns``: (ordinal, pattern, scopes array). A parent key ends before ``:active-memory:`` or ``:subagent:``.
    """
    parent = F.regexp_replace("session_key", r":(?:active-memory|subagent):.*$", "")
    tried = keys.select("session_key", F.posexplode(F.array_distinct(F.array("session_key", parent))).alias("attempt", "k"))
    met = tried.join(F.broadcast(patterns), F.contains("k", "pattern")).groupBy("session_key").agg(F.min_by("scopes", F.struct("attempt", "ordinal")).alias("scopes"))
    valid = F.filter(F.coalesce("scopes", F.array(F.lit("public"))), lambda s: s.isin(*SCOPES))
    return keys.select("session_key").distinct().join(met, "session_key", "left").select("session_key", valid.alias("scopes"))


def page_lines(documents: DataFrame, slug: str, scopes: list[str], first: int = 1, count: int = 200) -> DataFrame:
    """Lines of a page by slug, wiki before sources, within the allowed scopes."""
    found = documents.where(F.col("scope").isin(scopes) & F.element_at(F.split("ref", "/"), -1).eqNullSafe(slug) & F.lit(slug).rlike(r"^[a-z0-9\-]{1,100}$"))
    best = found.orderBy(F.when(F.col("kind") == "wiki", 0).otherwise(1), "doc_id").limit(1)
    lines = F.split("text", "\n")
    return best.select("doc_id", "ref", "kind", F.size(lines).alias("n_lines"), F.array_join(F.slice(lines, first, min(count, 5000)), "\n").alias("page"))


def bridge(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities of ranked pages (wiki_page, rank), in the order of the pages, then by id."""
    return F.broadcast(pages).join(entities, "wiki_page").select("rank", "wiki_page", "id", "label", "entity_type")


def hybrid_search(chunks: DataFrame, entities: DataFrame, relationships: DataFrame, query: list[float], scopes: list[str], most: int = 10) -> DataFrame:
    """Vector hits and entities of their pages in one list: a third for the graph, the rest for vectors.

    The vector side over-fetches, its first 8 distinct wiki pages lead to entities, of which those with a
    relation stay at a constant score.
    """
    fetched = min(30, max(12, 3 * most))
    hits = vector_search(chunks, query, fetched, scopes).select("id", "scope", "kind", "ref", "section", "score")
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # over at most 30 rows
    pages = ranked.where("kind = 'wiki'").groupBy(F.concat_ws("/", "scope", "ref").alias("wiki_page")).agg(F.min("rank").alias("rank")).orderBy("rank").limit(8)
    ends = relationships.where("valid_until IS NULL").select(F.explode(F.array("source_id", "target_id")).alias("id"))
    graph = bridge(pages, entities).join(ends, "id", "left_semi").orderBy("rank", "id")
    quota = max(1, most // 3)
    kg = graph.limit(quota).select(F.lit("graph").alias("origin"), F.col("id").alias("hit"), F.col("label").alias("title"), F.lit(KG_SCORE).alias("score"))
    n = kg.agg(F.count(F.lit(1)).alias("n"))
    vectors = ranked.crossJoin(F.broadcast(n)).where(F.col("rank") <= most - F.col("n")).select(F.lit("vector").alias("origin"), F.col("id").cast("string").alias("hit"), F.coalesce("section", "ref").alias("title"), "score")
    return kg.unionByName(vectors)


def query_vector(spark: SparkSession, rows: DataFrame, id_column: str, wanted: int) -> list[float]:
    """One stored vector as a query."""
    return [float(x) for x in rows.where(F.col(id_column) == wanted).select("embedding").first()[0]]
