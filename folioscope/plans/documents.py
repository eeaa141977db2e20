"""Queries over the document register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.registry import query
from folioscope.tables import table


@query("document_sources", "SELECT lower(trim(source)) AS source, count(*) AS n_documents, sum(n_chars)::BIGINT AS n_chars, count(DISTINCT ref) AS n_refs FROM documents GROUP BY 1", "A1 S1")
def document_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"), F.count_distinct("ref").alias("n_refs"))


@query("document_languages", "SELECT split_part(lower(trim(lang)), '-', 1) AS lang, count(*) AS n FROM documents GROUP BY 1", "A1")
def document_languages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.element_at(F.split(F.lower(F.trim("lang")), "-"), 1).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@query("redelivered_documents", "SELECT sha256(text) AS text_hash, count(*) AS n_copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1", "A6 K3")
def redelivered_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_id")).where("n_copies > 1")


@query("status_counts", "SELECT 'chunks' AS table_name, count(*) AS n_rows FROM chunks UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'relationships', count(*) FROM relationships UNION ALL SELECT 'entity_pages', count(*) FROM entity_pages UNION ALL SELECT 'graph_page_state', count(*) FROM graph_page_state UNION ALL SELECT 'documents', count(*) FROM documents", "H-1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("chunks", "entities", "relationships", "entity_pages", "graph_page_state", "documents"):
        part = table(spark, d, name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out
