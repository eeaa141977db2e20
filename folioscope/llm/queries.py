"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import covering, encoding, leakage, mixing, names, scans, similar_vectors, splitting, truncation
from folioscope.registry import query
from folioscope.tables import table


@query("p4_found", "SELECT id AS chunk_id FROM chunks WHERE length(content) > 1500", "problem 4")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks")).where("piece_idx = 0").select("chunk_id")


@query("p4_pieces", operators="problem 4")
def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"))


_P8 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ig AS (SELECT item_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


@query("p8_found", _P8, "problem 8")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p8_spans", operators="problem 8")
def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


_P5 = """
WITH w AS (SELECT id, list_distinct(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS w FROM chunks),
s AS (SELECT id, w, len(w) AS n FROM w WHERE len(w) >= 20),
x AS (SELECT id, n, unnest(w) AS word FROM s),
f AS (SELECT word, count(*) AS df FROM x GROUP BY word),
r AS (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY df, word) AS rn FROM x JOIN f USING (word)),
h AS (SELECT id, n, word FROM r WHERE rn <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM h a JOIN h b ON a.word = b.word AND a.id < b.id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n),
p AS (SELECT a, b, y.n + z.n AS n, len(list_intersect(y.w, z.w)) AS k FROM c JOIN s y ON y.id = a JOIN s z ON z.id = b)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM p WHERE 10 * k >= 8 * (n - k)
"""


@query("p5_found", _P5, "problem 5")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return covering.similar_pairs(table(spark, d, "chunks")).select(F.col("a_id").alias("chunk_id_a"), F.col("b_id").alias("chunk_id_b"))


@query("p1_found", operators="problem 1")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar_vectors.similar_pairs(table(spark, d, "chunks"))
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


@query("p1_neighbours", operators="problem 1")
def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar chunks of every chunk whose id is divisible by 100, against all chunks."""
    c = table(spark, d, "chunks")
    return similar_vectors.nearest_for_queries(c, c.where(F.col("id") % 100 == 0))


@query("p1_recall", operators="problem 1")
def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 of the operator behind ``p1_found``, without its limit of similarity, over all chunks whose id is divisible by 100."""
    c = table(spark, d, "chunks")
    queries = c.where(F.col("id") % 100 == 0)
    found = similar_vectors.nearest_neighbours(c).select(F.col("id").alias("query_id"), "similarity")
    return similar_vectors.recall(found, similar_vectors.exact_for_queries(c, queries), queries)


@query("p10_found", operators="problem 10")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).where("cut").select("doc_id").distinct()


@query("p10_rates", operators="problem 10")
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(table(spark, d, "documents"))


@query("p9_mix", operators="problem 9")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("p9_report", operators="problem 9")
def p9_report(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.report(mixing.mix(table(spark, d, "documents"), targets), targets)


@query("p6_found", operators="problem 6")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored_fields(table(spark, d, "chunks")).select(F.col("id").alias("chunk_id"), "field_name").distinct()


@query("p6_restored", operators="problem 6")
def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored_with_twins(table(spark, d, "chunks")).select(F.col("id").alias("chunk_id"), "field_name", "restored", "complete")


@query("p7_found", operators="problem 7")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(table(spark, d, "chunks")).select(F.col("id").alias("chunk_id"), "noise")


@query("p7_repaired", operators="problem 7")
def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "chunks")).select(F.col("id").alias("chunk_id"), "repaired")


@query("p3_found", operators="problem 3")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(table(spark, d, "entities")).select(F.col("a").alias("entity_id_a"), F.col("b").alias("entity_id_b"))
