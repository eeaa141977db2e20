"""Problem 2: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.durable import shared_folder
from folioscope.operators import orphans as O
from folioscope.registry import query
from folioscope.streaming import operators as S
from folioscope.tables import iso_seconds, table


def reference_rows(spark: SparkSession, d: str) -> DataFrame:
    """All references of the model: both ends of a relationship and the page of an entity."""
    at = iso_seconds("created_at")
    r = table(spark, d, "relationships")
    ends = r.select(
        F.lit("relationships").alias("table_name"),
        F.explode(F.array(F.struct(F.lit("source_id").alias("f"), F.col("source_id").alias("k")), F.struct(F.lit("target_id").alias("f"), F.col("target_id").alias("k")))).alias("e"),
        F.col("id").alias("record_id"), F.substring("created_at", 1, 7).alias("period"), at.alias("at"),
    ).select("table_name", F.col("e.f").alias("field_name"), "record_id", "period", F.concat(F.lit("e:"), "e.k").alias("ref_key"), "at")
    pages = table(spark, d, "entities").select(
        F.lit("entities").alias("table_name"), F.lit("wiki_page").alias("field_name"), F.col("id").alias("record_id"),
        F.substring("created_at", 1, 7).alias("period"), F.concat(F.lit("p:"), "wiki_page").alias("ref_key"), at.alias("at"),
    )
    return ends.unionByName(pages)


def parent_rows(spark: SparkSession, d: str) -> DataFrame:
    """Life spans of the keys and when they become known: a record arrives when it is born and is deleted by a later row.

    A page that is in the register counts at any time, from when it is registered.
    """
    e = table(spark, d, "entities").select(F.concat(F.lit("e:"), "id").alias("ref_key"), F.concat_ws("/", F.lit("v"), "created_at", "valid_until").alias("version"), iso_seconds("created_at").alias("born"), iso_seconds("valid_until").alias("gone"))
    none = F.lit(None).cast("string")
    arrivals = e.select("ref_key", "version", "born", none.alias("gone"), F.col("born").alias("known"))
    deletions = e.where(F.col("gone").isNotNull()).select("ref_key", "version", "born", "gone", F.col("gone").alias("known"))
    pages = table(spark, d, "graph_page_state").select(F.concat(F.lit("p:"), "wiki_page").alias("ref_key"), F.lit("v").alias("version"), none.alias("born"), none.alias("gone"), iso_seconds("processed_at").alias("known"))
    return arrivals.unionByName(deletions).unionByName(pages)


def batches_in_time(references: DataFrame, parents: DataFrame, number: int = 3) -> list[tuple[DataFrame, DataFrame]]:
    """Batches as they would have come: references by their own time, parents and deletions by when they became known."""
    seconds = F.unix_timestamp(F.to_timestamp("at"))
    first, last = references.agg(F.min(seconds), F.max(seconds)).first()
    if first is None:
        return [(references, parents)]
    cuts = [F.date_format(F.timestamp_seconds(F.lit(first + (last - first) * i // number)), "yyyy-MM-dd HH:mm:ss") for i in range(1, number)]

    def part(column: str) -> Column:
        return F.coalesce(sum((F.col(column) > c).cast("int") for c in cuts), F.lit(0))

    return [(references.where(part("at") == i), parents.where(part("known") == i)) for i in range(number)]


def state_of(spark: SparkSession, d: str) -> O.OrphanStore:
    """The state after all batches, each brought forward from the one before."""
    store = O.OrphanStore(spark, shared_folder(spark, "orphans"))
    for references, parents in batches_in_time(reference_rows(spark, d), parent_rows(spark, d)):
        store = O.advance(store, references, parents)
    return store


_CASES = """
WITH refs AS (
  SELECT 'relationships' AS table_name, 'source_id' AS field_name, id AS record_id, created_at, source_id AS k FROM relationships
  UNION ALL SELECT 'relationships', 'target_id', id, created_at, target_id FROM relationships),
cases AS (
  SELECT table_name, field_name, record_id, substr(created_at, 1, 7) AS period FROM refs r
  WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.id = r.k AND replace(e.created_at, 'T', ' ') <= replace(r.created_at, 'T', ' ')
        AND (e.valid_until IS NULL OR replace(e.valid_until, 'T', ' ') > replace(r.created_at, 'T', ' ')))
  UNION
  SELECT 'entities', 'wiki_page', id, substr(created_at, 1, 7) FROM entities e
  WHERE wiki_page IS NOT NULL AND NOT EXISTS (SELECT 1 FROM graph_page_state g WHERE g.wiki_page = e.wiki_page))
"""


_FOUND = _CASES + "SELECT DISTINCT table_name, field_name, record_id, period FROM cases"


@query("p2_found", _FOUND, "problem 2")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphans after three batches in time, in which parents arrive late and are deleted."""
    return O.orphans(state_of(spark, d))


@query("p2_report", _CASES + "SELECT table_name, field_name, period, count(DISTINCT record_id) AS n_orphans FROM cases GROUP BY ALL", "problem 2")
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return O.snapshot(state_of(spark, d)).where("n_orphans > 0").select("table_name", "field_name", "period", "n_orphans")


@query("p2_incremental", _FOUND, "problem 2")
def p2_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same cases, reached with half of the parents known only after their references."""
    references, parents = reference_rows(spark, d), parent_rows(spark, d)
    late = F.pmod(F.xxhash64("ref_key"), F.lit(2)) == 1
    store = O.advance(O.OrphanStore(spark, shared_folder(spark, "orphans")), references.where(~late), parents.where(late))
    return O.orphans(O.advance(store, references.where(late), parents.where(~late)))


@query("p2_stream", _FOUND, "problem 2")
def p2_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same cases from a stream of changes in which references, arrivals and deletions come together."""
    folder, target = shared_folder(spark, "changes"), shared_folder(spark, "orphans")
    for references, parents in batches_in_time(reference_rows(spark, d), parent_rows(spark, d)):
        S.changes(references, parents).coalesce(1).write.mode("append").parquet(folder)
    last: list[int] = []
    S.run_available(S.stream_of(spark, folder, S.CHANGE, 1), shared_folder(spark, "checkpoint"), S.pending_orphans(target, last))
    return O.orphans(O.load(spark, target, last[-1]))
