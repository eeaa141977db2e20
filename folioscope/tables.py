"""Reading the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table; Catalyst prunes columns and pushes filters into the Parquet scan."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def iso_seconds(column: str | Column) -> Column:
    """ISO text with a blank or a ``T`` in the middle, made comparable as text: ``YYYY-MM-DD hh:mm:ss``."""
    c = F.col(column) if isinstance(column, str) else column
    return F.translate(c, "T", " ")


def entities(spark: SparkSession, directory: str) -> DataFrame:
    """Entities once per id: of re-delivered rows, the one updated last counts."""
    raw = table(spark, directory, "entities")
    newest = F.struct(iso_seconds("updated_at").alias("u"), *[F.col(c) for c in raw.columns])
    return raw.groupBy("id").agg(F.max(newest).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in raw.columns])


def relationships(spark: SparkSession, directory: str) -> DataFrame:
    """Relationships once per id."""
    raw = table(spark, directory, "relationships")
    rest = [c for c in raw.columns if c != "id"]
    return raw.groupBy("id").agg(F.max(F.struct(*rest)).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def chunks(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks once per (scope, kind, ref, chunk_idx): the last delivered id replaces the others."""
    raw = table(spark, directory, "chunks")
    keys = ["scope", "kind", "ref", "chunk_idx"]
    kept = raw.groupBy(*keys).agg(F.max("id").alias("id")).select("id")
    return raw.join(kept, "id", "left_semi")
