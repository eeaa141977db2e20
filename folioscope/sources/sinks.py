"""Publishing snapshots, reports and pages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(rows: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Write a snapshot under a name made of its number, then point ``CURRENT`` at it: readers see all or nothing."""
    spark = rows.sparkSession
    number = (current_version(spark, root) or 0) + 1
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/v{number}")
    spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("overwrite").json(f"{root}/CURRENT")
    return f"{root}/v{number}"


def current_version(spark: SparkSession, root: str) -> int | None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    row = spark.read.schema("version long").json(f"{root}/CURRENT").first()
    return row["version"] if row else None


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The published snapshot; a ``scope`` filter on it prunes partitions where it is partitioned by scope."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.parquet(f"{root}/v{version}")


def page_texts(pages: DataFrame) -> DataFrame:
    """(path, text): pages (scope, slug, title, topics, sources, body) with front matter, ready to be written."""

    def inline(column: str) -> F.Column:  # type: ignore[name-defined]
        return F.concat(F.lit("["), F.array_join(F.coalesce(F.col(column), F.array().cast("array<string>")), ", "), F.lit("]"))

    front = F.concat(F.lit("---\ntitle: "), "title", F.lit("\ntopics: "), inline("topics"), F.lit("\nsources: "), inline("sources"), F.lit("\nscope: "), "scope", F.lit("\n---\n\n"))
    return pages.select(F.concat(F.lit("wiki/"), "scope", F.lit("/"), "slug", F.lit(".md")).alias("path"), F.concat(front, "body", F.lit("\n")).alias("text"))


def report_rows(issues: DataFrame) -> DataFrame:
    """(page, report): one JSON report per page with its issues in order of severity and claim."""
    rank = F.when(F.col("severity") == "contradiction", 0).when(F.col("severity") == "missing", 1).otherwise(2)
    listed = issues.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "claim", "severity", "source_ref"))), lambda x: F.struct(x["severity"].alias("severity"), x["claim"].alias("claim_in_page"), x["source_ref"].alias("source_ref"))).alias("issues"))
    return listed.select("page", F.to_json(F.struct("page", F.lit("issues").alias("status"), "issues")).alias("report"))


def graph_page(nodes_json: list[str], links_json: list[str], title: str = "Graph") -> str:
    """A self-contained HTML page around an export that was capped by the caller; JSON is escaped for scripts."""
    data = json.dumps({"nodes": [json.loads(n) for n in nodes_json], "links": [json.loads(x) for x in links_json]}, ensure_ascii=False).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>{title}</title><script id="graph" type="application/json">{data}</script>'
