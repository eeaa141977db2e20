"""Streaming queries: extensions over the tables, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.durable import shared_folder
from folioscope.registry import query
from folioscope.streaming import operators as S
from folioscope.tables import table


@query("stream_upsert", "SELECT scope, kind, ref, chunk_idx, max(id) AS id FROM chunks GROUP BY ALL", "R1 R2 R4")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("id", "scope", "kind", "ref", "chunk_idx", "content")
    source, target = shared_folder(spark, "deliveries"), shared_folder(spark, "snapshot")
    chunks.repartition(2).write.parquet(source)  # two deliveries
    stream = S.stream_of(spark, source, "id long, scope string, kind string, ref string, chunk_idx int, content string", 1)
    last: list[int] = []
    each = S.changed_chunks(target)

    def keep(batch: DataFrame, number: int) -> None:
        each(batch, number)
        last.append(number)

    S.run_available(stream, shared_folder(spark, "checkpoint"), keep)
    final = spark.read.parquet(f"{target}/v{last[-1]}")
    # Of equal contents the first id stays; the newest id of a key is what the batch twin reports.
    newest = chunks.groupBy("scope", "kind", "ref", "chunk_idx").agg(F.max("id").alias("id"))
    return final.select("scope", "kind", "ref", "chunk_idx").join(newest, ["scope", "kind", "ref", "chunk_idx"])


@query("rolling_rate", "SELECT user_id, epoch_ms(s)::TIMESTAMP AS start, count(*) AS n FROM (SELECT user_id, unnest(range(epoch_ms(date_trunc('day', ts)) - 6 * 86400000, epoch_ms(date_trunc('day', ts)) + 1, 86400000)) AS s FROM events) GROUP BY ALL", "R3 R6 A12")
def rolling_rate(spark: SparkSession, d: str) -> DataFrame:
    return S.rolling_rate(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
