"""The incremental behaviour of the pipeline as Structured Streaming.

``changed_chunks`` keeps a snapshot of chunks up to date from a stream of deliveries; ``rolling_rate``
counts events in sliding windows with a watermark; ``expiring`` gives up entries after a time to live;
``pending_orphans`` keeps the references that no parent resolves, as references, arrivals and deletions come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.operators import orphans as O


def stream_of(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process what is there, batch by batch, and stop. One writer per checkpoint."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def changed_chunks(target: str) -> Callable[[DataFrame, int], None]:
    """A batch function: new contents replace old ones of the same key, equal contents change nothing.

    Versions lie beside each other by batch number, so a repeated batch after a failure writes the same
    version again.
    """
    keys = ["scope", "kind", "ref", "chunk_idx"]

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(*keys).agg(F.max(F.struct("id", "content")).alias("r")).select(*keys, "r.id", "r.content")
        if number > 0:
            old = spark.read.parquet(f"{target}/v{number - 1}")
            same = newest.join(old.select(*keys, "content"), [*keys, "content"], "left_semi").select(*keys)
            fresh = newest.join(same, keys, "left_anti")
            newest = old.join(fresh.select(*keys), keys, "left_anti").select(*keys, "id", "content").unionByName(fresh)
        newest.write.mode("overwrite").parquet(f"{target}/v{number}")

    return each


def rolling_rate(events: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """(user_id, start, n): events per user in sliding windows; late ones up to ``late`` count."""
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    return at.withWatermark("at", late).groupBy("user_id", F.window("at", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def expiring(events: DataFrame, ttl_ms: int) -> DataFrame:
    """(key, status): each key is ``open`` when it comes and ``expired`` once event time has passed its time to live.

    ``events``: (key string, at timestamp) with a watermark on ``at``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "status": ["expired"]})
            return
        last = max(b["at"].max() for b in batches)
        known = state.exists
        state.update((int(last.timestamp() * 1000),))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + ttl_ms, state.getCurrentWatermarkMs() + 1))
        if not known:
            yield pd.DataFrame({"key": [key[0]], "status": ["open"]})

    return events.groupBy("key").applyInPandasWithState(step, "key string, status string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


CHANGE = "kind string, " + O.REFERENCE + ", version string, born string, gone string"


def changes(references: DataFrame, parents: DataFrame) -> DataFrame:
    """References and parents as one table of changes, to be delivered together."""
    r = references.select(F.lit("reference").alias("kind"), *O._COLUMNS)
    p = parents.select(F.lit("parent").alias("kind"), *O._SPAN)
    return r.unionByName(p, allowMissingColumns=True)


def pending_orphans(target: str, seen: list[int] | None = None, buckets: int = 8) -> Callable[[DataFrame, int], None]:
    """A batch function over a stream of ``changes``: late parents resolve references that wait, deletions reopen
    them, and counts per table and period are written after each batch. A repeated batch gives the same state.
    """

    def each(batch: DataFrame, number: int) -> None:
        store = O.load(batch.sparkSession, target, number - 1, buckets)
        store = O.advance(store, batch.where("kind = 'reference'"), batch.where("kind = 'parent'"), number)
        O.snapshot(store).write.mode("overwrite").parquet(f"{target}/counts/v{number}")
        if seen is not None:
            seen.append(number)

    return each
