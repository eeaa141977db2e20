"""References to records that do not exist, kept as keyed state that is brought forward batch by batch.

State is two tables, both divided into buckets by a hash of the referenced key:

* ``parents``: for each key and version of its record, the life span ``[born, gone)`` as far as known;
* ``references``: every reference seen so far with its own time and whether it is an orphan now.

A batch of references probes the parent index; a batch of parents only touches the references that
carry one of its keys: a span that covers the reference's time resolves it, a deletion that arrives
afterwards closes the span and opens it again. Only buckets that hold a key of the batch are read and
written anew, under the number of the batch; the others stay as files of older batches. A manifest per
batch names the files of each bucket, so a batch that is repeated after a failure gives the same state,
and nothing that a reader still uses is overwritten. Totals do not depend on how the rows are divided into
batches or on their order.

Defined cases: a null key is no reference; repeated rows (same record, field, key and time) count
once; a span without ``born`` is open to the past, one without ``gone`` open to the future; a parent that
is delivered again with the same ``version`` is one span, which ends at the latest ``gone`` known for it; a
reference without a time is resolved by any span of its key; empty inputs give empty results. Extra
columns of the inputs are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE = "table_name string, field_name string, record_id string, period string, ref_key string, at string"
PARENT = "ref_key string, version string, born string, gone string"
_COLUMNS = [c.split()[0] for c in REFERENCE.split(", ")]
_SPAN = [c.split()[0] for c in PARENT.split(", ")]


@dataclass(frozen=True)
class OrphanStore:
    """State after batch ``number``: which file set of which batch holds a bucket. At most ``buckets`` entries a table."""

    spark: SparkSession
    folder: str
    buckets: int = 8
    number: int = -1
    parents: dict[int, int] = field(default_factory=dict)
    references: dict[int, int] = field(default_factory=dict)

    def path(self, table: str, number: int, bucket: int) -> str:
        return f"{self.folder}/{table}/v{number}/bucket={bucket}"

    def read(self, table: str, only: list[int] | None = None) -> DataFrame:
        places = getattr(self, table)
        paths = [self.path(table, n, b) for b, n in sorted(places.items()) if only is None or b in only]
        schema = PARENT if table == "parents" else REFERENCE + ", orphan boolean"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def save(self) -> OrphanStore:
        """Write the manifest of this batch, a small file."""
        path, files = _place(self.spark, f"{self.folder}/manifest/v{self.number}.json")
        out = files.create(path, True)
        out.write(json.dumps({t: getattr(self, t) for t in ("parents", "references")}).encode())
        out.close()
        return self


def load(spark: SparkSession, folder: str, number: int, buckets: int = 8) -> OrphanStore:
    """The state after batch ``number``; before the first one it is empty."""
    if number < 0:
        return OrphanStore(spark, folder, buckets)
    path, files = _place(spark, f"{folder}/manifest/v{number}.json")
    source = files.open(path)
    held = json.loads(bytes(source.readAllBytes()))
    source.close()
    return OrphanStore(spark, folder, buckets, number, *({int(b): n for b, n in held[t].items()} for t in ("parents", "references")))


def _place(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _probe(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Decide each reference against the spans of its key.

    The spans of one key are folded into one array first, so that the join is one to many whatever the
    number of re-deliveries; a key that a third of all references carry is split by AQE's skew join,
    which may divide the left side of a left outer join.
    """
    spans = parents.groupBy("ref_key").agg(F.collect_set(F.struct("born", "gone")).alias("spans"))
    covered = F.exists(
        "spans",
        lambda s: F.col("at").isNull()
        | ((s["born"].isNull() | (s["born"] <= F.col("at"))) & (s["gone"].isNull() | (s["gone"] > F.col("at")))),
    )
    return references.join(spans, "ref_key", "left").select(*_COLUMNS, (~F.coalesce(covered, F.lit(False))).alias("orphan"))


def advance(store: OrphanStore, references: DataFrame, parents: DataFrame, number: int | None = None) -> OrphanStore:
    """The state after one batch of new references and one of parents (arrivals and deletions)."""
    number = store.number + 1 if number is None else number
    bucket = F.pmod(F.xxhash64("ref_key"), F.lit(store.buckets)).cast("int").alias("bucket")
    fresh = references.where(F.col("ref_key").isNotNull()).select(*_COLUMNS).distinct()
    arrived = parents.where(F.col("ref_key").isNotNull()).select(*_SPAN).distinct()
    touched = sorted(r[0] for r in fresh.select(bucket).unionByName(arrived.select(bucket)).distinct().collect())
    if not touched:
        return OrphanStore(store.spark, store.folder, store.buckets, number, store.parents, store.references).save()
    spans = store.read("parents", touched).unionByName(arrived).groupBy("ref_key", "version").agg(F.max("born").alias("born"), F.max("gone").alias("gone"))
    held = _write(spans, bucket, f"{store.folder}/parents/v{number}")
    after = OrphanStore(store.spark, store.folder, store.buckets, number, store.parents | dict.fromkeys(held, number), store.references)
    known = store.read("references", touched)
    keys = arrived.select("ref_key").distinct()
    untouched = known.join(keys, "ref_key", "left_anti").select(*_COLUMNS, "orphan")
    again = fresh.unionByName(known.join(keys, "ref_key", "left_semi").select(*_COLUMNS)).distinct()
    decided = _probe(again, after.read("parents", touched))
    # A reference that is delivered again is decided anew and replaces its earlier row.
    merged = untouched.unionByName(decided).groupBy(*_COLUMNS).agg(F.min("orphan").alias("orphan")) if store.references else decided
    held = _write(merged, bucket, f"{store.folder}/references/v{number}")
    return OrphanStore(store.spark, store.folder, store.buckets, number, after.parents, store.references | dict.fromkeys(held, number)).save()


def _write(rows: DataFrame, bucket: Column, path: str) -> list[int]:
    """One part per bucket, and which there are; a bucket with a hot key is divided further by AQE."""
    rows.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    target, files = _place(rows.sparkSession, path)
    names = [f.getPath().getName() for f in files.listStatus(target)]
    return [int(n.partition("=")[2]) for n in names if n.startswith("bucket=")]


def orphans(store: OrphanStore) -> DataFrame:
    return store.read("references").where("orphan").select("table_name", "field_name", "record_id", "period").distinct()


def snapshot(store: OrphanStore) -> DataFrame:
    """Orphans and references per table, field and period."""
    return store.read("references").groupBy("table_name", "field_name", "period").agg(
        F.count_if("orphan").alias("n_orphans"), F.count(F.lit(1)).alias("n_references")
    )
