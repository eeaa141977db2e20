"""Snapshots brought forward by comparison: signatures, upserts, key migrations, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.durable import cut


def signatures(chunks: DataFrame, ordered: bool = True) -> DataFrame:
    """(scope, kind, ref, signature): one hash over the contents of a document, in order or as a set.

    Hashes are folded per document after a map-side step, so no content is shuffled.
    """
    h = chunks.select("scope", "kind", "ref", "chunk_idx", F.xxhash64("content").alias("h"))
    if ordered:
        mixed = F.xxhash64("chunk_idx", "h")
    else:
        h = h.select("scope", "kind", "ref", "h").distinct()
        mixed = F.col("h")
    return h.groupBy("scope", "kind", "ref").agg(F.sum(mixed.cast("decimal(38,0)")).alias("signature"), F.count(F.lit(1)).alias("n_chunks"))


def document_diff(old: DataFrame, new: DataFrame, ordered: bool = True) -> DataFrame:
    """(scope, kind, ref, state): unchanged, changed, new or deleted."""
    o = signatures(old, ordered).select("scope", "kind", "ref", F.col("signature").alias("so"), F.col("n_chunks").alias("no"))
    n = signatures(new, ordered).select("scope", "kind", "ref", F.col("signature").alias("sn"), F.col("n_chunks").alias("nn"))
    state = F.when(F.col("so").isNull(), "new").when(F.col("sn").isNull(), "deleted").when((F.col("so") == F.col("sn")) & (F.col("no") == F.col("nn")), "unchanged").otherwise("changed")
    return o.join(n, ["scope", "kind", "ref"], "full_outer").select("scope", "kind", "ref", state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """Rows of both; of equal keys the new row (replace) or the old one (ignore)."""
    if replace:
        return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new)
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*new.columns))


def latest_per_key(rows: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """Of rows with equal keys the one with the largest ``order``."""
    kept = rows.groupBy(*keys).agg(F.max(order).alias(order)).select(order)
    return rows.join(kept, order, "left_semi")


def migrated(rows: DataFrame, columns: dict[str, str], ledger: set[str], name: str) -> tuple[DataFrame, set[str]]:
    """Columns that are missing are added as nulls, once: the ledger names what has been done."""
    if name in ledger:
        return rows, ledger
    for column, kind in columns.items():
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast(kind))
    return rows, ledger | {name}


def folder_rollup(pages: DataFrame) -> DataFrame:
    """(folder, depth, n_direct, n_total, rollup_hash) of every folder from its pages (path, slug, body_hash) and subfolders.

    Folders are closed upwards by exploding each path into its prefixes, so one aggregation serves all
    depths; the hash covers the pages below in order of their slugs and does not depend on their storage.
    """
    parts = F.split("path", "/")
    below = pages.select("slug", "body_hash", "path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("parts"))
    listed = below.select(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("folder"), "depth", "slug", "body_hash", (F.col("depth") == F.size("parts")).alias("direct"))
    each = F.conv(F.substring(F.sha2(F.concat_ws("\u0000", "slug", "body_hash"), 256), 1, 15), 16, 10).cast("long")
    return listed.groupBy("folder", "depth").agg(F.count_if("direct").alias("n_direct"), F.count(F.lit(1)).alias("n_total"), F.substring(F.sha2(F.concat_ws("|", F.sum(each.cast("decimal(38,0)")).cast("string"), F.count(F.lit(1)).cast("string")), 256), 1, 16).alias("rollup_hash"))


def changed_rollups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Folders to summarise again: those whose hash differs from the last one or that are new."""
    return new.join(old.select("folder", "rollup_hash"), ["folder", "rollup_hash"], "left_anti")


def collision_free(slugs: DataFrame, taken: DataFrame) -> DataFrame:
    """(slug, row_id, free_slug): slugs that are taken or repeat get the first free of ``-1``, ``-2`` and so on, in order of row_id.

    Each round gives the waiting rows of a slug its free numbers. Where two slugs come to the same name, as
    ``a`` with ``-1`` and ``a-1`` do, the smaller row_id keeps it; the other and all later rows of the family
    (slugs that differ only in numbers at the end) wait for the next round, in which the name is taken. So no
    name is given twice, and the names are those of going through the rows one by one.
    """
    used = cut(taken.where("slug IS NOT NULL").select("slug").distinct())
    waiting = cut(slugs.where("slug IS NOT NULL").select("slug", "row_id"))
    named: DataFrame | None = None
    while True:
        numbered = used.where(F.col("slug").rlike(r"^.+-[1-9][0-9]{0,8}$")).select(F.regexp_extract("slug", r"^(.+)-[0-9]+$", 1).alias("slug"), F.regexp_extract("slug", r"-([0-9]+)$", 1).cast("long").alias("number"))
        occupied = used.select("slug", F.lit(0).cast("long").alias("number")).unionByName(numbered)
        sizes = waiting.groupBy("slug").agg(F.count(F.lit(1)).alias("n")).join(occupied.groupBy("slug").agg(F.count(F.lit(1)).alias("m")), "slug", "left").withColumn("m", F.coalesce("m", F.lit(0)))
        free = sizes.select("slug", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + F.col("m") - 1)).alias("number")).join(occupied, ["slug", "number"], "left_anti")
        places = free.withColumn("place", F.row_number().over(Window.partitionBy("slug").orderBy("number"))).where("place <= n").select("slug", "place", "number")
        order = waiting.withColumn("place", F.row_number().over(Window.partitionBy("slug").orderBy("row_id")))
        proposed = order.join(places, ["slug", "place"]).select("slug", "row_id", F.when(F.col("number") == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("number").cast("string"))).alias("free_slug"))
        first = proposed.groupBy("free_slug").agg(F.min_by(F.struct("slug", "row_id"), "row_id").alias("r")).select("r.slug", "r.row_id", "free_slug")
        family = F.regexp_replace("slug", r"(-[0-9]+)+$", "")
        lost = proposed.join(first, ["slug", "row_id", "free_slug"], "left_anti").groupBy(family.alias("family")).agg(F.min("row_id").alias("until"))
        won = cut(first.withColumn("family", family).join(lost, "family", "left").where("until IS NULL OR row_id < until").select("slug", "row_id", "free_slug"))
        named = won if named is None else named.unionByName(won)
        waiting = cut(waiting.join(won.select("slug", "row_id"), ["slug", "row_id"], "left_anti"))
        if waiting.isEmpty():
            return named
        used = cut(used.unionByName(won.select(F.col("free_slug").alias("slug"))))
