"""Most similar vectors for every vector, by robust-pruned graphs over overlapping shards.

Vectors are scaled to unit length and equal ones folded into one point, so a group of copies of any
size is one node of one graph. Shards are the cells of a tree of centroids. The top of the tree is fitted
on at most ``SAMPLE`` rows on the driver; with more than ``FLAT`` cells, each branch is fitted in the
cluster on ``PER_CELL`` sampled rows a cell. Every row is indexed. A point descends only into the branches
nearest to it, so its assignment costs about the square root of the number of cells, not all of them.

A point is indexed in its two nearest cells and in all others, up to ``MOST``, whose centroid is at most
``margin`` less similar than the nearest: points near borders lie in more cells than those inside, and as
cells become smaller, points lie in more of them. Neighbours are proposed by every shard that holds the
point. A cell that the sample shows to be too large is divided, and its points then also query the other
parts. ``nearest_for_queries`` indexes each point in one cell and sends every query to its nearest cells.

Ties are broken by the smaller id. A copy is as similar as a vector can be: members of a group of more
than k copies have the k smallest other ids of the group as their neighbours, so results stay linear.

Defined cases: null, empty and all-zero embeddings, those of another length than ``dim`` and those with
a null, NaN or infinite element take no part; repeated ids count once; an empty table gives no rows; a
single vector has no neighbours; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.durable import cut
from folioscope.llm.vector_graph import VectorGraph

#: Most rows on the driver for the top of the tree, vectors that one shard should hold, cells of a tree
#: without branches, and sampled rows per cell of a branch.
SAMPLE, SHARD, FLAT, PER_CELL = 20_000, 16_000, 256, 64
#: Cells a point is indexed in at most, and how many of them on average when cells are planned.
MOST, USUAL = 8, 3
EDGE = "point long, other long, similarity float"


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def unit_points(rows: DataFrame, id_column: str, vector_column: str, dim: int) -> DataFrame:
    """(id, point, vector): unit vectors as bytes; ``point`` is the same for equal ones."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            x = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(-1, dim).astype(np.float64)
            norm = np.sqrt((x * x).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            x = x[good] / norm[good][:, None]
            small = x.astype(np.float32)
            grid = np.round(x * 20000).astype(np.int64).astype(np.uint64)  # copies that were scaled meet on the grid
            weight = np.random.default_rng(5).integers(1, 2**63, dim, dtype=np.uint64) | np.uint64(1)
            with np.errstate(over="ignore"):
                point = ((grid + np.uint64(1 << 20)) * weight * (grid ^ (weight >> np.uint64(7)))).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(0).to_numpy()[good]), pa.array(point.view(np.int64)), pa.array([v.tobytes() for v in small], pa.binary())],
                names=["id", "point", "vector"],
            )

    usable = rows.where(F.col(id_column).isNotNull() & (F.size(vector_column) == dim) & ~F.exists(vector_column, lambda v: v.isNull()))
    return usable.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<float>").alias("v")).mapInArrow(unit, "id long, point long, vector binary")


@dataclass(frozen=True)
class CellTree:
    """Top centroids, the cells below each of them (rows ``first[t]`` to ``first[t + 1]`` of ``cells``), and into how many parts a cell is divided."""

    top: np.ndarray
    first: np.ndarray
    cells: np.ndarray
    parts: np.ndarray

    def near(self, x: np.ndarray, least: int, most: int, margin: float, branches: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the cells of each vector, ``least`` of them and up to ``most`` within ``margin`` of the best."""
        if len(self.top) == 1:
            row, cell, value = _best(x @ self.cells.T, most)
        else:
            wide = min(len(self.top), max(branches, 2 * most))
            row_t, top, _ = _best(x @ self.top.T, wide)
            found = []
            order = np.argsort(top, kind="stable")
            row_t, top = row_t[order], top[order]
            for t in np.unique(top):
                rows = row_t[np.searchsorted(top, t, "left") : np.searchsorted(top, t, "right")]
                own = slice(self.first[t], self.first[t + 1])
                r, c, v = _best(x[rows] @ self.cells[own].T, most)
                found.append((rows[r], c + self.first[t], v))
            row, cell, value = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.lexsort((cell, -value, row))
        row, cell, value = row[order], cell[order], value[order]
        start = np.searchsorted(row, row, "left")
        rank = np.arange(len(row)) - start
        keep = (rank < least) | ((rank < most) & (value >= value[start] - margin))
        return row[keep], cell[keep]


def _best(sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the ``most`` largest of each row."""
    most = min(most, sims.shape[1])
    column = np.argpartition(sims, sims.shape[1] - most, axis=1)[:, sims.shape[1] - most :]
    return np.repeat(np.arange(len(sims)), most), column.ravel(), np.take_along_axis(sims, column, 1).ravel()


def spherical_means(x: np.ndarray, cells: int, seed: int = 3, rounds: int = 8) -> np.ndarray:
    """Centroids of unit length; those that lose all their points are left out."""
    if len(x) <= cells or cells == 1:
        mean = x.sum(axis=0, keepdims=True) if len(x) else np.zeros((1, x.shape[1]), np.float32)
        return x if 1 < cells and len(x) else mean / max(float(np.linalg.norm(mean)), 1e-9)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        there, first = np.unique(own[order], return_index=True)
        mean = np.add.reduceat(x[order], first)
        length = np.linalg.norm(mean, axis=1)
        c = mean[length > 0] / length[length > 0][:, None]
    return c


def fit_cells(points: DataFrame, total: int, dim: int, shard: int, per_point: int, seed: int = 3) -> CellTree:
    """The tree over about ``total * per_point / shard`` cells."""
    cells = max(1, -(-total * per_point // shard))
    tops = 1 if cells <= FLAT else int(np.ceil(np.sqrt(cells)))

    def sampled(wanted: int) -> DataFrame:
        fraction = min(1.0, 1.2 * wanted / max(total, 1))
        return points.select("vector") if fraction >= 1 else points.select("vector").sample(fraction=fraction, seed=seed)

    x = _matrix(sampled(SAMPLE).limit(SAMPLE).toArrow().column("vector"), dim)
    if tops == 1:
        found = spherical_means(x, cells, seed)
        return _with_parts(CellTree(np.zeros((1, dim), np.float32), np.array([0, len(found)]), found, np.ones(len(found), np.int64)), x, total, shard, per_point)
    top = spherical_means(x, tops, seed)
    shared = points.sparkSession.sparkContext.broadcast(top)

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (_matrix(batch.column(0), dim) @ shared.value.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), batch.column(0)], names=["top", "vector"])

    def fit(group: pa.Table) -> pa.Table:
        rows = _matrix(group.column("vector"), dim)
        below = spherical_means(rows, max(1, len(rows) // PER_CELL), seed)
        return pa.Table.from_arrays([group.column("top").combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(below), np.int64))), pa.array([v.tobytes() for v in below.astype(np.float32)], pa.binary())], names=["top", "vector"])

    fitted = sampled(PER_CELL * cells).mapInArrow(branch, "top long, vector binary").groupBy("top").applyInArrow(fit, "top long, vector binary").toArrow()
    number = fitted.column("top").to_numpy()
    order = np.argsort(number, kind="stable")
    below = _matrix(fitted.column("vector"), dim)[order]
    there, first = np.unique(number[order], return_index=True)
    tree = CellTree(top[there], np.concatenate([first, [len(below)]]), below, np.ones(len(below), np.int64))
    return _with_parts(tree, x, total, shard, per_point)


def _with_parts(tree: CellTree, x: np.ndarray, total: int, shard: int, per_point: int) -> CellTree:
    """Cells that the sample shows to hold more than three shards are divided."""
    least, margin, most = (1, 0.0, 1) if per_point == 1 else (2, 0.2, MOST)
    load = np.bincount(tree.near(x, least, most, margin)[1], minlength=len(tree.cells)) * (total / max(len(x), 1)) if len(x) else np.zeros(len(tree.cells))
    return CellTree(tree.top, tree.first, tree.cells, np.maximum(1, np.ceil(load / (3 * shard))).astype(np.int64))


def point_edges(points: DataFrame, total: int, k: int, dim: int, at_least: float, margin: float, shard: int) -> DataFrame:
    """Proposed neighbours (point, other, similarity) of every point, from all shards that hold it."""
    tree = fit_cells(points, total, dim, shard, USUAL)
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            row, near = cells.near(_matrix(batch.column(1), dim), 2, MOST, margin)
            times = cells.parts[near]
            row, cell = np.repeat(row, times), np.repeat(near, times)
            part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            home = batch.column(0).to_numpy()[row] % cells.parts[cell] == part
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell * 100_000 + part), pa.array(home), batch.column(0).take(take), batch.column(1).take(take)], names=["shard", "indexed", "point", "vector"]
            )

    def link(group: pa.Table) -> pa.Table:
        ids, indexed = group.column("point").to_numpy(), group.column("indexed").to_numpy(zero_copy_only=False)
        x = _matrix(group.column("vector"), dim)
        own, graph = ids[indexed], VectorGraph(x[indexed])
        near, sims = graph.neighbours_of_all(k)
        left = [np.repeat(own, k)]
        right, value = [near.ravel()], [sims.ravel()]
        if not indexed.all():
            near, sims = graph.query(x[~indexed], k, 4 * k)
            left.append(np.repeat(ids[~indexed], k))
            right.append(near.ravel())
            value.append(sims.ravel())
        left, right, value = np.concatenate(left), np.concatenate(right), np.concatenate(value)
        good = (right >= 0) & (value >= at_least)
        left, right, value = left[good], own[right[good]], value[good]
        differ = left != right
        return pa.Table.from_arrays([pa.array(left[differ]), pa.array(right[differ]), pa.array(value[differ])], names=["point", "other", "similarity"])

    assigned = points.select("point", "vector").mapInArrow(assign, "shard long, indexed boolean, point long, vector binary")
    # A shard is much work in few bytes: a stated number of partitions is not coalesced by size.
    return assigned.repartition(2 * int(tree.parts.sum()), "shard").groupBy("shard").applyInArrow(link, EDGE)


def folded(unit: DataFrame, k: int) -> DataFrame:
    """(point, vector, copies, first_ids): the k + 1 smallest ids of every point, by a limit per group before the shuffle."""
    rank = F.dense_rank().over(Window.partitionBy("point").orderBy("id"))  # repeated ids count once
    first = unit.select("point", "id", "vector").withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return first.groupBy("point").agg(F.min_by("vector", "id").alias("vector"), F.array_sort(F.collect_set("id")).alias("first_ids"))


def nearest_neighbours(rows: DataFrame, k: int = 10, at_least: float = -1.0, id_column: str = "id", vector_column: str = "embedding", dim: int = 64, margin: float = 0.2, shard: int = SHARD) -> DataFrame:
    """(id, neighbour, similarity): for every row its k most similar rows with at least that cosine."""
    unit = unit_points(rows, id_column, vector_column, dim)
    total = rows.where(F.size(vector_column) == dim).count()
    points = cut(folded(unit, k))
    edges = point_edges(points.select("point", "vector"), total, k, dim, at_least, margin, shard)
    ids = points.select("point", "first_ids")
    best = (
        edges.groupBy("point", "other").agg(F.max("similarity").alias("similarity"))
        .join(ids.select(F.col("point").alias("other"), F.col("first_ids").alias("other_ids")), "other")
        .groupBy("point")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("similarity", "other_ids")), asc=False), 1, k).alias("near"))
    )
    # The k + 1 best candidates of a point: its own first copies at 1, then the first copies of its neighbours.
    own = F.transform("first_ids", lambda i: F.struct(F.lit(-1.0).cast("float").alias("s"), i.alias("i")))
    other = F.flatten(F.transform("near", lambda n: F.transform(n["other_ids"], lambda i: F.struct((-n["similarity"]).alias("s"), i.alias("i")))))
    lists = ids.join(best, "point", "left").select("point", "first_ids", F.slice(F.array_sort(F.concat(own, F.coalesce(other, F.array().cast("array<struct<s:float,i:bigint>>")))), 1, k + 1).alias("near"))
    some = lists.where(F.size("near") > 1)
    few = some.where(F.size("first_ids") <= k).select(F.explode("first_ids").alias("id"), "near")
    many = unit.select("id", "point").distinct().join(some.where(F.size("first_ids") > k).select("point", "near"), "point").select("id", "near")
    near = few.unionByName(many).select("id", F.slice(F.filter("near", lambda n: n["i"] != F.col("id")), 1, k).alias("near"))
    return near.select("id", F.explode("near").alias("n")).select("id", F.col("n.i").alias("neighbour"), (-F.col("n.s")).alias("similarity"))


def similar_pairs(rows: DataFrame, at_least: float = 0.9, k: int = 10, **options) -> DataFrame:
    """Pairs (a < b) with that cosine of which one is among the k most similar of the other."""
    near = nearest_neighbours(rows, k=k, at_least=at_least, **options)
    return near.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()


def nearest_for_queries(rows: DataFrame, queries: DataFrame, k: int = 10, beam: int = 96, probes: int = 32, id_column: str = "id", vector_column: str = "embedding", dim: int = 64, shard: int = SHARD) -> DataFrame:
    """(query_id, neighbour, similarity): beam search of every query in its ``probes`` nearest shards, merged to the k best.

    Every point is indexed in one shard; queries, equal ones once, are sent to all parts of their cells. The
    ids of the points found are joined afterwards.
    """
    total = rows.where(F.size(vector_column) == dim).count()
    points = cut(folded(unit_points(rows, id_column, vector_column, dim), k))
    tree = fit_cells(points, total, dim, shard, 1)
    shared = rows.sparkSession.sparkContext.broadcast(tree)
    shape = "shard long, indexed boolean, point long, vector binary"

    def place(batches: Iterator[pa.RecordBatch], indexed: bool) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            row, cell = cells.near(_matrix(batch.column(1), dim), 1 if indexed else probes, 1 if indexed else probes, 0.0)
            point = batch.column(0).to_numpy()
            if indexed:
                part = point[row] % cells.parts[cell]
            else:
                times = cells.parts[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cell * 100_000 + part), pa.array(np.full(len(row), indexed)), batch.column(0).take(take), batch.column(1).take(take)], names=["shard", "indexed", "point", "vector"])

    indexed = points.select("point", "vector").mapInArrow(lambda batches: place(batches, True), shape)
    asked = unit_points(queries, id_column, vector_column, dim)
    sent = asked.groupBy("point").agg(F.min_by("vector", "id").alias("vector")).mapInArrow(lambda batches: place(batches, False), shape)

    def search(group: pa.Table) -> pa.Table:
        ids, own = group.column("point").to_numpy(), group.column("indexed").to_numpy(zero_copy_only=False)
        x = _matrix(group.column("vector"), dim)
        near, sims = VectorGraph(x[own] if not own.all() else x[:0]).query(x[~own], k + 1, beam)
        left, right, value = np.repeat(ids[~own], k + 1), near.ravel(), sims.ravel()
        good = right >= 0
        return pa.Table.from_arrays([pa.array(left[good]), pa.array(ids[own][right[good]]), pa.array(value[good])], names=["point", "other", "similarity"])

    found = indexed.unionByName(sent).repartition(2 * int(tree.parts.sum()), "shard").groupBy("shard").applyInArrow(search, EDGE)
    best = (
        found.join(points.select(F.col("point").alias("other"), "first_ids"), "other")
        .groupBy("point").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("first_ids").alias("ids")))), 1, k + 1).alias("near"))
    )
    # The k + 1 best ids of a query point, of which one can be the query itself.
    lists = best.select("point", F.slice(F.array_sort(F.flatten(F.transform("near", lambda n: F.transform(n["ids"], lambda i: F.struct(n["s"].alias("s"), i.alias("i")))))), 1, k + 1).alias("near"))
    each = asked.select(F.col("id").alias("query_id"), "point").distinct().join(lists, "point").select("query_id", F.explode("near").alias("n")).where(F.col("n.i") != F.col("query_id"))
    merged = each.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set("n")), 1, k).alias("near"))
    return merged.select("query_id", F.explode("near").alias("n")).select("query_id", F.col("n.i").alias("neighbour"), (-F.col("n.s")).alias("similarity"))


def exact_for_queries(rows: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "id", vector_column: str = "embedding", dim: int = 64, block: int = 4096) -> DataFrame:
    """(query_id, similarity): the k largest similarities of each query, by products of blocks of queries with blocks of all rows.

    A yardstick for recall: its cost grows with the product of both sides.
    """
    x = unit_points(rows, id_column, vector_column, dim).groupBy("id").agg(F.first("vector").alias("vector"))
    q = unit_points(queries, id_column, vector_column, dim).groupBy("id").agg(F.first("vector").alias("vector"))
    n_rows, n_queries = (max(1, -(-t.where(F.size(vector_column) == dim).count() // block)) for t in (rows, queries))
    spread = x.select(F.pmod(F.xxhash64("id"), F.lit(n_rows)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))).alias("j"), F.lit(False).alias("asks"), "id", "vector")
    sent = q.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))).alias("i"), F.pmod(F.xxhash64("id"), F.lit(n_queries)).alias("j"), F.lit(True).alias("asks"), "id", "vector")

    def multiply(group: pa.Table) -> pa.Table:
        ids, asks = group.column("id").to_numpy(), group.column("asks").to_numpy(zero_copy_only=False)
        v = _matrix(group.column("vector"), dim)
        sims = v[asks] @ v[~asks].T
        sims[ids[asks][:, None] == ids[~asks][None, :]] = -np.inf
        row, _, value = _best(sims, k) if sims.size else (np.zeros(0, np.int64), None, np.zeros(0, np.float32))
        good = np.isfinite(value)
        return pa.Table.from_arrays([pa.array(ids[asks][row[good]]), pa.array(value[good])], names=["query_id", "similarity"])

    met = spread.unionByName(sent).repartition(2 * n_rows * n_queries, "i", "j").groupBy("i", "j").applyInArrow(multiply, "query_id long, similarity float")
    best = met.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("similarity"), asc=False), 1, k).alias("s"))
    return best.select("query_id", F.explode("s").alias("similarity"))


def recall(found: DataFrame, exact: DataFrame, queries: DataFrame, id_column: str = "id", slack: float = 1e-5) -> DataFrame:
    """(n_queries, wanted, met): of the neighbours that queries have, how many are found; equally similar ones count alike."""
    last = exact.groupBy("query_id").agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("wanted"))
    asked = queries.select(F.col(id_column).cast("long").alias("query_id")).distinct()
    good = last.join(asked, "query_id", "left_semi").join(found.select(F.col("query_id").alias("q"), "similarity"), F.col("query_id") == F.col("q"), "left")
    each = good.groupBy("query_id", "wanted").agg(F.count_if(F.col("similarity") >= F.col("least") - slack).alias("met"))
    return each.agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum("wanted"), F.lit(0)).alias("wanted"), F.coalesce(F.sum(F.least("met", "wanted")), F.lit(0)).alias("met"))
