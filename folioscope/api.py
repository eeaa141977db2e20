"""One object for the commands a user of the pipeline knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import folioscope.plans  # noqa: F401 - fills the registry
from folioscope import tables
from folioscope.functions.folds import hashed_embedding
from folioscope.operators import graph as G
from folioscope.operators import incremental as I
from folioscope.operators import resolve as R
from folioscope.operators import search as S
from folioscope.registry import QUERIES


class Engine:
    """``search``, ``stats`` and ``graph_*`` over a directory of tables; ``run`` gives any registered query."""

    def __init__(self, spark: SparkSession, directory: str, embed=hashed_embedding):  # noqa: ANN001
        self.spark, self.directory, self.embed = spark, directory, embed

    @property
    def entities(self) -> DataFrame:
        return tables.entities(self.spark, self.directory)

    @property
    def relationships(self) -> DataFrame:
        return tables.relationships(self.spark, self.directory)

    @property
    def chunks(self) -> DataFrame:
        return tables.chunks(self.spark, self.directory)

    def run(self, name: str) -> DataFrame:
        return QUERIES[name].plan(self.spark, self.directory)

    def search(self, query: str | list[float], k: int = 5, scopes: list[str] | None = None) -> DataFrame:
        vector = self.embed(query) if isinstance(query, str) else query
        return S.vector_search(self.chunks, vector, k, scopes)

    def hybrid(self, query: str | list[float], scopes: list[str], most: int = 10) -> DataFrame:
        vector = self.embed(query) if isinstance(query, str) else query
        return S.hybrid_search(self.chunks, self.entities, self.relationships, vector, scopes, most)

    def get(self, slug: str, scopes: list[str], first: int = 1, count: int = 200) -> DataFrame:
        return S.page_lines(tables.table(self.spark, self.directory, "documents"), slug, scopes, first, count)

    def stats(self) -> DataFrame:
        return self.run("chunk_stats")

    def graph_stats(self) -> DataFrame:
        return self.run("graph_totals")

    def graph_validate(self) -> DataFrame:
        return self.run("failure_events")

    def graph_god_nodes(self, n: int = 20) -> DataFrame:
        return G.degrees(G.active(self.entities), G.active(self.relationships)).orderBy(F.desc("n_relations"), "label", "id").limit(n)

    def graph_search(self, text: str, hops: int = 2, scopes: list[str] | None = None, most: int | None = 50) -> DataFrame:
        seeds = G.active(self.entities).where(F.contains(F.lower("label"), F.lit(text.lower()))).select(F.col("id").alias("node"), F.lit(0.5).alias("similarity"))
        return G.graph_search(self.entities, self.relationships, seeds, hops, scopes, most)

    def graph_deduplicate(self) -> DataFrame:
        return R.dedup_clusters(R.jaccard_pairs(self.entities), self.entities, self.relationships)

    def graph_deduplicate_rels(self) -> DataFrame:
        return G.active(self.relationships).join(R.conflicting(self.relationships).select("id"), "id", "left_anti")

    def graph_cleanup(self) -> DataFrame:
        return self.run("orphan_relationships")

    def graph_embed_missing(self) -> DataFrame:
        return R.embed_missing(self.entities, self.embed)

    def communities(self, least: int = 5) -> DataFrame:
        return G.communities(self.entities, self.relationships, least)

    def build(self, new_chunks: DataFrame) -> DataFrame:
        """What a build has to do, per document."""
        return I.document_diff(self.chunks, new_chunks)
