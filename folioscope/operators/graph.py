"""The entity graph: degrees, checks, traversal, scores, evidence, exports and communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.durable import cut
from folioscope.functions.constants import CONFIDENCE_RANK, CONFIDENCE_WEIGHT, HOP_DECAY, RATIONALE_RELATIONS, UNKNOWN_CONFIDENCE_WEIGHT
from folioscope.operators.components import label_propagation


def confidence_rank(column: str | Column = "confidence", other: int = 1) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(other)
    for name, rank in CONFIDENCE_RANK.items():
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def confidence_weight(column: str | Column = "confidence") -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(UNKNOWN_CONFIDENCE_WEIGHT)
    for name, weight in CONFIDENCE_WEIGHT.items():
        out = F.when(c == name, F.lit(weight)).otherwise(out)
    return out


def active(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("valid_until").isNull())


def ends(relationships: DataFrame, loops_twice: bool = False) -> DataFrame:
    """(entity, rel_id): each relationship under its ends. A self-loop counts once unless asked otherwise."""
    both = F.array("source_id", "target_id")
    return relationships.select(F.explode(both if loops_twice else F.array_distinct(both)).alias("entity"), F.col("id").alias("rel_id"))


def degrees(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Number of distinct relationships at each entity, 0 included: counting comes before the join."""
    counted = ends(relationships).groupBy("entity").agg(F.count_distinct("rel_id").alias("n"))
    return entities.join(counted, F.col("id") == F.col("entity"), "left").select(*entities.columns, F.coalesce("n", F.lit(0)).alias("n_relations"))


def orphans(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    return entities.join(ends(relationships).select("entity"), F.col("id") == F.col("entity"), "left_anti")


def broken(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relationships of which an end has no row."""
    ids = entities.select("id").distinct()
    missing = ends(relationships).join(ids, F.col("entity") == F.col("id"), "left_anti").select(F.col("rel_id")).distinct()
    return relationships.join(missing, F.col("id") == F.col("rel_id"), "left_semi")


def within(rows: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows whose validity, where it is known, begins at or after ``since`` and ends by ``until``."""
    if since:
        rows = rows.where(F.col("valid_from").isNull() | (F.col("valid_from") >= since))
    if until:
        rows = rows.where(F.col("valid_until").isNull() | (F.translate("valid_until", "T", " ") <= until))
    return rows


def undirected(relationships: DataFrame) -> DataFrame:
    """(parent, node, rel_id, confidence, relation_type) in both directions; self-loops lead nowhere."""
    r = relationships.where("source_id != target_id")
    forth = r.select(F.col("source_id").alias("parent"), F.col("target_id").alias("node"), F.col("id").alias("rel_id"), "confidence", "relation_type")
    back = r.select(F.col("target_id").alias("parent"), F.col("source_id").alias("node"), F.col("id").alias("rel_id"), "confidence", "relation_type")
    return forth.unionByName(back)


def traverse(seeds: DataFrame, relationships: DataFrame, hops: int) -> DataFrame:
    """Breadth-first from ``seeds`` (node, similarity): (node, hop, similarity, confidence, rel_id, path).

    The first hop that reaches a node wins; among its parents the one over the surest edge, then the more
    similar, then the smaller. ``path`` holds the nodes from the seed on. Hops are clamped to 1..5. Each
    hop is one join and one aggregation; visited nodes are left out by an anti join.
    """
    edges = cut(undirected(relationships))
    seed = seeds.groupBy("node").agg(F.max("similarity").alias("similarity"))
    reached = cut(seed.select("node", F.lit(0).alias("hop"), "similarity", F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("string").alias("rel_id"), F.array("node").alias("path")))
    frontier = reached
    for hop in range(1, max(1, min(5, hops)) + 1):
        step = frontier.select(F.col("node").alias("parent"), "similarity", "path").join(edges, "parent").join(reached.select("node"), "node", "left_anti")
        rank = confidence_rank("confidence")
        best = step.groupBy("node").agg(F.min_by(F.struct("similarity", "confidence", "rel_id", "path"), F.struct((-rank).alias("r"), (-F.col("similarity")).alias("s"), F.col("parent"), F.col("rel_id"))).alias("b"))
        frontier = cut(best.select("node", F.lit(hop).alias("hop"), "b.similarity", "b.confidence", "b.rel_id", F.concat("b.path", F.array("node")).alias("path")))
        if frontier.limit(1).count() == 0:
            break
        reached = reached.unionByName(frontier)
    return reached


def path_score(similarity: str | Column, hop: str | Column, confidence: str | Column) -> Column:
    s, h = (F.col(x) if isinstance(x, str) else x for x in (similarity, hop))
    return F.round(F.when(h == 0, s).otherwise(s * F.pow(F.lit(HOP_DECAY), h) * confidence_weight(confidence)), 4)


def graph_search(entities: DataFrame, relationships: DataFrame, seeds: DataFrame, hops: int = 2, scopes: list[str] | None = None, most: int | None = 50) -> DataFrame:
    """Entities around the seeds with score, hop and the labels of the path.

    Scopes are applied to seeds, to what is walked over and to what comes out, so that no label of another
    scope shows up in a path.
    """
    e = entities
    if scopes is not None:
        e = e.where(F.element_at(F.split("wiki_page", "/"), 1).isin(scopes))
        allowed = e.select(F.col("id"))
        seeds = seeds.join(allowed, F.col("node") == F.col("id"), "left_semi")
        relationships = relationships.join(allowed.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(allowed.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    found = traverse(seeds, active(relationships), hops)
    scored = found.withColumn("score", path_score("similarity", "hop", "confidence"))
    named = scored.join(e.select(F.col("id").alias("node"), "label", "entity_type", "wiki_page"), "node")
    out = named.select(F.col("node").alias("id"), "label", "entity_type", "hop", "score", "rel_id", "path")
    return out.orderBy(F.desc("score"), "hop", "id").limit(most) if most else out


def path_text(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, path_text): the labels of each path joined by arrows, by one join over all path nodes."""
    nodes = found.select("id", "score", F.posexplode("path").alias("at", "node"))
    labels = nodes.join(entities.select(F.col("id").alias("node"), "label"), "node", "left")
    inside = labels.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("label", "node").alias("label")))), lambda x: x["label"]).alias("labels"))
    return inside.select("id", F.concat(F.lit("Query → "), F.array_join("labels", " → ")).alias("path_text"))


def neighbourhood(entities: DataFrame, relationships: DataFrame, most: int = 10) -> DataFrame:
    """(id, direction, rank, relation_type, other_id, other_label): at most ``most`` per entity and direction."""
    r = active(relationships)
    labels = entities.select(F.col("id").alias("other_id"), F.col("label").alias("other_label"))
    sides = [r.select(F.col("source_id").alias("id"), F.lit("out").alias("direction"), "relation_type", F.col("target_id").alias("other_id"), F.col("id").alias("rel_id"), "created_at"), r.select(F.col("target_id").alias("id"), F.lit("in").alias("direction"), "relation_type", F.col("source_id").alias("other_id"), F.col("id").alias("rel_id"), "created_at")]
    order = Window.partitionBy("id", "direction").orderBy(F.translate("created_at", "T", " "), "rel_id")
    top = sides[0].unionByName(sides[1]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)  # a limit per group before the shuffle
    return top.join(labels, "other_id").join(entities.select("id"), "id", "left_semi").select("id", "direction", "rank", "relation_type", "other_id", "other_label")


def evidence(relationships: DataFrame, entities: DataFrame, most: int = 200) -> DataFrame:
    """(rel_id, evidence): the source text of a relationship, else the description of a rationale beside its target."""
    r = active(relationships)
    why = r.where(F.col("relation_type").isin(*RATIONALE_RELATIONS)).join(entities.where("entity_type = 'RATIONALE'").select(F.col("id").alias("source_id"), F.col("description").alias("why")), "source_id")
    first = why.where("why IS NOT NULL").groupBy("target_id").agg(F.min_by("why", "id").alias("why"))
    joined = r.join(first, "target_id", "left")
    return joined.select(F.col("id").alias("rel_id"), F.coalesce(F.substring("source_text", 1, most), "why").alias("evidence")).where("evidence IS NOT NULL")


def subgraph(entities: DataFrame, relationships: DataFrame, text: str, least: str = "weak") -> tuple[DataFrame, DataFrame]:
    """Entities that name the text, their neighbours, and the sure enough edges inside that set."""
    seeds = active(entities).where(F.contains(F.lower("label"), F.lit(text.lower())) | F.contains(F.lower("description"), F.lit(text.lower()))).select("id")
    r = active(relationships).where(confidence_rank() >= CONFIDENCE_RANK[least])
    around = undirected(r).join(seeds, F.col("parent") == F.col("id"), "left_semi").select(F.col("node").alias("id"))
    inside = seeds.union(around).distinct()
    nodes = active(entities).join(inside, "id", "left_semi")
    return nodes, _inside(r, nodes.select("id"))


def _inside(relationships: DataFrame, ids: DataFrame) -> DataFrame:
    return relationships.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def full_graph(entities: DataFrame, relationships: DataFrame, least: str = "weak") -> tuple[DataFrame, DataFrame]:
    """Active entities with their number of links (a self-loop counts twice), and active edges between them."""
    links = _inside(active(relationships).where(confidence_rank() >= CONFIDENCE_RANK[least]), active(entities).select("id"))
    counted = ends(links, loops_twice=True).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    nodes = active(entities).join(counted, F.col("id") == F.col("entity"), "left").select("id", "label", "entity_type", F.coalesce("n", F.lit(0)).alias("n_links"))
    return nodes, links


def graph_json(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One JSON text per element of an export: nodes and links as rows, so that no task holds the graph."""
    n = nodes.select(F.lit("node").alias("kind"), F.col("id"), F.to_json(F.struct("id", "label", "entity_type")).alias("json"))
    e = links.select(F.lit("link").alias("kind"), F.col("id"), F.to_json(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation_type").alias("type"))).alias("json"))
    return n.unionByName(e)


def communities(entities: DataFrame, relationships: DataFrame, least: int = 5, rounds: int = 8) -> DataFrame:
    """(entity_id, community_id) by weighted label propagation over active edges; small communities are dropped."""
    ids = entities.select("id").distinct()
    edges = _inside(active(relationships), ids).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    found = cut(label_propagation(edges, rounds))
    big = found.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("community")
    return found.join(big, "community", "left_semi").select(F.col("node").alias("entity_id"), F.col("community").alias("community_id"))


def community_summaries(members: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(community_id, n_members, dominant_type, n_inner_links, summary) without a model: the most frequent type, ties by name."""
    typed = members.join(entities.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id")
    counts = typed.groupBy("community_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    dominant = counts.groupBy("community_id").agg(F.sum("n").alias("n_members"), F.min_by("entity_type", F.struct((-F.col("n")).alias("n"), F.col("entity_type"))).alias("dominant_type"))
    m = members.select("entity_id", "community_id")
    inner = active(relationships).join(m.select(F.col("entity_id").alias("source_id"), F.col("community_id").alias("c1")), "source_id").join(m.select(F.col("entity_id").alias("target_id"), F.col("community_id").alias("c2")), "target_id").where("c1 = c2").groupBy(F.col("c1").alias("community_id")).agg(F.count(F.lit(1)).alias("n_inner_links"))
    return dominant.join(inner, "community_id", "left").select("community_id", "n_members", "dominant_type", F.coalesce("n_inner_links", F.lit(0)).alias("n_inner_links"), F.concat("dominant_type", F.lit("-Gruppe")).alias("label"), F.format_string("Community von %d Entities, hauptsächlich %s.", "n_members", "dominant_type").alias("summary"))
