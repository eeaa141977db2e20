"""Queries over the entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import graph as G
from folioscope.plans.search import ENTITIES, RELATIONS
from folioscope.registry import query
from folioscope.tables import entities, relationships, table

_W = f"WITH {ENTITIES}, {RELATIONS}"
_RANK = "CASE confidence WHEN 'extracted' THEN 3 WHEN 'inferred' THEN 2 ELSE 1 END"


@query("graph_totals", f"{_W} SELECT count(*) AS n_entities, count(*) FILTER (valid_until IS NULL) AS n_active, count(DISTINCT wiki_page) AS n_pages, (SELECT count(*) FROM r) AS n_relations, (SELECT count(*) FROM r WHERE valid_until IS NULL) AS n_active_relations FROM e", "A2 F4")
def graph_totals(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d).agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("valid_until").isNull()).alias("n_active"), F.count_distinct("wiki_page").alias("n_pages"))
    r = relationships(spark, d).agg(F.count(F.lit(1)).alias("n_relations"), F.count_if(F.col("valid_until").isNull()).alias("n_active_relations"))
    return e.crossJoin(r)  # one row each


@query("graph_stats_by_type", f"{_W} SELECT upper(entity_type) AS entity_type, count(*) AS n, count(*) FILTER (valid_until IS NULL) AS n_active FROM e GROUP BY 1", "A2")
def graph_stats_by_type(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).groupBy(F.upper("entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("valid_until").isNull()).alias("n_active"))


@query("graph_stats_by_relation", f"{_W} SELECT relation_type, count(*) AS n, count(*) FILTER (valid_until IS NULL) AS n_active FROM r GROUP BY 1", "A2")
def graph_stats_by_relation(spark: SparkSession, d: str) -> DataFrame:
    return relationships(spark, d).groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("valid_until").isNull()).alias("n_active"))


@query("confidence_distribution", f"{_W} SELECT coalesce(confidence, 'none') AS confidence, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r WHERE valid_until IS NULL GROUP BY 1", "A2 X23")
def confidence_distribution(spark: SparkSession, d: str) -> DataFrame:
    counted = G.active(relationships(spark, d)).groupBy(F.coalesce("confidence", F.lit("none")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("total")))).select("confidence", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("god_nodes", f"{_W} SELECT e.id, e.label, count(DISTINCT r.id) AS n_relations FROM e LEFT JOIN r ON (r.source_id = e.id OR r.target_id = e.id) AND r.valid_until IS NULL WHERE e.valid_until IS NULL GROUP BY e.id, e.label ORDER BY n_relations DESC, e.label, e.id LIMIT 20", "A3 J3 F4 W7")
def god_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(G.active(entities(spark, d)), G.active(relationships(spark, d))).select("id", "label", "n_relations").orderBy(F.desc("n_relations"), "label", "id").limit(20)


@query("top_connected", f"{_W} SELECT e.id, e.entity_type, count(*) AS n_relations FROM e JOIN r ON (r.source_id = e.id OR r.target_id = e.id) GROUP BY e.id, e.entity_type", "J4 J3")
def top_connected(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(entities(spark, d), relationships(spark, d)).where("n_relations > 0").select("id", "entity_type", "n_relations")


@query("link_counts", f"{_W}, a AS (SELECT id FROM e WHERE valid_until IS NULL), k AS (SELECT * FROM r WHERE valid_until IS NULL AND source_id IN (FROM a) AND target_id IN (FROM a)) SELECT a.id, count(x.n) AS n_links FROM a LEFT JOIN (SELECT source_id AS n FROM k UNION ALL SELECT target_id FROM k) x ON x.n = a.id GROUP BY a.id", "A5 J9 G18")
def link_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.full_graph(entities(spark, d), relationships(spark, d))[0].select("id", "n_links")


@query("graph_orphans", f"{_W} SELECT id, label, entity_type FROM e WHERE id NOT IN (SELECT source_id FROM r) AND id NOT IN (SELECT target_id FROM r)", "J7 A2")
def graph_orphans(spark: SparkSession, d: str) -> DataFrame:
    return G.orphans(entities(spark, d), relationships(spark, d)).select("id", "label", "entity_type")


@query("broken_refs", f"{_W} SELECT r.id, source_id, target_id FROM r LEFT JOIN e s ON s.id = source_id LEFT JOIN e t ON t.id = target_id WHERE s.id IS NULL OR t.id IS NULL", "J6")
def broken_refs(spark: SparkSession, d: str) -> DataFrame:
    return G.broken(entities(spark, d), relationships(spark, d)).select("id", "source_id", "target_id")


@query("self_loops", f"{_W} SELECT id, source_id AS entity_id, relation_type FROM r WHERE source_id = target_id", "G26")
def self_loops(spark: SparkSession, d: str) -> DataFrame:
    return relationships(spark, d).where("source_id = target_id").select("id", F.col("source_id").alias("entity_id"), "relation_type")


@query("orphan_relationships", f"{_W} SELECT id, coalesce(valid_until, 'cleaned') AS valid_until FROM r WHERE source_id NOT IN (SELECT id FROM e) OR target_id NOT IN (SELECT id FROM e)", "G25")
def orphan_relationships(spark: SparkSession, d: str) -> DataFrame:
    return G.broken(entities(spark, d), relationships(spark, d)).select("id", F.coalesce("valid_until", F.lit("cleaned")).alias("valid_until"))


_EVENTS = f"""{_W},
orphan AS (SELECT 'orphan' AS event, 'low' AS severity, id AS subject FROM e WHERE id NOT IN (SELECT source_id FROM r) AND id NOT IN (SELECT target_id FROM r)),
brokn AS (SELECT 'broken_ref', 'high', id FROM r WHERE source_id NOT IN (SELECT id FROM e) OR target_id NOT IN (SELECT id FROM e)),
loops AS (SELECT 'self_loop', 'medium', id FROM r WHERE source_id = target_id),
weak AS (SELECT 'confidence_imbalance', 'medium', relation_type FROM r WHERE valid_until IS NULL GROUP BY relation_type HAVING count(*) FILTER (confidence = 'weak') > 0.4 * count(*)),
ev AS (FROM orphan UNION ALL FROM brokn UNION ALL FROM loops UNION ALL FROM weak)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    e, r = entities(spark, d), relationships(spark, d)
    weak = G.active(r).groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "weak").alias("w")).where("w > 0.4 * n")

    def rows(name: str, severity: str, part: DataFrame, subject: str) -> DataFrame:
        return part.select(F.lit(name).alias("event"), F.lit(severity).alias("severity"), F.col(subject).alias("subject"))

    return rows("orphan", "low", G.orphans(e, r), "id").unionByName(rows("broken_ref", "high", G.broken(e, r), "id")).unionByName(rows("self_loop", "medium", r.where("source_id = target_id"), "id")).unionByName(rows("confidence_imbalance", "medium", weak, "relation_type"))


@query("failure_events", f"{_EVENTS} SELECT event, severity, subject FROM ev", "G27 G26 J6 J7")
def failure_events(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d)


@query("graph_metrics", f"{_EVENTS}, n AS (SELECT count(*) AS n_entities FROM e) SELECT count(*) AS n_failures, count(*) FILTER (severity = 'high') AS n_high, round(count(*) FILTER (event = 'orphan') / max(n_entities), 6) AS orphan_rate, round((SELECT count(*) FILTER (confidence = 'weak') / count(*) FROM r WHERE valid_until IS NULL), 6) AS weak_rate, count(*) FILTER (severity = 'high') = 0 AS healthy FROM ev, n", "A11 G26 E-4")
def graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d).agg(F.count(F.lit(1)).alias("n_failures"), F.count_if(F.col("severity") == "high").alias("n_high"), F.count_if(F.col("event") == "orphan").alias("n_orphans"))
    n = entities(spark, d).agg(F.count(F.lit(1)).alias("n"))
    w = G.active(relationships(spark, d)).agg(F.round(F.count_if(F.col("confidence") == "weak") / F.count(F.lit(1)), 6).alias("weak_rate"))
    return ev.crossJoin(n).crossJoin(w).select("n_failures", "n_high", F.round(F.col("n_orphans") / F.col("n"), 6).alias("orphan_rate"), "weak_rate", (F.col("n_high") == 0).alias("healthy"))


@query("temporal_filter", f"{_W} SELECT id, valid_from, valid_until FROM r WHERE (valid_from IS NULL OR valid_from >= '2023-06-01') AND (valid_until IS NULL OR replace(valid_until, 'T', ' ') <= '2025-06-30')", "F5")
def temporal_filter(spark: SparkSession, d: str) -> DataFrame:
    return G.within(relationships(spark, d), "2023-06-01", "2025-06-30").select("id", "valid_from", "valid_until")


@query("temporal_tags", f"{_W} SELECT id, CASE WHEN valid_from IS NOT NULL AND valid_until IS NOT NULL THEN '[' || valid_from || ' – ' || valid_until || ']' WHEN valid_from IS NOT NULL THEN '[seit ' || valid_from || ']' WHEN valid_until IS NOT NULL THEN '[bis ' || valid_until || ']' ELSE '' END AS tag FROM r", "F6")
def temporal_tags(spark: SparkSession, d: str) -> DataFrame:
    return relationships(spark, d).select("id", T.temporal_tag("valid_from", "valid_until").alias("tag"))


@query("min_confidence", f"{_W} SELECT id, ({_RANK})::INT AS rank FROM r WHERE valid_until IS NULL AND {_RANK} >= 2", "F8 X23")
def min_confidence(spark: SparkSession, d: str) -> DataFrame:
    return G.active(relationships(spark, d)).select("id", G.confidence_rank().alias("rank")).where("rank >= 2")


@query("scope_rows", f"{_W} SELECT id, wiki_page, split_part(wiki_page, '/', 1) AS scope FROM e WHERE (starts_with(wiki_page, 'family/') OR starts_with(wiki_page, 'public/')) AND NOT starts_with(wiki_page, 'public/spass-')", "F2 F9")
def scope_rows(spark: SparkSession, d: str) -> DataFrame:
    from folioscope.functions.constants import EXCLUDED_PREFIXES

    e = entities(spark, d).where(F.startswith("wiki_page", F.lit("family/")) | F.startswith("wiki_page", F.lit("public/")))
    for prefix in EXCLUDED_PREFIXES:
        e = e.where(~F.startswith("wiki_page", F.lit(prefix)))
    return e.select("id", "wiki_page", T.page_scope("wiki_page").alias("scope"))


_SUB = f"""{_W}, seeds AS (SELECT id FROM e WHERE valid_until IS NULL AND (label ILIKE '%garten%' OR description ILIKE '%garten%')),
k AS (SELECT * FROM r WHERE valid_until IS NULL AND {_RANK} >= 2 ),
ids AS (SELECT id FROM seeds UNION SELECT target_id FROM k JOIN seeds ON source_id = seeds.id UNION SELECT source_id FROM k JOIN seeds ON target_id = seeds.id),
nodes AS (SELECT e.* FROM e WHERE valid_until IS NULL AND id IN (FROM ids))"""


@query("like_seed_search", f"{_SUB} SELECT e.id, e.label FROM e WHERE id IN (FROM seeds)", "F7 G3")
def like_seed_search(spark: SparkSession, d: str) -> DataFrame:
    return G.active(entities(spark, d)).where(F.col("label").ilike("%garten%") | F.col("description").ilike("%garten%")).select("id", "label")


@query("subgraph_nodes", f"{_SUB} SELECT id, label, entity_type FROM nodes", "G17 U1 F7")
def subgraph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.subgraph(entities(spark, d), relationships(spark, d), "garten", "inferred")[0].select("id", "label", "entity_type")


@query("subgraph_links", f"{_SUB} SELECT id, source_id, target_id, relation_type FROM k WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)", "G17 F8 J9")
def subgraph_links(spark: SparkSession, d: str) -> DataFrame:
    return G.subgraph(entities(spark, d), relationships(spark, d), "garten", "inferred")[1].select("id", "source_id", "target_id", "relation_type")


@query("full_graph_links", f"{_W}, a AS (SELECT id FROM e WHERE valid_until IS NULL) SELECT id, source_id, target_id, relation_type FROM r WHERE valid_until IS NULL AND source_id IN (FROM a) AND target_id IN (FROM a)", "G18 J9")
def full_graph_links(spark: SparkSession, d: str) -> DataFrame:
    return G.full_graph(entities(spark, d), relationships(spark, d))[1].select("id", "source_id", "target_id", "relation_type")


@query("graph_json", operators="K15 G17 G18")
def graph_json(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_json(*G.full_graph(entities(spark, d), relationships(spark, d)))


# Traversal. Seeds: the persons on public pages, similarity 1.

_BFS = f"""WITH RECURSIVE {ENTITIES}, {RELATIONS}, seeds AS (SELECT id FROM e WHERE upper(entity_type) = 'EVENT'),
u AS (SELECT source_id AS p, target_id AS n, confidence FROM r WHERE valid_until IS NULL AND source_id != target_id UNION ALL SELECT target_id, source_id, confidence FROM r WHERE valid_until IS NULL AND source_id != target_id),
walk AS (SELECT id AS n, 0 AS hop FROM seeds UNION SELECT u.n, hop + 1 FROM walk JOIN u ON u.p = walk.n WHERE hop < %d),
hops AS (SELECT n, min(hop) AS hop FROM walk GROUP BY n)"""


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where(F.upper("entity_type") == "EVENT").select(F.col("id").alias("node"), F.lit(1.0).alias("similarity"))


@query("bfs_1hop", _BFS % 1 + " SELECT n AS node, hop::INT AS hop FROM hops", "G4 J13")
def bfs_1hop(spark: SparkSession, d: str) -> DataFrame:
    return G.traverse(_seeds(spark, d), G.active(relationships(spark, d)), 1).select("node", "hop")


@query("bfs_3hop", _BFS % 3 + " SELECT n AS node, hop::INT AS hop FROM hops", "G4 J13")
def bfs_3hop(spark: SparkSession, d: str) -> DataFrame:
    return G.traverse(_seeds(spark, d), G.active(relationships(spark, d)), 3).select("node", "hop")


_SCORES = f"""{_BFS % 2}, best AS (SELECT h.n, h.hop, max(CASE u.confidence WHEN 'extracted' THEN 3 WHEN 'inferred' THEN 2 ELSE 1 END) AS top FROM hops h LEFT JOIN hops b ON b.hop = h.hop - 1 LEFT JOIN u ON u.n = h.n AND u.p = b.n WHERE h.hop = 0 OR u.n IS NOT NULL GROUP BY h.n, h.hop)
SELECT n AS node, hop::INT AS hop, top::INT AS edge_rank FROM best WHERE hop > 0"""


@query("bfs_best_edge", _SCORES, "G4 X23")
def bfs_best_edge(spark: SparkSession, d: str) -> DataFrame:
    t = G.traverse(_seeds(spark, d), G.active(relationships(spark, d)), 2).where("hop > 0")
    return t.select("node", "hop", G.confidence_rank("confidence").alias("edge_rank"))


@query("path_scores", f"{_W} SELECT id, round(CASE WHEN h = 0 THEN s ELSE s * pow(0.7, h) * CASE confidence WHEN 'extracted' THEN 1.0 WHEN 'inferred' THEN 0.8 WHEN 'weak' THEN 0.5 ELSE 0.6 END END, 4) AS score FROM (SELECT id, confidence, 0.8001::DOUBLE AS s, length(relation_type) % 4 AS h FROM r)", "G5 X22")
def path_scores(spark: SparkSession, d: str) -> DataFrame:
    r = relationships(spark, d).withColumn("s", F.lit(0.8001)).withColumn("h", F.length("relation_type") % 4)
    return r.select("id", G.path_score("s", "h", "confidence").alias("score"))


@query("graph_search", operators="G2 G3 G4 G5 F10 U2 W8")
def graph_search(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    seeds = G.active(e).where(F.contains(F.lower("label"), F.lit("garten"))).select(F.col("id").alias("node"), F.lit(0.5).alias("similarity"))
    return G.graph_search(e, relationships(spark, d), seeds, 2, ["family", "public"]).select("id", "label", "entity_type", "hop", "score", F.array_join("path", ">").alias("path"))


@query("graph_search_paths", operators="G6 G9")
def graph_search_paths(spark: SparkSession, d: str) -> DataFrame:
    from folioscope.durable import cut

    e = entities(spark, d)
    found = cut(G.graph_search(e, relationships(spark, d), _seeds(spark, d), 2, None, 50))
    return G.path_text(found, e)


@query("entity_neighbourhood", f"{_W}, x AS (SELECT source_id AS id, 'out' AS direction, relation_type, target_id AS other_id, id AS rel_id, created_at FROM r WHERE valid_until IS NULL UNION ALL SELECT target_id, 'in', relation_type, source_id, id, created_at FROM r WHERE valid_until IS NULL), y AS (SELECT *, row_number() OVER (PARTITION BY id, direction ORDER BY replace(created_at, 'T', ' '), rel_id) AS rank FROM x) SELECT y.id, direction, rank::INT AS rank, relation_type, other_id, o.label AS other_label FROM y JOIN e o ON o.id = other_id JOIN e s ON s.id = y.id WHERE rank <= 10", "G8 G10 J1 W2")
def entity_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbourhood(entities(spark, d), relationships(spark, d))


@query("rationale_text", f"{_W}, w AS (SELECT target_id, arg_min(description, r.id) AS why FROM r JOIN e ON e.id = source_id WHERE r.valid_until IS NULL AND relation_type IN ('ERKLÄRT_MIT', 'HINTET_AUF', 'WEGEN') AND e.entity_type = 'RATIONALE' AND e.description IS NOT NULL GROUP BY target_id) SELECT id AS rel_id, coalesce(substr(source_text, 1, 200), why) AS evidence FROM r LEFT JOIN w USING (target_id) WHERE valid_until IS NULL AND coalesce(source_text, why) IS NOT NULL".replace("arg_min(description, r.id)", "arg_min(e.description, r.id)"), "G7 J11")
def rationale_text(spark: SparkSession, d: str) -> DataFrame:
    return G.evidence(relationships(spark, d), entities(spark, d))


# Communities


@query("communities", operators="G20 G21 G16")
def communities(spark: SparkSession, d: str) -> DataFrame:
    return G.communities(entities(spark, d), relationships(spark, d))


@query("community_summaries", operators="G22 A9 G23 J2 J10")
def community_summaries(spark: SparkSession, d: str) -> DataFrame:
    e, r = entities(spark, d), relationships(spark, d)
    return G.community_summaries(G.communities(e, r), e, r)


_MEMBERS = "m AS (SELECT entity_id, wiki_page AS community_id FROM entity_pages)"


@query("community_stats", f"WITH {_MEMBERS} SELECT community_id, count(*) AS n_members FROM m GROUP BY 1 HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 10", "A4 G23")
def community_stats(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "entity_pages").groupBy(F.col("wiki_page").alias("community_id")).agg(F.count(F.lit(1)).alias("n_members"))
    return m.where("n_members >= 5").orderBy(F.desc("n_members"), "community_id").limit(10)


@query("community_inner_links", f"{_W}, {_MEMBERS} SELECT a.community_id, count(*) AS n_links FROM r JOIN m a ON a.entity_id = source_id JOIN m b ON b.entity_id = target_id AND a.community_id = b.community_id WHERE valid_until IS NULL GROUP BY 1", "J2 J10 G23")
def community_inner_links(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "entity_pages")
    a = m.select(F.col("entity_id").alias("source_id"), F.col("wiki_page").alias("community_id"))
    b = m.select(F.col("entity_id").alias("target_id"), F.col("wiki_page").alias("community_id"))
    return G.active(relationships(spark, d)).join(a, "source_id").join(b, ["target_id", "community_id"]).groupBy("community_id").agg(F.count(F.lit(1)).alias("n_links"))


@query("community_types", f"WITH {ENTITIES}, {_MEMBERS}, t AS (SELECT community_id, entity_type, count(*) AS n FROM m JOIN e ON e.id = entity_id GROUP BY ALL) SELECT community_id, sum(n)::BIGINT AS n_members, arg_min(entity_type, (-n, entity_type)) AS dominant_type FROM t GROUP BY 1", "A9 G22 G19")
def community_types(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "entity_pages").select("entity_id", F.col("wiki_page").alias("community_id"))
    counts = m.join(entities(spark, d).select(F.col("id").alias("entity_id"), "entity_type"), "entity_id").groupBy("community_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("community_id").agg(F.sum("n").alias("n_members"), F.min_by("entity_type", F.struct((-F.col("n")).alias("n"), F.col("entity_type"))).alias("dominant_type"))


@query("community_rebuild", f"{_W}, t AS (SELECT max(replace(created_at, 'T', ' ')) AS now FROM r) SELECT count(*) FILTER (id NOT IN (SELECT entity_id FROM entity_pages)) AS n_untracked, (SELECT count(*) FROM r, t WHERE replace(created_at, 'T', ' ')::TIMESTAMP > now::TIMESTAMP - INTERVAL 1 DAY) AS n_new_relations, count(*) FILTER (id NOT IN (SELECT entity_id FROM entity_pages)) > 5 OR (SELECT count(*) FROM r, t WHERE replace(created_at, 'T', ' ')::TIMESTAMP > now::TIMESTAMP - INTERVAL 1 DAY) > 5 AS rebuild FROM e", "A18")
def community_rebuild(spark: SparkSession, d: str) -> DataFrame:
    e, r = entities(spark, d), relationships(spark, d)
    untracked = e.join(table(spark, d, "entity_pages").select(F.col("entity_id").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("n_untracked"))
    at = F.to_timestamp(F.translate("created_at", "T", " "))
    now = r.agg(F.max(at).alias("now"))
    fresh = r.crossJoin(F.broadcast(now)).where(at > F.col("now") - F.expr("INTERVAL 1 DAY")).agg(F.count(F.lit(1)).alias("n_new_relations"))
    return untracked.crossJoin(fresh).withColumn("rebuild", (F.col("n_untracked") > 5) | (F.col("n_new_relations") > 5))
