"""Queries of incremental builds, registers, slugs, links and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import incremental as I
from folioscope.operators.graph import active
from folioscope.plans.chunking import pages
from folioscope.plans.search import CHUNKS, ENTITIES, RELATIONS
from folioscope.registry import query
from folioscope.tables import chunks, entities, relationships, table

_OLD = "o AS (SELECT * FROM c WHERE length(ref) % 7 != 0), n AS (SELECT * REPLACE (CASE WHEN length(ref) % 5 = 0 THEN content || '.' ELSE content END AS content) FROM c WHERE length(ref) % 11 != 0)"
_SIG = "so AS (SELECT scope, kind, ref, list(content ORDER BY chunk_idx) AS s FROM o GROUP BY ALL), sn AS (SELECT scope, kind, ref, list(content ORDER BY chunk_idx) AS s FROM n GROUP BY ALL)"


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = chunks(spark, d)
    new = c.where(F.length("ref") % 11 != 0).withColumn("content", F.when(F.length("ref") % 5 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content")))
    return c.where(F.length("ref") % 7 != 0), new


@query("incremental_diff", f"WITH {CHUNKS}, {_OLD}, {_SIG} SELECT coalesce(so.scope, sn.scope) AS scope, coalesce(so.kind, sn.kind) AS kind, coalesce(so.ref, sn.ref) AS ref, CASE WHEN so.s IS NULL THEN 'new' WHEN sn.s IS NULL THEN 'deleted' WHEN so.s = sn.s THEN 'unchanged' ELSE 'changed' END AS state FROM so FULL JOIN sn ON so.scope = sn.scope AND so.kind = sn.kind AND so.ref = sn.ref", "K1 A7 U5 R2")
def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    return I.document_diff(*_old_new(spark, d))


@query("upsert_replace", f"WITH {CHUNKS}, {_OLD} SELECT id, content_hash, content FROM n UNION ALL SELECT id, content_hash, content FROM o WHERE id NOT IN (SELECT id FROM n)", "K2")
def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    cols = ["id", "content_hash", "content"]
    return I.upsert(old.select(*cols), new.select(*cols), ["id"])


@query("upsert_ignore", f"WITH {CHUNKS}, {_OLD} SELECT id, length(content) AS n_chars FROM o UNION ALL SELECT id, length(content) FROM n WHERE id NOT IN (SELECT id FROM o)", "K2")
def upsert_ignore(spark: SparkSession, d: str) -> DataFrame:
    old, new = (x.select("id", F.length("content").cast("long").alias("n_chars")) for x in _old_new(spark, d))
    return I.upsert(old, new, ["id"], replace=False)


@query("unique_migration", f"WITH {CHUNKS} SELECT id, scope, kind, ref, chunk_idx FROM c", "K3 A6")
def unique_migration(spark: SparkSession, d: str) -> DataFrame:
    return I.latest_per_key(table(spark, d, "chunks").select("id", "scope", "kind", "ref", "chunk_idx"), ["scope", "kind", "ref", "chunk_idx"])


@query("schema_migration", "SELECT id, NULL::VARCHAR AS embedding_model, confidence FROM (SELECT DISTINCT * FROM relationships)", "K4 K5")
def schema_migration(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = I.migrated(relationships(spark, d), {"embedding_model": "string", "confidence": "string"}, set(), "add_model")
    return rows.select("id", "embedding_model", "confidence")


_BODY = "regexp_replace(text, '(?s)^---\\n(.*?)\\n---\\n?', '')"
_PAGES = f"p AS (SELECT CASE WHEN contains(ref, '/') THEN ref ELSE scope || '/' || ref END AS wiki_page, max(substr(sha256({_BODY}), 1, 16)) AS body_hash FROM documents WHERE kind = 'wiki' GROUP BY 1)"


def _page_state(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.contains("ref", F.lit("/")), F.col("ref")).otherwise(F.concat_ws("/", "scope", "ref"))
    return pages(spark, d).groupBy(name.alias("wiki_page")).agg(F.max(F.substring(F.sha2("body", 256), 1, 16)).alias("body_hash"))


@query("page_state_diff", f"WITH {_PAGES} SELECT coalesce(p.wiki_page, g.wiki_page) AS wiki_page, CASE WHEN g.wiki_page IS NULL THEN 'new' WHEN p.wiki_page IS NULL THEN 'deleted' WHEN p.body_hash = g.body_hash THEN 'unchanged' ELSE 'changed' END AS state FROM p FULL JOIN graph_page_state g ON p.wiki_page = g.wiki_page", "G30 F19 U5")
def page_state_diff(spark: SparkSession, d: str) -> DataFrame:
    p = _page_state(spark, d)
    g = table(spark, d, "graph_page_state").select("wiki_page", F.col("body_hash").alias("known"))
    state = F.when(F.col("known").isNull(), "new").when(F.col("body_hash").isNull(), "deleted").when(F.col("known") == F.col("body_hash"), "unchanged").otherwise("changed")
    return p.join(g, "wiki_page", "full_outer").select("wiki_page", state.alias("state"))


@query("page_exclusive_entities", f"WITH {ENTITIES} SELECT entity_id, min(wiki_page) AS wiki_page FROM entity_pages GROUP BY 1 HAVING count(DISTINCT wiki_page) = 1", "J8 G30")
def page_exclusive_entities(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "entity_pages").groupBy("entity_id").agg(F.count_distinct("wiki_page").alias("n"), F.min("wiki_page").alias("wiki_page"))
    return by.where("n = 1").select("entity_id", "wiki_page")


@query("discarded_relations", f"WITH {ENTITIES}, {RELATIONS} SELECT r.id, CASE WHEN s.id IS NULL AND t.id IS NULL THEN 'both ends unknown' WHEN s.id IS NULL THEN 'source unknown' ELSE 'target unknown' END AS reason, wiki_page AS page_ref FROM (SELECT id, source_id, target_id, r.wiki_page FROM r) r LEFT JOIN e s ON s.id = source_id LEFT JOIN e t ON t.id = target_id WHERE s.id IS NULL OR t.id IS NULL".replace("wiki_page AS page_ref", "r.wiki_page AS page_ref"), "K16 G28")
def discarded_relations(spark: SparkSession, d: str) -> DataFrame:
    ids = entities(spark, d).select("id")
    r = relationships(spark, d).select("id", "source_id", "target_id", "wiki_page")
    s = ids.select(F.col("id").alias("source_id"), F.lit(True).alias("s"))
    t = ids.select(F.col("id").alias("target_id"), F.lit(True).alias("t"))
    j = r.join(s, "source_id", "left").join(t, "target_id", "left").where("s IS NULL OR t IS NULL")
    reason = F.when(F.col("s").isNull() & F.col("t").isNull(), "both ends unknown").when(F.col("s").isNull(), "source unknown").otherwise("target unknown")
    return j.select("id", reason.alias("reason"), F.col("wiki_page").alias("page_ref"))


@query("wiki_index", f"SELECT doc_id, ref, substr({_BODY}, 1, 500) AS preview, length({_BODY}) AS n_chars FROM documents WHERE kind = 'wiki'", "K10 S2")
def wiki_index(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("doc_id", "ref", F.substring("body", 1, 500).alias("preview"), F.length("body").cast("long").alias("n_chars"))


_SOURCES = "s AS (SELECT doc_id, ref, split_part(ref, '-', 1) AS source_id FROM documents WHERE kind = 'source'), used AS (SELECT ref AS page, unnest(regexp_extract_all(regexp_extract(text, '(?m)^sources: \\[(.*)\\]$', 1), '[0-9a-f]{12}')) AS source_id FROM documents WHERE kind = 'wiki')"


def _source_use(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    s = docs.where("kind = 'source'").select("doc_id", "ref", F.element_at(F.split("ref", "-"), 1).alias("source_id"))
    listed = F.regexp_extract("text", r"(?m)^sources: \[(.*)\]$", 1)
    used = docs.where("kind = 'wiki'").select(F.col("ref").alias("page"), F.explode(F.regexp_extract_all(listed, F.lit("[0-9a-f]{12}"), F.lit(0))).alias("source_id"))
    return s, used


@query("metadata_status", f"WITH {_SOURCES} SELECT s.doc_id, min(page) AS target_page, min(page) IS NOT NULL AS distilled FROM s LEFT JOIN used USING (source_id) GROUP BY s.doc_id", "K11 J16 S6")
def metadata_status(spark: SparkSession, d: str) -> DataFrame:
    s, used = _source_use(spark, d)
    first = used.groupBy("source_id").agg(F.min("page").alias("target_page"))
    return s.join(first, "source_id", "left").select("doc_id", "target_page", F.col("target_page").isNotNull().alias("distilled"))


@query("unprocessed_sources", f"WITH {_SOURCES} SELECT doc_id, ref FROM s WHERE source_id NOT IN (SELECT source_id FROM used)", "F19")
def unprocessed_sources(spark: SparkSession, d: str) -> DataFrame:
    s, used = _source_use(spark, d)
    return s.join(used, "source_id", "left_anti").select("doc_id", "ref")


@query("missing_sources", f"WITH {_SOURCES} SELECT DISTINCT page, source_id FROM used WHERE source_id NOT IN (SELECT source_id FROM s)", "S6 J16 Q-2")
def missing_sources(spark: SparkSession, d: str) -> DataFrame:
    s, used = _source_use(spark, d)
    return used.join(s.select("source_id"), "source_id", "left_anti").select("page", "source_id").distinct()


@query("large_pages", f"SELECT doc_id, ref, length({_BODY}) AS n_chars FROM documents WHERE kind = 'wiki' AND length({_BODY}) >= 2000", "F11 D-7")
def large_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("doc_id", "ref", F.length("body").cast("long").alias("n_chars")).where("n_chars >= 2000")


@query("next_split_slug", "SELECT scope, root, root || '-' || (1 + greatest(1, max(n))) AS next_slug FROM (SELECT scope, CASE WHEN regexp_matches(s, '^.+-\\d+$') THEN regexp_extract(s, '^(.+)-\\d+$', 1) ELSE s END AS root, coalesce(try_cast(nullif(regexp_extract(s, '-(\\d+)$', 1), '') AS BIGINT), 1) AS n FROM (SELECT scope, split_part(ref, '/', -1) AS s FROM documents WHERE kind = 'wiki')) GROUP BY scope, root", "A17")
def next_split_slug(spark: SparkSession, d: str) -> DataFrame:
    """The next free number of each family of pages: the root is what stands before ``-N``, and numbers begin at 2."""
    slug = F.element_at(F.split("ref", "/"), -1)
    numbered = slug.rlike(r"^.+-\d+$")
    root = F.when(numbered, F.regexp_extract(slug, r"^(.+)-\d+$", 1)).otherwise(slug)
    n = F.coalesce(F.when(numbered, F.regexp_extract(slug, r"-(\d+)$", 1).try_cast("long")), F.lit(1).cast("long"))
    highest = pages(spark, d).groupBy("scope", root.alias("root")).agg(F.max(n).alias("n"))
    return highest.select("scope", "root", F.concat("root", F.lit("-"), (F.greatest("n", F.lit(1)) + 1).cast("string")).alias("next_slug"))


@query("companion_pick", f"SELECT scope, arg_min(ref, (length({_BODY}), ref, doc_id)) AS ref FROM documents WHERE kind = 'wiki' GROUP BY scope", "A16")
def companion_pick(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).groupBy("scope").agg(F.min_by("ref", F.struct(F.length("body"), F.col("ref"), F.col("doc_id"))).alias("ref"))


_FOLDER = "f AS (SELECT doc_id, scope || '/' || coalesce(lower(trim(source)), 'none') || '/' || kind AS path FROM documents)"


@query("folder_rollup", f"WITH {_FOLDER}, x AS (SELECT path, string_split(path, '/') AS p FROM f), y AS (SELECT array_to_string(p[1:k], '/') AS folder, k AS depth, k = len(p) AS direct FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM x)) SELECT folder, depth::INT AS depth, count(*) FILTER (direct) AS n_direct, count(*) AS n_total FROM y GROUP BY ALL", "D-5 D-6 J17 A14")
def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    return I.folder_rollup(_folders(spark, d)).select("folder", "depth", "n_direct", "n_total")


def _folders(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("/", "scope", F.coalesce(F.lower(F.trim("source")), F.lit("none")), "kind")
    return table(spark, d, "documents").select(path.alias("path"), F.col("doc_id").cast("string").alias("slug"), F.sha2("text", 256).alias("body_hash"), "lang")


@query("rollup_changed", f"WITH f AS (SELECT lang, scope || '/' || coalesce(lower(trim(source)), 'none') || '/' || kind AS path FROM documents), x AS (SELECT string_split(path, '/') AS p FROM f WHERE lang IS NULL) SELECT DISTINCT array_to_string(p[1:k], '/') AS folder FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM x)", "D-5 D-6")
def rollup_changed(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a language were edited since the last roll-up."""
    now = _folders(spark, d)
    before = now.withColumn("body_hash", F.when(F.col("lang").isNull(), F.lit("old")).otherwise(F.col("body_hash")))
    return I.changed_rollups(I.folder_rollup(before), I.folder_rollup(now)).select("folder")


@query("rollup_blocked", "WITH l AS (SELECT scope, min(fetched_at::DATE) AS first FROM documents WHERE kind = 'source' AND fetched_at IS NOT NULL GROUP BY 1) SELECT doc_id FROM documents d JOIN l USING (scope) WHERE kind = 'wiki' AND fetched_at::DATE >= first", "J18 Q-3")
def rollup_blocked(spark: SparkSession, d: str) -> DataFrame:
    """Pages that a leaf of their scope, not younger than they are, holds back: one minimum per scope instead of a range join."""
    docs = table(spark, d, "documents").withColumn("day", F.to_date("fetched_at"))
    first = docs.where("kind = 'source' AND day IS NOT NULL").groupBy("scope").agg(F.min("day").alias("first"))
    return docs.where("kind = 'wiki'").join(F.broadcast(first), "scope").where("day >= first").select("doc_id")  # a row per scope


@query("slugs", "SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(replace(lower(split_part(ref, '/', -1)), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents", "T13 T15")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.slugify(F.element_at(F.split("ref", "/"), -1)).alias("slug"))


@query("accentless_slugs", "SELECT id, regexp_replace(regexp_replace(strip_accents(replace(replace(replace(replace(lower(section), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM chunks WHERE section IS NOT NULL", "T13")
def accentless_slugs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where(F.col("section").isNotNull())
    return c.select("id", T.accentless_slug("section").alias("slug"))


@query("safe_slugs", "SELECT id, CASE WHEN length(s) <= 40 THEN s ELSE regexp_replace(substr(s, 1, 30), '-+$', '') || '--' || substr(sha256(s), 1, 8) END AS slug FROM (SELECT id, replace(lower(ref || '-' || coalesce(section, '')), ' ', '-') AS s FROM chunks)", "T14")
def safe_slugs(spark: SparkSession, d: str) -> DataFrame:
    s = F.replace(F.lower(F.concat("ref", F.lit("-"), F.coalesce("section", F.lit("")))), F.lit(" "), F.lit("-"))
    return table(spark, d, "chunks").select("id", T.safe_slug(s, 40).alias("slug"))


@query("archive_slugs", operators="K9 D-7")
def archive_slugs(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d).select(T.slugify(F.substring(F.element_at(F.split("ref", "/"), -1), 1, 12)).alias("slug"), F.col("doc_id").alias("row_id"))
    return I.collision_free(p, table(spark, d, "documents").where("kind = 'source'").select(T.slugify(F.substring("ref", 1, 12)).alias("slug")))


_LINK = "(SELECT min(l) FROM (SELECT unnest(regexp_extract_all(text, '\\[\\[([a-z0-9-]+)\\]\\]', 1)) AS l FROM documents))"


@query("backlinks", f"WITH t AS (SELECT {_LINK} AS slug) SELECT doc_id, replace(text, '[[' || slug || ']]', '[[' || slug || '-moved]]') AS text FROM documents, t WHERE contains(text, '[[' || slug || ']]')", "T12 D-7")
def backlinks(spark: SparkSession, d: str) -> DataFrame:
    """All four forms of links to a page are rewritten: plain, with alias, with scope, and markdown."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    slug = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([a-z0-9-]+)\]\]"), F.lit(1))).alias("l")).agg(F.min("l")).first()[0]
    new = F.regexp_replace("text", rf"(\[\[(?:[a-z]+/)?){slug}(?=[\]|])", f"$1{slug}-moved")
    new = F.regexp_replace(new, rf"(\]\((?:\.\./)?(?:[a-z]+/)?){slug}(?=(?:\.md)?\))", f"$1{slug}-moved")
    return docs.where(F.contains("text", F.lit(slug))).withColumn("new", new).where("new != text").select("doc_id", F.col("new").alias("text"))


@query("link_targets", "SELECT l AS slug, count(*) AS n_links, count(DISTINCT doc_id) AS n_pages FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\[\\[([a-z0-9-]+)\\]\\]', 1)) AS l FROM documents) GROUP BY 1", "T12 T11")
def link_targets(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([a-z0-9-]+)\]\]"), F.lit(1))).alias("slug"))
    return links.groupBy("slug").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("doc_id").alias("n_pages"))


@query("related_links", "SELECT doc_id, regexp_replace(text, '(?s)\\n*## Siehe auch\\n.*$', '') || chr(10) || chr(10) || '## Siehe auch' || chr(10) || '- [[' || lower(scope) || ']]' || chr(10) AS text FROM documents WHERE kind = 'wiki'", "T11")
def related_links(spark: SparkSession, d: str) -> DataFrame:
    block = F.concat(F.lit("\n\n## Siehe auch\n- [["), F.lower("scope"), F.lit("]]\n"))
    return table(spark, d, "documents").where("kind = 'wiki'").select("doc_id", F.concat(F.regexp_replace("text", r"(?s)\n*## Siehe auch\n.*$", ""), block).alias("text"))


@query("scan_sources", "SELECT doc_id, split_part(ref, '-', 1) AS source_id, regexp_replace(ref, '^[^-]*-', '') AS stem, scope FROM documents WHERE kind = 'source'", "S8 S10 X25")
def scan_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("kind = 'source'").select("doc_id", F.element_at(F.split("ref", "-"), 1).alias("source_id"), F.regexp_replace("ref", "^[^-]*-", "").alias("stem"), "scope")


@query("entity_chunk_mentions", f"WITH {ENTITIES}, l AS (SELECT id AS entity_id, label, wiki_page FROM e WHERE valid_until IS NULL AND wiki_page IS NOT NULL AND length(label) > 3), {CHUNKS} SELECT entity_id, c.id AS chunk_id FROM c JOIN l ON l.wiki_page = c.scope || '/' || c.ref WHERE c.kind = 'wiki' AND contains(lower(content), lower(label))", "D10 T6")
def entity_chunk_mentions(spark: SparkSession, d: str) -> DataFrame:
    e = active(entities(spark, d)).where("wiki_page IS NOT NULL AND length(label) > 3").select(F.col("id").alias("entity_id"), "label", "wiki_page")
    c = chunks(spark, d).where("kind = 'wiki'").select(F.col("id").alias("chunk_id"), F.concat_ws("/", "scope", "ref").alias("wiki_page"), "content")
    return c.join(e, "wiki_page").where(F.contains(F.lower("content"), F.lower("label"))).select("entity_id", "chunk_id")


def _wiki_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("kind = 'wiki'").select(F.col("ref").alias("wiki_page"), "text")


_LINKS = "w AS (SELECT ref, text, regexp_extract(text, '(?m)^title: (.*)$', 1) AS title FROM documents WHERE kind = 'wiki' AND regexp_matches(text, '(?s)^---\\n.*?\\n---(\\n|$)') AND regexp_matches(text, '(?m)^title: \\S')), l AS (SELECT DISTINCT title, unnest(regexp_extract_all(regexp_replace(text, '(?s)^---\\n(.*?)\\n---', ''), '\\[\\[([a-z0-9/-]+)(\\|[^\\]]*)?\\]\\]', 1)) AS slug FROM w)"


@query("graph_build_links", f"WITH {_LINKS} SELECT title AS source, slug AS target FROM l", "G35 G28 T2")
def graph_build_links(spark: SparkSession, d: str) -> DataFrame:
    from folioscope.operators import build as B

    return B.extracted(_wiki_texts(spark, d)).where("relation_type = 'REFERENZIERT'").select("source", "target").distinct()


@query("graph_build_entities", operators="G31 G32 G35 D-1")
def graph_build_entities(spark: SparkSession, d: str) -> DataFrame:
    from folioscope.operators import build as B

    return B.graph_of(B.extracted(_wiki_texts(spark, d)))[0]


@query("graph_build_relations", operators="G31 G32 G28")
def graph_build_relations(spark: SparkSession, d: str) -> DataFrame:
    from folioscope.operators import build as B

    return B.graph_of(B.extracted(_wiki_texts(spark, d)))[1]
