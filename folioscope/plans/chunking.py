"""Queries of chunking, sections, front matter and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import folds
from folioscope.functions import text as T
from folioscope.plans.search import CHUNKS, ENTITIES, RELATIONS
from folioscope.registry import query
from folioscope.tables import chunks, entities, relationships, table

_FRONT = r"(?s)^---\n(.*?)\n---\n?"
_BODY = "regexp_replace(text, '(?s)^---\\n(.*?)\\n---\\n?', '')"


def pages(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, scope, ref, front, body) of the wiki documents."""
    w = table(spark, d, "documents").where("kind = 'wiki'")
    return w.select("doc_id", "scope", "ref", "text", F.regexp_extract("text", _FRONT, 1).alias("front"), F.regexp_replace("text", _FRONT, "").alias("body"))


@query("front_matter_split", f"SELECT doc_id, regexp_extract(text, '(?s)^---\\n(.*?)\\n---\\n?', 1) AS front, length({_BODY}) AS body_chars, substr(sha256({_BODY}), 1, 16) AS body_hash FROM documents WHERE kind = 'wiki'", "S1 S2 S3 S5 X25")
def front_matter_split(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("doc_id", "front", F.length("body").cast("long").alias("body_chars"), F.substring(F.sha2("body", 256), 1, 16).alias("body_hash"))


@query("front_matter_fields", "SELECT doc_id, regexp_extract(text, '(?m)^title: (.*)$', 1) AS title, regexp_extract(text, '(?m)^scope: (.*)$', 1) AS scope, regexp_extract(text, '(?m)^created: (.*)$', 1) AS created FROM documents WHERE kind = 'wiki' AND regexp_matches(text, '(?s)^---\\n.*?\\n---(\\n|$)') AND regexp_matches(text, '(?m)^title: ')", "S4 S3")
def front_matter_fields(spark: SparkSession, d: str) -> DataFrame:
    def fields(text: str) -> list[tuple]:
        f, _ = folds.front_matter(text)
        return [(str(f.get("title", "")), str(f.get("scope", "")), str(f.get("created", "")))] if "title" in f else []

    w = table(spark, d, "documents").where("kind = 'wiki'")
    return folds.apply(w, ["doc_id"], ["text"], fields, "title string, scope string, created string")


@query("front_matter_lists", operators="S4 J16 T24")
def front_matter_lists(spark: SparkSession, d: str) -> DataFrame:
    def lists(text: str) -> list[tuple]:
        f, _ = folds.front_matter(text)
        return [(key, i, value) for key in ("topics", "sources") if isinstance(f.get(key), list) for i, value in enumerate(f[key])]

    w = table(spark, d, "documents").where("kind = 'wiki'")
    return folds.apply(w, ["doc_id"], ["text"], lists, "field string, position int, value string")


@query("seed_entities", operators="T24 G28 X25")
def seed_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities that front matter names: the title and sources as documents, topics other than the title as concepts."""

    def seeds(text: str) -> list[tuple]:
        f, _ = folds.front_matter(text)
        title = f.get("title")
        out = [(title, "DOCUMENT")] if isinstance(title, str) and title else []
        out += [(t, "CONCEPT") for t in f.get("topics") or [] if isinstance(f.get("topics"), list) and t != title]
        return out + [(s, "DOCUMENT") for s in f.get("sources") or [] if isinstance(f.get("sources"), list)]

    w = table(spark, d, "documents").where("kind = 'wiki'")
    found = folds.apply(w, ["ref"], ["text"], seeds, "label string, entity_type string")
    return found.distinct().withColumn("id", T.stable_entity_id("entity_type", "label"))


@query("chunk_markdown", operators="T1 T4 F16 X25")
def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    made = folds.apply(pages(spark, d), ["doc_id"], ["body"], lambda b: folds.chunk_markdown(b), "chunk_idx int, section string, content string")
    return made.withColumn("content_hash", F.sha2("content", 256))


@query("section_groups", operators="T2 T3")
def section_groups(spark: SparkSession, d: str) -> DataFrame:
    return folds.apply(table(spark, d, "documents"), ["doc_id"], ["text"], lambda b: folds.section_groups(b), "part int, label string, body string")


@query("greedy_pack", operators="T4 W5")
def greedy_pack(spark: SparkSession, d: str) -> DataFrame:
    return folds.apply(table(spark, d, "documents"), ["doc_id"], ["text"], lambda t: enumerate(folds.split_long(t or "")), "part int, piece string")


@query("semantic_split", operators="T5 G34")
def semantic_split(spark: SparkSession, d: str) -> DataFrame:
    return folds.apply(table(spark, d, "documents"), ["doc_id"], ["text"], lambda t: folds.semantic_split(t), "part int, piece string")


@query("large_document_cuts", operators="T7 D-2")
def large_document_cuts(spark: SparkSession, d: str) -> DataFrame:
    return folds.apply(table(spark, d, "documents"), ["doc_id"], ["text"], lambda t: enumerate(folds.large_cuts(t or "", 6000)), "part int, piece string")


@query("head_tail_trim", "SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE text[1:496] || chr(10) || chr(10) || '[…]' || chr(10) || chr(10) || right(text, 496) END AS trimmed, CASE WHEN length(text) <= 3000 THEN text ELSE text[1:1000] || chr(10) || chr(10) || '[…]' || chr(10) || chr(10) || text[(length(text) - 1000) // 2 + 1:(length(text) - 1000) // 2 + 1000] || chr(10) || chr(10) || '[…]' || chr(10) || chr(10) || right(text, 1000) END AS sampled, length(text) > 3000 AS truncated FROM documents", "T8 T9")
def head_tail_trim(spark: SparkSession, d: str) -> DataFrame:
    return folds.apply(table(spark, d, "documents"), ["doc_id"], ["text"], lambda t: [(folds.head_tail(t, 1000), *folds.head_middle_tail(t, 3000, 1000))], "trimmed string, sampled string, truncated boolean")


_WS = "' ' || chr(9) || chr(10) || chr(13)"


@query("source_sentences", f"""WITH {ENTITIES},
s AS (SELECT id, description AS t, list_filter(string_split(regexp_replace(description, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: contains(lower(x), lower(label))) AS m FROM e WHERE description IS NOT NULL),
f AS (SELECT id, CASE WHEN len(m) > 0 THEN trim(m[1], {_WS}) ELSE t END AS f FROM s), h AS (SELECT id, f, f[1:200] AS h, position(' ' IN reverse(f[1:200])) AS p FROM f)
SELECT id, CASE WHEN length(f) <= 200 THEN trim(f, {_WS}) ELSE rtrim(CASE WHEN p > 0 AND 200 - p > 150 THEN h[1:200 - p] ELSE h END, {_WS}) || '…' END AS sentence FROM h""", "T6")
def source_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentence of each description that names its entity."""
    return entities(spark, d).where("description IS NOT NULL").select("id", T.source_sentence("description", "label").alias("sentence"))


@query("kg_snippets", f"WITH {ENTITIES}, {RELATIONS}, o AS (SELECT source_id AS id, relation_type || ' → ' || t.label AS line, row_number() OVER (PARTITION BY source_id ORDER BY r.id) AS rn FROM r JOIN e t ON t.id = target_id WHERE r.valid_until IS NULL) SELECT e.id, e.label || coalesce(': ' || string_agg(line, '; ' ORDER BY rn), '') AS snippet FROM e LEFT JOIN o ON o.id = e.id AND rn <= 4 GROUP BY e.id, e.label", "T23")
def kg_snippets(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e, r = entities(spark, d), relationships(spark, d).where("valid_until IS NULL")
    lines = r.join(e.select(F.col("id").alias("target_id"), F.col("label").alias("t")), "target_id").select(F.col("source_id"), F.col("id").alias("rel"), F.concat("relation_type", F.lit(" → "), "t").alias("line"))
    top = lines.withColumn("rn", F.row_number().over(Window.partitionBy("source_id").orderBy("rel"))).where("rn <= 4")
    text = top.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]), "; ").alias("lines"))
    return e.join(text, F.col("id") == F.col("source_id"), "left").select("id", F.concat("label", F.when(F.col("lines").isNotNull(), F.concat(F.lit(": "), "lines")).otherwise("")).alias("snippet"))


@query("answers_parsed", operators="T18 T19 T20 D-4")
def answers_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Answers as models give them, made of the events: fenced, with trailing commas, cut off."""
    e = table(spark, d, "events")
    plain = F.to_json(F.struct("event_id", "event_type", F.col("props").alias("note")))
    answer = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(F.col("event_id") % 4 == 1, F.regexp_replace(plain, r"\}$", ",}")).when(F.col("event_id") % 4 == 2, F.concat(F.lit("Here it is: "), plain, F.lit(" Done."))).otherwise(F.expr("left(to_json(struct(event_id, event_type)), 20)"))
    parsed = folds.apply(e.withColumn("answer", answer), ["event_id"], ["answer"], lambda a: [folds.parse_answer(a)], "answer_json string, reason string")
    return parsed.select("event_id", F.get_json_object("answer_json", "$.event_type").alias("event_type"), "reason")


@query("auto_rules", operators="T21 E-3 K19")
def auto_rules(spark: SparkSession, d: str) -> DataFrame:
    """The automatic section of one prompt per event type, from its most frequent users."""
    rules = table(spark, d, "events").groupBy("event_type").agg(F.array_sort(F.slice(F.array_sort(F.collect_set(F.concat(F.lit("watch user "), F.col("user_id").cast("string")))), 1, 3)).alias("rules"))
    return folds.apply(rules, ["event_type"], ["rules"], lambda r: [(folds.auto_section("Extract relations.", r),)], "prompt string")


@query("event_payloads", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", "S7 T18")
def event_payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("chunk_order", f"WITH {CHUNKS} SELECT id, scope, kind, ref, chunk_idx, row_number() OVER (PARTITION BY scope, kind, ref ORDER BY chunk_idx)::INT - 1 AS dense_idx FROM c", "W5 D14")
def chunk_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("scope", "kind", "ref").orderBy("chunk_idx")
    return chunks(spark, d).select("id", "scope", "kind", "ref", "chunk_idx", (F.row_number().over(w) - 1).alias("dense_idx"))


