"""From pages to the graph: extraction, identity, upsert, and the whole build in one call."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import folds
from folioscope.functions import text as T
from folioscope.operators import incremental as I
from folioscope.operators.resolve import upgraded

Triple = tuple[str, str, str, str, str, str]  # source label and type, target label and type, relation, confidence


def extract_structure(text: str) -> list[Triple]:
    """A stand-in for a model: what front matter and links of a page say for certain, else by inference."""
    fields, body = folds.front_matter(text)
    title = fields.get("title")
    if not isinstance(title, str) or not title:
        return []
    lists = {k: v for k, v in fields.items() if isinstance(v, list)}
    out: list[Triple] = [(title, "DOCUMENT", t, "CONCEPT", "BEZOGEN_AUF", "extracted") for t in lists.get("topics", []) if t != title]
    out += [(title, "DOCUMENT", s, "DOCUMENT", "STAMMT_VON", "extracted") for s in lists.get("sources", [])]
    out += [(title, "DOCUMENT", s, "DOCUMENT", "REFERENZIERT", "inferred") for s in re.findall(r"\[\[([a-z0-9/-]+)(?:\|[^\]]*)?\]\]", body)]
    return list(dict.fromkeys(out))


def extracted(pages: DataFrame, extractor: Callable[[str], list[Triple]] = extract_structure) -> DataFrame:
    """(wiki_page, source, source_type, target, target_type, relation_type, confidence) of pages (wiki_page, text)."""
    return folds.apply(pages, ["wiki_page"], ["text"], lambda t: extractor(t or ""), "source string, source_type string, target string, target_type string, relation_type string, confidence string")


def graph_of(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relationships and the pages of each entity. Ids are hashes, so equal triples of all pages meet."""
    ends = triples.select("wiki_page", F.explode(F.array(F.struct(F.col("source").alias("label"), F.col("source_type").alias("entity_type")), F.struct(F.col("target").alias("label"), F.col("target_type").alias("entity_type")))).alias("e")).select("wiki_page", "e.label", "e.entity_type")
    named = ends.withColumn("id", T.stable_entity_id("entity_type", "label"))
    entities = named.groupBy("id").agg(F.min("label").alias("label"), F.min("entity_type").alias("entity_type"), F.min("wiki_page").alias("wiki_page"))
    pages = named.select(F.col("id").alias("entity_id"), "wiki_page").distinct()
    keyed = triples.select(T.stable_entity_id("source_type", "source").alias("source_id"), T.stable_entity_id("target_type", "target").alias("target_id"), "relation_type", "confidence", "wiki_page").withColumn("id", T.relationship_id("source_id", "target_id", "relation_type"))
    sure = F.when(F.col("confidence") == "extracted", 0).when(F.col("confidence") == "inferred", 1).otherwise(2)
    relations = keyed.groupBy("id", "source_id", "target_id", "relation_type").agg(F.min_by("confidence", sure).alias("confidence"), F.min("wiki_page").alias("wiki_page"))
    return entities, relations, pages


def update(old: tuple[DataFrame, DataFrame], pages: DataFrame, state: DataFrame, extractor: Callable[[str], list[Triple]] = extract_structure) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships after the pages whose body differs from ``state`` (wiki_page, body_hash) were read.

    Only those pages are extracted. Confidence rises where it is strictly higher; nothing is lowered.
    """
    changed = pages.withColumn("h", F.substring(F.sha2("text", 256), 1, 16)).join(state.select("wiki_page", F.col("body_hash").alias("h")), ["wiki_page", "h"], "left_anti")
    entities, relations, _ = graph_of(extracted(changed.select("wiki_page", "text"), extractor))
    raised = upgraded(old[1].select("id", "confidence"), relations.select("id", "confidence"))
    columns = ["id", "source_id", "target_id", "relation_type", "wiki_page"]
    both = I.upsert(old[1].select(*columns), relations.select(*columns), ["id"], replace=False)
    return I.upsert(old[0], entities.select(*old[0].columns), ["id"], replace=False), both.join(raised, "id").select(*columns, "confidence")


def past_deadline(now: dt.datetime, deadline: str | None) -> bool:
    """Whether the local time is past ``HH:MM``; a text that is no time sets no deadline."""
    m = re.fullmatch(r"\s*([01]?\d|2[0-3]):([0-5]\d)\s*", deadline or "")
    return bool(m) and (now.hour, now.minute) >= (int(m[1]), int(m[2]))


def update_prompt(title: str, body: str, source_id: str, source: str, most: int = 25000) -> str:
    """The text a distilling model gets to bring a page up to date."""
    return f"# Page: {title}\n\n{folds.head_tail(body, most)}\n\n# New source {source_id}\n\n{source}\n\nAnswer with one JSON object: action, title, body_md, related_slugs."
