"""Queries of entity resolution and of similarity between labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.durable import cut
from folioscope.functions import folds
from folioscope.functions import text as T
from folioscope.functions.constants import ENTITY_TYPES, PRIORITY_EACH, PRIORITY_TYPES, PROMPT_ENTRIES
from folioscope.operators import resolve as R
from folioscope.operators.graph import active
from folioscope.plans.search import ENTITIES, RELATIONS
from folioscope.registry import query
from folioscope.tables import entities, relationships, table

_W = f"WITH {ENTITIES}, {RELATIONS}"
# Fixed values, written out again so that the twin does not share the list of the code.
_STOP = (
    "string_split('der die das ein eine einer eines einem einen des dem den derselbe dieselbe dasselbe und oder aber doch sowie beziehungsweise "
    "von zum zur im am an auf bei in mit nach neben ohne unter ueber vor zwischen durch gegen hinter innerhalb außerhalb seit waehrend "
    "ist sind war wurde hat haben wird werden auch noch mehr nur sehr wie was wo "
    "haus gebaeude einfamilienhaus mehrfamilienhaus wohnhaus gewerbepark buero bueros lokal lokale raum raeume villa hof hofanlage anlage objekt immobilie "
    "grundstueck grundstuecke parzelle parzellen wohnung wohnungen appartment appartement', ' ')"
)
_GERMAN = "replace(replace(replace(replace(lower({0}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
_TOKENS = f"list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace({_GERMAN.format('label')}, 'strasse\\b', 'straße', 'g'), 'str\\.', 'straße', 'g'), '\\bnr\\.', 'nummer', 'g'), '[a-z0-9äöüß]+'), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))))"


@query("label_tokens", f"{_W} SELECT id, array_to_string({_TOKENS}, ' ') AS tokens FROM e", "X4 X5")
def label_tokens(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("id", F.array_join(T.label_tokens("label"), " ").alias("tokens"))


@query("token_jaccard_pairs", f"{_W}, t AS (SELECT id, entity_type, label, {_TOKENS} AS k FROM e WHERE valid_until IS NULL) SELECT a.id AS a, b.id AS b, round(CASE WHEN a.label = b.label THEN 1.0 ELSE len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) END, 6) AS similarity FROM t a JOIN t b ON a.id < b.id AND a.entity_type = b.entity_type WHERE len(a.k) >= 2 AND len(b.k) >= 2 AND (a.label = b.label OR len(list_intersect(a.k, b.k)) >= 2 AND len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) >= 0.66)", "X6 J14 G14")
def token_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.jaccard_pairs(entities(spark, d)).select("a", "b", F.round("similarity", 6).alias("similarity"))


_FUZZY = """words AS (SELECT DISTINCT label, list_distinct(list_filter(string_split_regex(trim(lower(label)), '\\s+'), lambda w: w != '')) AS w FROM {src}),
f AS (SELECT a.label AS a, b.label AS b, greatest(floor(100 * len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))))::INT, CASE WHEN abs(length(a.label) - length(b.label)) > 20 THEN 0 ELSE trunc((1.0 - levenshtein({one}, {two}) / greatest(length(a.label), length(b.label))) * 100)::INT END) AS score FROM words a JOIN words b ON a.label < b.label)"""
# DuckDB counts edits in bytes; letters outside ASCII become one byte each first.
_ONE_BYTE = "translate({0}.label, 'äöüßÄÖÜéèáàâêîôûñçóíú–', '{{|}}~^`@#$%&*+=<>?!;[]_')"
_FUZZY = _FUZZY.replace("{one}", _ONE_BYTE.format("a")).replace("{two}", _ONE_BYTE.format("b"))
_NUMBERS = "list_sort(list_distinct(regexp_extract_all(lower({0}), '\\b(\\d+[a-z]?)\\b', 1)))"
_DIFFER = f"(len({_NUMBERS.format('{0}')}) > 0 AND len({_NUMBERS.format('{1}')}) > 0 AND {_NUMBERS.format('{0}')} != {_NUMBERS.format('{1}')})"


@query("fuzzy_label_pairs", f"{_W}, {_FUZZY.replace('{src}', 'e')} SELECT a, b, score FROM f WHERE score >= 85", "X9 X10 X11 X12 X13 J14")
def fuzzy_label_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.fuzzy_pairs(entities(spark, d).select("label"))


@query("levenshtein_parts", f"SELECT p_partkey, trunc((1.0 - levenshtein(p_name, p_name || ' ' || p_brand) / greatest(length(p_name), length(p_name || ' ' || p_brand))) * 100)::INT AS ratio, trunc((1.0 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))) * 100)::INT AS type_ratio FROM part", "X10")
def levenshtein_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.levenshtein_ratio("p_name", F.concat_ws(" ", "p_name", "p_brand")).alias("ratio"), T.levenshtein_ratio("p_name", "p_type").alias("type_ratio"))


@query("potential_duplicates", f"{_W}, {_FUZZY.replace('{src}', 'e')}, a AS (SELECT id, label, entity_type FROM e WHERE valid_until IS NULL) SELECT x.id AS a, y.id AS b, CASE WHEN x.label = y.label THEN 100 ELSE f.score END AS score FROM a x JOIN a y ON x.id < y.id AND x.entity_type = y.entity_type LEFT JOIN f ON f.a = least(x.label, y.label) AND f.b = greatest(x.label, y.label) WHERE x.label = y.label OR f.score >= 85 AND NOT {_DIFFER.format('f.a', 'f.b')}", "G26 X15 J14")
def potential_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return R.potential_duplicates(entities(spark, d))


@query("address_numbers", f"{_W} SELECT id, array_to_string({_NUMBERS.format('label')}, ' ') AS numbers FROM e", "X15")
def address_numbers(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("id", F.array_join(T.address_numbers("label"), " ").alias("numbers"))


@query("street_addresses", operators="X14")
def street_addresses(spark: SparkSession, d: str) -> DataFrame:
    return folds.apply(entities(spark, d), ["id"], ["label"], lambda l: [(a,)] if (a := folds.street_address(l or "")) else [], "address string")


@query("lcs_ratios", operators="X7 X8")
def lcs_ratios(spark: SparkSession, d: str) -> DataFrame:
    pages = entities(spark, d).where("wiki_page IS NOT NULL").select("id", "label", F.element_at(F.split("wiki_page", "/"), -1).alias("slug"))
    return folds.apply(pages, ["id"], ["label", "slug"], lambda a, b: [(round(folds.lcs_ratio(a or "", b or ""), 6),)], "ratio double")


@query("label_hashes", operators="X26")
def label_hashes(spark: SparkSession, d: str) -> DataFrame:
    return folds.apply(entities(spark, d), ["id"], ["label"], lambda l: [(folds.text_hash31(f"kg:{l}"),)], "hit_id long")


@query("cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) / sqrt(list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(a.embedding, lambda x: x::DOUBLE)) * list_dot_product(list_transform(b.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE))), 4) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) / sqrt(list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(a.embedding, lambda x: x::DOUBLE)) * list_dot_product(list_transform(b.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE))) >= 0.5", "X2 J14 G15")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.cosine_pairs(v, 0.5).select("a", "b", F.round("similarity", 4).alias("similarity"))


_PAIRS = f"t AS (SELECT id, entity_type, label, {_TOKENS} AS k FROM e WHERE valid_until IS NULL), pr AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.id < b.id AND a.entity_type = b.entity_type WHERE len(a.k) >= 2 AND len(b.k) >= 2 AND (a.label = b.label OR len(list_intersect(a.k, b.k)) >= 2 AND len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) >= 0.66))"
_CLUSTERS = f"WITH RECURSIVE {ENTITIES}, {RELATIONS}, {_PAIRS}, u AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), reach AS (SELECT a, a AS z FROM u UNION SELECT reach.a, u.b FROM reach JOIN u ON u.a = reach.z), comp AS (SELECT a AS id, min(z) AS component FROM reach GROUP BY a), deg AS (SELECT comp.id, component, count(DISTINCT r.id) AS n, any_value(replace(e.created_at, 'T', ' ')) AS born FROM comp JOIN e ON e.id = comp.id LEFT JOIN r ON r.valid_until IS NULL AND (r.source_id = comp.id OR r.target_id = comp.id) GROUP BY ALL), best AS (SELECT component, arg_min(id, (-n, born, id)) AS canonical FROM deg GROUP BY 1), cl AS (SELECT id, canonical FROM comp JOIN best USING (component))"


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    e, r = entities(spark, d), relationships(spark, d)
    return R.dedup_clusters(cut(R.jaccard_pairs(e)), e, r)


@query("entity_dedup_clusters", f"{_CLUSTERS} SELECT id, canonical FROM cl", "G15 G16 A8")
def entity_dedup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d)


@query("relationship_redirect", f"{_CLUSTERS} SELECT r.id, coalesce(s.canonical, source_id) AS source_id, coalesce(t.canonical, target_id) AS target_id FROM r LEFT JOIN cl s ON s.id = source_id LEFT JOIN cl t ON t.id = target_id".replace(" t AS (SELECT id, entity_type", " t0 AS (SELECT id, entity_type").replace("FROM t a JOIN t b", "FROM t0 a JOIN t0 b"), "G15 D25")
def relationship_redirect(spark: SparkSession, d: str) -> DataFrame:
    return R.redirected(relationships(spark, d), _clusters(spark, d)).select("id", "source_id", "target_id")


@query("merged_descriptions", f"{_CLUSTERS}, dd AS (SELECT canonical, description, min((e.id != canonical, e.id)) AS ord FROM cl JOIN e USING (id) WHERE description IS NOT NULL GROUP BY ALL) SELECT canonical, string_agg(description, ' | ' ORDER BY ord) AS description FROM dd GROUP BY 1", "A10 G15")
def merged_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return R.merged_descriptions(entities(spark, d), _clusters(spark, d))


_RANK = "CASE {0}.confidence WHEN 'extracted' THEN 3 WHEN 'inferred' THEN 2 ELSE 1 END"
_BY_TYPE = "tr AS (SELECT r.id, s.entity_type AS source_id, t.entity_type AS target_id, relation_type, confidence, replace(r.created_at, 'T', ' ') AS at FROM r JOIN e s ON s.id = source_id JOIN e t ON t.id = target_id WHERE r.valid_until IS NULL)"


@query("relationship_conflicts", f"{_W}, {_BY_TYPE} SELECT DISTINCT x.id, x.source_id, x.target_id FROM tr x JOIN tr y ON x.source_id = y.source_id AND x.target_id = y.target_id AND x.relation_type = y.relation_type AND (x.at, x.id) < (y.at, y.id) AND {_RANK.format('x')} <= {_RANK.format('y')}", "G24 J5")
def relationship_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Over relationships between types, so that triples repeat as they do after redirects."""
    e = entities(spark, d).select("id", "entity_type")
    r = relationships(spark, d)
    typed = r.join(e.select(F.col("id").alias("source_id"), F.col("entity_type").alias("s")), "source_id").join(e.select(F.col("id").alias("target_id"), F.col("entity_type").alias("t")), "target_id")
    return R.conflicting(typed.withColumn("source_id", F.col("s")).withColumn("target_id", F.col("t"))).select("id", "source_id", "target_id")


@query("confidence_upgrade", f"{_W}, n AS (SELECT id, CASE WHEN length(relation_type) % 2 = 0 THEN 'extracted' ELSE 'weak' END AS confidence FROM r), x AS (SELECT r.id, r.confidence AS old, n.confidence AS new, CASE WHEN r.confidence = 'extracted' THEN 3 WHEN r.confidence = 'inferred' THEN 2 WHEN r.confidence = 'weak' THEN 1 ELSE 0 END AS ro, CASE WHEN n.confidence = 'extracted' THEN 3 ELSE 1 END AS rn FROM r JOIN n USING (id)) SELECT id, CASE WHEN old IS NULL OR rn > ro THEN new ELSE old END AS confidence FROM x", "G28 K2")
def confidence_upgrade(spark: SparkSession, d: str) -> DataFrame:
    r = relationships(spark, d)
    new = r.select("id", F.when(F.length("relation_type") % 2 == 0, "extracted").otherwise("weak").alias("confidence"))
    return R.upgraded(r, new)


@query("label_resolution", f"{_W} SELECT lower(label) AS label_key, arg_max(id, (replace(updated_at, 'T', ' '), id)) AS id FROM e GROUP BY 1", "G29")
def label_resolution(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).groupBy(F.lower("label").alias("label_key")).agg(F.max_by("id", F.struct(F.translate("updated_at", "T", " "), F.col("id"))).alias("id"))


@query("registry_seed", f"{_W}, x AS (SELECT id, label, entity_type, row_number() OVER (PARTITION BY lower(label) ORDER BY label, id) AS rn FROM e) SELECT id, label, entity_type FROM x WHERE rn = 1", "S14 W1 K12")
def registry_seed(spark: SparkSession, d: str) -> DataFrame:
    first = entities(spark, d).groupBy(F.lower("label")).agg(F.min(F.struct("label", "id", "entity_type")).alias("r"))
    return first.select("r.id", "r.label", "r.entity_type")


_PROMPT = f"""{_W}, o AS (SELECT id, label, entity_type, row_number() OVER (ORDER BY lower(label), label, id) AS k FROM e),
x AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY k) AS rn FROM (SELECT *, list_position(['PERSON', 'PROPERTY', 'ORGANIZATION', 'LOCATION'], entity_type) AS t FROM o) WHERE t > 0),
chosen AS (SELECT *, row_number() OVER (ORDER BY t, rn) AS position FROM x WHERE rn <= 10 AND (t < 4 OR rn <= greatest(1, 30 - (SELECT count(*) FROM x WHERE t < 4 AND rn <= 10)))),
rest AS (SELECT *, row_number() OVER (ORDER BY k) + (SELECT count(*) FROM chosen) AS position FROM o WHERE id NOT IN (SELECT id FROM chosen))
SELECT entity_type, label, id, position::INT AS position FROM chosen UNION ALL SELECT entity_type, label, id, position::INT FROM rest WHERE position <= 30"""


@query("registry_prompt", _PROMPT, "W3 G36")
def registry_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Known entities for a prompt: ten of each priority type, in order of the registry, then others up to 30.

    A priority type that comes after the room is used up still brings one entity.
    """
    e = entities(spark, d).select("id", "label", "entity_type", F.struct(F.lower("label").alias("l"), "label", "id").alias("k"))
    by = Window.partitionBy("entity_type").orderBy("k")
    first = [r for t in [e.where(F.col("entity_type").isin(*PRIORITY_TYPES)).withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= PRIORITY_EACH).orderBy("rn").collect()] for r in t]
    chosen: list = []
    for kind in PRIORITY_TYPES:
        room = max(1, PROMPT_ENTRIES - len(chosen))
        chosen += [r for r in first if r["entity_type"] == kind][:room]
    if len(chosen) < PROMPT_ENTRIES:
        held = {r["id"] for r in chosen}
        chosen += [r for r in e.orderBy("k").limit(2 * PROMPT_ENTRIES).collect() if r["id"] not in held][: PROMPT_ENTRIES - len(chosen)]
    return spark.createDataFrame([(r["entity_type"], r["label"], r["id"], i) for i, r in enumerate(chosen, 1)], "entity_type string, label string, id string, position int")


@query("entity_resolution", operators="G13 J15 G14")
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Labels of entities that arrived later, as probes against the others."""
    e = entities(spark, d)
    late = F.substring("created_at", 1, 4) >= "2024"
    probes = e.where(late).select(F.col("label").alias("probe_label"), F.upper("entity_type").alias("probe_type"))
    return R.resolve(probes, e.where(~late))


@query("embed_missing", operators="G33 G34")
def embed_missing(spark: SparkSession, d: str) -> DataFrame:
    return R.embed_missing(entities(spark, d)).select("id", F.size("embedding").alias("dim"))


@query("entity_type_check", f"{_W} SELECT id, entity_type, upper(trim(entity_type)) AS fixed_type, list_contains({list(ENTITY_TYPES)}, entity_type) AS known FROM e", "F3 K4")
def entity_type_check(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("id", "entity_type", F.upper(F.trim("entity_type")).alias("fixed_type"), F.col("entity_type").isin(*ENTITY_TYPES).alias("known"))
