"""Entity resolution: candidate pairs, clusters, canonical rows, redirects and conflicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.durable import cut
from folioscope.functions import text as T
from folioscope.functions.constants import DEDUP_JACCARD, FUZZY_CROSS_TYPE, FUZZY_SAME_TYPE
from folioscope.operators.components import connected_components
from folioscope.operators.graph import active, confidence_rank, ends


def shared_token_pairs(labels: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, shared): pairs of labels with at least ``least`` common tokens, and the number of them.

    ``labels``: (label, tokens). Of n tokens, two labels that share two must share one of the n - 1 rarest
    of each (the prefix filter), so the most frequent token of a label is never joined on.
    """
    tokens = labels.select("label", F.explode("tokens").alias("token"))
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(frequency, "token").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"))
    prefix = ranked.select("label", F.explode(F.slice(F.col("r.token"), F.lit(1), F.greatest(F.size("r") - (least - 1), F.lit(0)))).alias("token"))
    x, y = prefix.select(F.col("label").alias("a"), "token"), prefix.select(F.col("label").alias("b"), "token")
    met = x.join(y, "token").where("a < b").select("a", "b").distinct()
    l = labels.select("label", "tokens")
    both = met.join(l.select(F.col("label").alias("a"), F.col("tokens").alias("ta")), "a").join(l.select(F.col("label").alias("b"), F.col("tokens").alias("tb")), "b")
    return both.withColumn("shared", F.size(F.array_intersect("ta", "tb"))).where(F.col("shared") >= least)


def jaccard_pairs(entities: DataFrame, threshold: float = DEDUP_JACCARD) -> DataFrame:
    """(a, b, similarity): active entities of one type whose labels share two tokens and reach the threshold."""
    e = active(entities).select("id", "entity_type", "label")
    labels = e.select("label").distinct().withColumn("tokens", T.label_tokens("label")).where(F.size("tokens") >= 2)
    pairs = shared_token_pairs(labels).withColumn("similarity", T.jaccard("ta", "tb")).where(F.col("similarity") >= threshold).select("a", "b", "similarity")
    return _expand(e, pairs, labels.select("label"), "similarity", same_type=True)


def _expand(e: DataFrame, pairs: DataFrame, equal: DataFrame, name: str, same_type: bool, full: Column | None = None) -> DataFrame:
    """Pairs of distinct labels back to pairs of ids; equal labels score ``full``."""
    both = pairs.unionByName(equal.select(F.col("label").alias("a"), F.col("label").alias("b"), (full if full is not None else F.lit(1.0)).alias(name)))
    x = e.select(F.col("label").alias("a"), F.col("id").alias("ia"), F.col("entity_type").alias("xa"))
    y = e.select(F.col("label").alias("b"), F.col("id").alias("ib"), F.col("entity_type").alias("xb"))
    joined = both.join(x, "a").join(y, "b").where(F.col("ia") != F.col("ib"))
    if same_type:
        joined = joined.where("xa = xb")
    return joined.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), name).distinct()


def fuzzy_pairs(labels: DataFrame, least: int = FUZZY_SAME_TYPE, q: int = 3) -> DataFrame:
    """(a, b, score): pairs of distinct labels whose fuzzy score reaches ``least``.

    The score is the larger of token overlap and edit ratio. For overlap, a prefix filter on tokens; for
    the edit ratio, at most (1 - least/100) of the characters may be edited, which leaves q-grams in common:
    labels meet under one of their rarest q-grams, one more than the edits can destroy.
    """
    l = labels.where(F.length("label") > 0).select("label").distinct()
    by_token = l.withColumn("tokens", T.word_set("label"))
    allowed = F.floor(F.length("label") * (100 - least) / 100 / (least / 100)).cast("int")
    padded = F.concat(F.lit("\u0001"), "label", F.lit("\u0002"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda i: F.substring(padded, i, F.lit(q))))
    listed_tokens = by_token.select("label", F.explode("tokens").alias("key"), F.size("tokens").alias("n"))
    listed_grams = l.where(F.length("label") > 1).select("label", F.explode(grams).alias("key"), allowed.alias("n"))
    edits = F.floor(F.greatest("la", "lb") * (100 - least) / 100)
    # Each branch verifies what it stands for, before any other work on the pair.
    by_tokens = _met(listed_tokens, F.col("n") - F.ceil(F.col("n") * least / 100) + 1, F.lit(True)).where(T.token_overlap("a", "b") >= least)
    near = _met(listed_grams, F.col("n") * q + 1, F.abs(F.col("la") - F.col("lb")) <= F.least(edits, F.lit(20)))
    by_edits = near.where(T.levenshtein_ratio("a", "b") >= least)
    return by_tokens.unionByName(by_edits).distinct().withColumn("score", T.fuzzy_score("a", "b"))


def _met(listed: DataFrame, keep: Column, within: Column) -> DataFrame:
    """Pairs (a, b) of labels of lengths (la, lb) that share one of their ``keep`` rarest keys. ``listed``: (label, key, n)."""
    listed = cut(listed)
    frequency = listed.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    ranked = listed.join(frequency, "key").groupBy("label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("r"))
    prefix = ranked.select("label", F.length("label").alias("size"), F.explode(F.slice(F.col("r.key"), F.lit(1), keep.cast("int"))).alias("key"))
    sides = prefix.select(F.col("label").alias("a"), F.col("size").alias("la"), "key").join(prefix.select(F.col("label").alias("b"), F.col("size").alias("lb"), "key"), "key")
    # Verification is work per pair, not per byte: a stated number of partitions is not coalesced by size.
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The cut also keeps the optimizer from verifying each pair once per key it shares.
    return cut(sides.where(F.col("a") < F.col("b")).where(within).select("a", "b").repartition(parts, "a", "b").distinct())


def potential_duplicates(entities: DataFrame, least: int = FUZZY_SAME_TYPE) -> DataFrame:
    """(a, b, score): active entities of one type with similar labels, unless their house numbers differ."""
    e = active(entities).select("id", "entity_type", "label")
    pairs = fuzzy_pairs(e.select("label"), least).where(~T.addresses_differ("a", "b"))
    return _expand(e, pairs, e.select("label").distinct(), "score", same_type=True, full=F.lit(100))


def cosine_pairs(vectors: DataFrame, threshold: float, block: int = 2000) -> DataFrame:
    """(a, b, similarity): all pairs of (id, embedding) with at least that cosine, in blocks.

    Rows are hashed to blocks, each pair of blocks is one matrix product. Meant for entity vectors; for
    whole collections use an index.
    """
    total = vectors.count()
    blocks = max(1, -(-total // block))
    own = vectors.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    spread = own.select("id", "embedding", "own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).select("id", "embedding", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        ids, home = np.array(group.column("id").to_pylist(), object), group.column("own").to_numpy()
        lists = group.column("embedding").combine_chunks()
        x = lists.values.to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        left, right = np.flatnonzero(home == i), np.flatnonzero(home == j)
        s = x[left] @ x[right].T
        a, b = np.nonzero(s >= threshold)
        keep = ids[left[a]] < ids[right[b]] if i == j else np.ones(len(a), bool)
        a, b = a[keep], b[keep]
        first, second = ids[left[a]], ids[right[b]]
        swap = first > second
        first, second = np.where(swap, second, first), np.where(swap, first, second)
        return pa.Table.from_arrays([pa.array(first.tolist(), group.schema.field("id").type), pa.array(second.tolist(), group.schema.field("id").type), pa.array(s[a, b])], names=["a", "b", "similarity"])

    kind = dict(vectors.dtypes)["id"]
    return spread.groupBy("i", "j").applyInArrow(compare, f"a {kind}, b {kind}, similarity double")


def dedup_clusters(pairs: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(id, canonical): every entity of a match cluster and the one that stands for it.

    Matches are closed transitively; the entity with the most active relationships is canonical, of these
    the oldest, then the smaller id.
    """
    members = connected_components(pairs).select(F.col("node").alias("id"), "component")
    counted = ends(active(relationships)).groupBy(F.col("entity").alias("id")).agg(F.count_distinct("rel_id").alias("n"))
    rated = members.join(counted, "id", "left").join(entities.select("id", F.translate("created_at", "T", " ").alias("born")), "id", "left")
    best = rated.groupBy("component").agg(F.min_by("id", F.struct((-F.coalesce("n", F.lit(0))).alias("n"), F.col("born"), F.col("id"))).alias("canonical"))
    return members.join(best, "component").select("id", "canonical")


def redirected(relationships: DataFrame, clusters: DataFrame) -> DataFrame:
    """Relationships with both ends moved to canonical entities; ids stay, self-loops are kept."""
    moved = clusters.where("id != canonical")
    s = moved.select(F.col("id").alias("source_id"), F.col("canonical").alias("new_source"))
    t = moved.select(F.col("id").alias("target_id"), F.col("canonical").alias("new_target"))
    r = relationships.join(s, "source_id", "left").join(t, "target_id", "left")
    return r.withColumn("source_id", F.coalesce("new_source", "source_id")).withColumn("target_id", F.coalesce("new_target", "target_id")).select(*relationships.columns)


def merged_descriptions(entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """(canonical, description): the different descriptions of a cluster in order of id, joined by `` | ``."""
    d = clusters.join(entities.select("id", "description"), "id").where("description IS NOT NULL")
    first = d.groupBy("canonical", "description").agg(F.min(F.struct((F.col("id") != F.col("canonical")).alias("later"), F.col("id"))).alias("at"))
    return first.groupBy("canonical").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "description"))), lambda x: x["description"]), " | ").alias("description"))


def conflicting(relationships: DataFrame) -> DataFrame:
    """Relationships of one triple that a later one of the same or higher confidence replaces, by a window."""
    seq = [F.translate("created_at", "T", " "), F.col("id")]
    w = Window.partitionBy("source_id", "target_id", "relation_type").orderBy(*seq)
    later = F.max(confidence_rank()).over(w.rowsBetween(1, Window.unboundedFollowing))
    return active(relationships).withColumn("later", later).where(F.col("later") >= confidence_rank()).drop("later")


def upgraded(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old relationships (id, confidence) with the confidence of a new one only where it is strictly higher; unknown ids are added."""
    n = new.groupBy("id").agg(F.max_by("confidence", confidence_rank()).alias("new_confidence"))
    both = old.select("id", "confidence").join(n, "id", "full_outer")
    higher = confidence_rank("new_confidence", 0) > confidence_rank("confidence", 0)
    return both.select("id", F.when(F.col("confidence").isNull() | higher, F.coalesce("new_confidence", "confidence")).otherwise(F.col("confidence")).alias("confidence"))


def fuzzy_matches(probes: DataFrame, known: DataFrame, least: int = FUZZY_SAME_TYPE) -> DataFrame:
    """(probe_label, label, score): a label of ``probes`` and another one of ``known``, both (label), whose fuzzy
    score reaches ``least`` (above 50), unless their house numbers differ.

    Every pair is judged by sketches of its labels where it is met, so only what is left of them is shuffled; all
    that a sketch rejects cannot reach ``least``, and the labels themselves decide about the rest.
    """
    # Sketching and verification are work per label and pair, not per byte: a stated number of partitions is not coalesced by size.
    parts = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, y = cut(_sketched(probes, parts)), cut(_sketched(known, parts))
    met = _met_by_chunks(x, y, least, parts).withColumn("by", F.lit("edits")).unionByName(_met_by_tokens(x, y, least).withColumn("by", F.lit("tokens")))
    met = cut(met.repartition(parts, "xh", "yh").distinct())
    both = met.join(x.select(F.col("h").alias("xh"), F.col("label").alias("probe_label")), "xh").join(y.select(F.col("h").alias("yh"), "label"), "yh")
    # Each pair is verified by what it stands for, before any other work on it.
    reached = F.when(F.col("by") == "tokens", T.token_overlap("probe_label", "label")).otherwise(T.levenshtein_ratio("probe_label", "label")) >= least
    near = both.where(F.col("probe_label") != F.col("label")).where(reached).where(~T.addresses_differ("probe_label", "label")).select("probe_label", "label")
    return cut(near.distinct()).withColumn("score", T.fuzzy_score("probe_label", "label"))


def _bits(hashes: Column, first: int) -> Column:
    """64 bits from ``first`` on, with those set that the hashes name."""
    return F.aggregate(F.filter(hashes, lambda h: (h >= first) & (h < first + 64)), F.lit(0).cast("long"), lambda out, h: out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (h - first).cast("int"))))


def _sketched(labels: DataFrame, parts: int) -> DataFrame:
    """Distinct labels with their hash ``h``, length, pairs of neighbouring characters in 128 bits, tokens in 64 bits, and hash of house numbers (0: none)."""
    padded = F.concat(F.lit("\u0001"), "label", F.lit("\u0002"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("label") + 1), lambda i: F.pmod(F.xxhash64(F.substring(padded, i, F.lit(2))), F.lit(128)))
    numbers = T.address_numbers("label")
    l = labels.where(F.length("label") > 0).select("label").repartition(parts, "label").distinct().withColumn("pairs", pairs).withColumn("tokens", T.word_set("label"))
    return l.select(
        "label", F.xxhash64("label").alias("h"), F.length("label").alias("size"), _bits(F.col("pairs"), 0).alias("low"), _bits(F.col("pairs"), 64).alias("high"),
        F.size("tokens").alias("n"), _bits(F.transform("tokens", lambda w: F.pmod(F.xxhash64(w), F.lit(64))), 0).alias("words"), F.when(F.size(numbers) > 0, F.xxhash64(numbers)).otherwise(F.lit(0)).alias("numbers"),
    )


def _sides(x: DataFrame, y: DataFrame) -> DataFrame:
    """Both sides under their keys, with names in front."""
    named = [d.select("key", *[F.col(c).alias(side + c) for c in d.columns if c != "key"]) for side, d in (("x", x), ("y", y))]
    same = (F.col("xnumbers") == 0) | (F.col("ynumbers") == 0) | (F.col("xnumbers") == F.col("ynumbers"))
    return named[0].join(named[1], "key").where(same)


def _rarest(listed: DataFrame, frequency: DataFrame, keep: Column) -> DataFrame:
    """Of the rows of a label, the ``keep`` whose key is rarest. ``listed``: (key, at) and the columns of the label."""
    own = [c for c in listed.columns if c not in ("key", "at")]
    ranked = listed.join(frequency, "key").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("df", "key", "at"))).alias("r"))
    return ranked.select(*own, F.explode(F.slice("r", F.lit(1), keep.cast("int"))).alias("k")).select(*own, "k.key", "k.at")


def _met_by_chunks(x: DataFrame, y: DataFrame, least: int, parts: int, most: int = 4) -> DataFrame:
    """(xh, yh): labels whose edit ratio may reach ``least``.

    A label of ``y`` is divided into chunks of up to ``most`` characters. An edit destroys one chunk at most, so of
    one more than there can be edits, the rarest, one chunk stands in the other label, moved by no more than the
    edits before it. An edit also changes two pairs of neighbouring characters at most.
    """

    def edits(size: Column) -> Column:
        return F.floor(size * (100 - least) / least).cast("int")

    def width(size: Column) -> Column:
        return F.least(F.lit(most), F.floor(size / (edits(size) + 1)).cast("int"))

    def at(label: str, i: Column, n: Column) -> Column:
        return F.struct(i.alias("at"), F.xxhash64(F.substring(F.col(label), i + 1, n)).alias("key"))

    own = ["h", "size", "low", "high", "numbers"]
    size = F.col("size")
    chunks = F.transform(F.sequence(F.lit(0), F.floor(size / F.col("width")).cast("int") - 1), lambda i: at("label", i * F.col("width"), F.col("width")))
    divided = y.withColumn("width", width(size)).where(edits(size) > 0).select(*own, F.explode(chunks).alias("k")).select(*own, "k.key", "k.at")
    few = _rarest(divided, divided.groupBy("key").agg(F.count(F.lit(1)).alias("df")), edits(size) + 1)
    partners = F.sequence(F.ceil(size * least / 100).cast("int"), F.floor(size * 100 / least).cast("int"))
    widths = F.array_distinct(F.transform(F.filter(partners, lambda s: edits(s) > 0), width))
    grams = F.flatten(F.transform(F.filter(widths, lambda n: n <= size), lambda n: F.transform(F.sequence(F.lit(0), size - n), lambda i: at("label", i, n))))
    all_grams = x.select(*own, F.explode(grams).alias("k")).select(*own, "k.key", "k.at")
    sides = _sides(all_grams.repartition(parts, "key"), few.repartition(parts, "key"))
    most_edits = F.floor(F.greatest("xsize", "ysize") * (100 - least) / 100)
    moved, longer = F.col("xat") - F.col("yat"), F.col("xsize") - F.col("ysize")

    def lost(a: str, b: str) -> Column:
        return F.bit_count(F.col(a + "low").bitwiseAND(F.bitwise_not(b + "low"))) + F.bit_count(F.col(a + "high").bitwiseAND(F.bitwise_not(b + "high")))

    near = sides.where((F.abs(longer) <= 20) & (F.abs(moved) + F.abs(longer - moved) <= most_edits)).where((lost("x", "y") <= 2 * most_edits) & (lost("y", "x") <= 2 * most_edits))
    return near.select("xh", "yh")


def _met_by_tokens(x: DataFrame, y: DataFrame, least: int) -> DataFrame:
    """(xh, yh): labels whose token overlap may reach ``least``, by a prefix filter."""
    own = ["h", "n", "words", "numbers"]
    x, y = (d.select(*own, F.explode(T.word_set("label")).alias("w")).select(*own, F.xxhash64("w").alias("key"), F.lit(0).alias("at")) for d in (x, y))
    frequency = x.select("key").unionAll(y.select("key")).groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    keep = F.col("n") - F.ceil(F.col("n") * least / 100) + 1
    sides = _sides(_rarest(x, frequency, keep), _rarest(y, frequency, keep))
    apart = F.floor(F.least("xn", "yn") * (100 - least) / least)
    return sides.where((F.abs(F.col("xn") - F.col("yn")) <= apart) & (F.bit_count(F.col("xwords").bitwiseXOR(F.col("ywords"))) <= apart)).select("xh", "yh")


def resolve(probes: DataFrame, entities: DataFrame) -> DataFrame:
    """(probe_label, probe_type, entity_id, method): each probe against the known entities, best method first.

    Methods in order: the stable id, the label without case (newest wins), fuzzy in the same type under the
    house number guard, fuzzy across types, else new. Scores break ties, then the smaller id.
    """
    p = cut(probes.select("probe_label", "probe_type").distinct())
    e = cut(entities.select("id", "label", "entity_type", F.translate("updated_at", "T", " ").alias("updated")))
    exact = p.withColumn("id", T.stable_entity_id("probe_type", "probe_label")).join(e.select("id"), "id").select("probe_label", "probe_type", F.lit(0).alias("step"), F.lit(100).alias("score"), "id")
    newest = e.groupBy(F.lower("label").alias("key")).agg(F.max_by("id", F.struct("updated", "id")).alias("id"))
    nocase = p.withColumn("key", F.lower("probe_label")).join(newest, "key").select("probe_label", "probe_type", F.lit(1).alias("step"), F.lit(100).alias("score"), "id")
    # Later methods matter only to probes that no earlier one has found.
    left = p.join(exact.unionByName(nocase).select("probe_label", "probe_type").distinct(), ["probe_label", "probe_type"], "left_anti")
    near = fuzzy_matches(left.select(F.col("probe_label").alias("label")), e.select("label"))
    fuzzy = left.join(near, "probe_label").join(e.groupBy("label", "entity_type").agg(F.min("id").alias("id")), "label")
    same = fuzzy.where("probe_type = entity_type").select("probe_label", "probe_type", F.lit(2).alias("step"), "score", "id")
    cross = fuzzy.where((F.col("probe_type") != F.col("entity_type")) & (F.col("score") >= FUZZY_CROSS_TYPE)).select("probe_label", "probe_type", F.lit(3).alias("step"), "score", "id")
    best = exact.unionByName(nocase).unionByName(same).unionByName(cross).groupBy("probe_label", "probe_type").agg(F.min(F.struct("step", (-F.col("score")).alias("s"), "id")).alias("b"))
    method = F.element_at(F.array(*map(F.lit, ("id", "label", "fuzzy", "fuzzy_cross_type"))), F.col("b.step") + 1)
    return p.join(best, ["probe_label", "probe_type"], "left").select("probe_label", "probe_type", F.col("b.id").alias("entity_id"), F.when(F.col("b").isNull(), F.lit("new")).otherwise(method).alias("method"))


def embed_missing(entities: DataFrame, embed=None) -> DataFrame:  # noqa: ANN001
    """(id, embedding): vectors for labels, one call per distinct label; ``embed`` is any text-to-vector function."""
    from folioscope.functions.folds import hashed_embedding

    work = embed or hashed_embedding
    labels = entities.where("label IS NOT NULL").select("label").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([work(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float32()))], names=["label", "embedding"])

    return entities.select("id", "label").join(labels.mapInArrow(run, "label string, embedding array<float>"), "label").select("id", "embedding")
