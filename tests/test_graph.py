import random

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import graph as G
from folioscope.operators import incremental as I
from folioscope.operators import resolve as R
from folioscope.operators.components import connected_components

E = "id string, label string, entity_type string, description string, wiki_page string, created_at string, updated_at string, valid_until string"
REL = "id string, source_id string, target_id string, relation_type string, description string, created_at string, valid_from string, valid_until string, confidence string, source_text string"


def entity(i, label="L", kind="CONCEPT", gone=None):
    return (i, label, kind, None, "public/p", "2024-01-01", "2024-01-01", gone)


def relation(i, a, b, confidence="inferred", gone=None, at="2024-01-01", kind="K"):
    return (i, a, b, kind, None, at, None, gone, confidence, None)


def tiny(spark):
    es = [entity(x, x.upper()) for x in "abcdefg"] + [entity("h", "H", gone="2024-02-01")]
    rs = [
        relation("1", "a", "b", "weak"), relation("2", "a", "b", "extracted", kind="M"), relation("3", "b", "c"), relation("4", "c", "d"), relation("5", "d", "d"),
        relation("6", "e", "missing"), relation("7", "a", "c", gone="2024-02-02"), relation("8", "c", "h"), relation("9", "h", "f"), relation("10", "d", "a", "weak"),
    ]
    return spark.createDataFrame(es, E), spark.createDataFrame(rs, REL)


def test_degrees_equal_the_disjunctive_join(spark):
    e, r = tiny(spark)
    naive = e.join(r, (r["source_id"] == e["id"]) | (r["target_id"] == e["id"]), "left").groupBy(e["id"]).agg(F.count_distinct(r["id"]).alias("n"))
    assert {x["id"]: x["n"] for x in naive.collect()} == {x["id"]: x["n_relations"] for x in G.degrees(e, r).collect()}


def test_checks(spark):
    e, r = tiny(spark)
    assert {x["id"] for x in G.orphans(e, r).collect()} == {"g"}
    assert {x["id"] for x in G.broken(e, r).collect()} == {"6"}


def test_traverse(spark):
    e, r = tiny(spark)
    seeds = spark.createDataFrame([("a", 0.9)], "node string, similarity double")
    found = {x["node"]: x for x in G.traverse(seeds, G.active(r), 3).collect()}
    assert {n: x["hop"] for n, x in found.items()} == {"a": 0, "b": 1, "d": 1, "c": 2, "h": 3}
    assert found["b"]["rel_id"] == "2" and found["b"]["path"] == ["a", "b"]
    found = G.graph_search(e, r, seeds, 5, None, 10).collect()
    assert [x["id"] for x in found][0] == "a" and all(x["hop"] <= 5 for x in found)
    text = {x["id"]: x["path_text"] for x in G.path_text(G.graph_search(e, r, seeds, 2), e).collect()}
    assert text["b"] == "Query → A → B"
    assert G.graph_search(e, r, seeds, 2, ["private"]).count() == 0
    nothing = spark.createDataFrame([], "node string, similarity double")
    assert G.traverse(nothing, r, 2).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    expected = {x: root(x) for x in parent}
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == expected
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_conflicts_equal_the_self_join(spark):
    rng = random.Random(2)
    rows = [relation(str(i), rng.choice("ab"), rng.choice("cd"), rng.choice(["extracted", "inferred", "weak", None]), at=f"2024-01-{i % 27 + 1:02d}") for i in range(200)]
    r = spark.createDataFrame(rows, REL)
    rank = {"extracted": 3, "inferred": 2}
    key = lambda x: (x[5], x[0])
    naive = {x[0] for x in rows for y in rows if x[1:4] == y[1:4] and key(x) < key(y) and rank.get(x[8], 1) <= rank.get(y[8], 1)}
    assert {x["id"] for x in R.conflicting(r).collect()} == naive


def test_clusters_are_transitive(spark):
    e, r = tiny(spark)
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    clusters = {x["id"]: x["canonical"] for x in R.dedup_clusters(pairs, e, r).collect()}
    assert set(clusters) == {"a", "b", "c"} and len(set(clusters.values())) == 1
    moved = R.redirected(r, spark.createDataFrame(list(clusters.items()), "id string, canonical string"))
    assert moved.count() == r.count()


def test_fuzzy_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    base = ["Müllordner Grönhausen", "Garten plan Tarnitz", "a b c d", "x", "Straße 5", "Eleonore Dabögäbach"]
    labels = sorted({"".join(ch for ch in rng.choice(base) if rng.random() > 0.06) + rng.choice(["", " x", "!"]) for _ in range(120)} - {""})
    l = spark.createDataFrame([(x,) for x in labels], "label string")
    everything = l.select(F.col("label").alias("a")).crossJoin(l.select(F.col("label").alias("b"))).where("a < b").withColumn("score", T.fuzzy_score("a", "b")).where("score >= 85")
    assert {tuple(x) for x in R.fuzzy_pairs(l).collect()} == {tuple(x) for x in everything.collect()}


def test_fuzzy_goldens(spark):
    rows = [("", "a"), ("a", "a"), ("b a", "a b"), ("a", "a" * 30), (" ".join(f"w{i}" for i in range(20)), " ".join(f"w{i}" for i in range(17)))]
    df = spark.createDataFrame(rows, "a string, b string")
    out = [tuple(x) for x in df.select(T.fuzzy_score("a", "b"), T.fuzzy_bound("a", "b"), T.fuzzy_score("b", "a")).collect()]
    assert [x[0] for x in out] == [0, 100, 100, 0, 85]
    assert all(x[1] >= x[0] if x[0] >= 85 else True for x in out) and all(x[0] == x[2] for x in out)


def test_address_guard(spark):
    df = spark.createDataFrame([("Musterweg 5", "Musterweg 7"), ("Musterweg 5", "Musterweg"), ("Musterweg 5a", "musterweg 5A")], "a string, b string")
    assert [x[0] for x in df.select(T.addresses_differ("a", "b")).collect()] == [True, False, False]


def test_resolution(spark):
    known = spark.createDataFrame([entity("k1", "Bürgerstiftung Hasselgrund", "ORGANIZATION"), entity("k2", "Musterweg 5", "PROPERTY")], E)
    probes = spark.createDataFrame([("bürgerstiftung hasselgrund", "ORGANIZATION"), ("Bürgerstiftung Haselgrund", "ORGANIZATION"), ("Musterweg 7", "PROPERTY"), ("Neu", "CONCEPT")], "probe_label string, probe_type string")
    got = {x["probe_label"]: (x["entity_id"], x["method"]) for x in R.resolve(probes, known).collect()}
    assert got["bürgerstiftung hasselgrund"] == ("k1", "label") and got["Bürgerstiftung Haselgrund"] == ("k1", "fuzzy")
    assert got["Musterweg 7"] == (None, "new") and got["Neu"] == (None, "new")


def test_fuzzy_matches_equal_all_pairs(spark):
    rng = random.Random(4)
    base = ["Müllordner Grönhausen", "Garten plan Tarnitz", "a b c d", "x", "", "Straße 5, Tarnitz", "Straße 7, Tarnitz", "aaaaaa aaaaaa", "Hans Dabögäbach", "Dabögäbach Hans", "Nach Angabe wird der Beleg für 12 ausdrücklich gelöscht " * 2, "w1 w2 w3 w4 w5 w6 w7 w8", "w8 w7 w6 w5 w4 w3 w2", "𝒜𝒷𝒸𝒹ef"]

    def typed(text):
        return "".join(rng.choice(["", ch + ch, "z"]) if rng.random() < 0.05 else ch for ch in text) + rng.choice(["", "", " x", "!"])

    x, y = (spark.createDataFrame([(v,) for v in sorted({typed(rng.choice(base)) for _ in range(150)} | {n * "b" for n in range(1, 45)} | {n * "b" + c for n in (4, 6, 12) for c in "cde"})], "label string") for _ in range(2))
    everything = x.select(F.col("label").alias("a")).crossJoin(y.select(F.col("label").alias("b"))).where("a != b").withColumn("score", T.fuzzy_score("a", "b"))
    naive = {tuple(v) for v in everything.where("score >= 85").where(~T.addresses_differ("a", "b")).collect()}
    assert len(naive) > 500 and {tuple(v) for v in R.fuzzy_matches(x, y).collect()} == naive
    assert {tuple(v) for v in R.fuzzy_matches(x, y, 70).collect()} == {tuple(v) for v in everything.where("score >= 70").where(~T.addresses_differ("a", "b")).collect()}


def test_resolution_shuffles_no_chance_meetings(spark):
    rng = random.Random(5)
    labels = ["Gebäudeversicherung Nr. " + "".join(rng.choice("0123456789") for _ in range(6)) for _ in range(1000)]
    known = spark.createDataFrame([entity(f"k{i}", x, "DOCUMENT") for i, x in enumerate(labels[:500])], E)
    probes = spark.createDataFrame([(x, "DOCUMENT") for x in labels[500:]], "probe_label string, probe_type string")
    status, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = status.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    assert {x["method"] for x in R.resolve(probes, known).collect()} == {"new"}
    assert sum(n for stage, n in written().items() if stage not in before) < 60 * len(labels)


def test_incremental(spark):
    c = "scope string, kind string, ref string, chunk_idx int, content string"
    old = spark.createDataFrame([("p", "w", "a", 0, "x"), ("p", "w", "a", 1, "y"), ("p", "w", "b", 0, "z"), ("p", "w", "d", 0, "q")], c)
    new = spark.createDataFrame([("p", "w", "a", 0, "y"), ("p", "w", "a", 1, "x"), ("p", "w", "b", 0, "z"), ("p", "w", "c", 0, "q")], c)
    state = {x["ref"]: x["state"] for x in I.document_diff(old, new).collect()}
    assert state == {"a": "changed", "b": "unchanged", "c": "new", "d": "deleted"}
    assert {x["ref"]: x["state"] for x in I.document_diff(old, new, ordered=False).collect()}["a"] == "unchanged"
    free = {x["row_id"]: x["free_slug"] for x in I.collision_free(spark.createDataFrame([("s", 1), ("s", 2), ("t", 3)], "slug string, row_id int"), spark.createDataFrame([("s",)], "slug string")).collect()}
    assert free == {1: "s-1", 2: "s-2", 3: "t"}
    rows = [("a", 1), ("a", 2), ("a-1", 3), ("a", 4), ("a-1", 5), ("a-1-1", 6)]
    free = {x["row_id"]: x["free_slug"] for x in I.collision_free(spark.createDataFrame(rows, "slug string, row_id int"), spark.createDataFrame([("a-2",)], "slug string")).collect()}
    assert free == {1: "a", 2: "a-1", 3: "a-1-1", 4: "a-3", 5: "a-1-2", 6: "a-1-1-1"}
