"""The training-data operators against brute force, round trips and defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import compare
from pyspark.sql import functions as F

from folioscope.llm import covering, encoding, leakage, mixing, names, queries, scans, similar_vectors, splitting, truncation  # noqa: F401
from folioscope.llm.fm_index import FMIndex, suffix_array
from folioscope.llm.vector_graph import VectorGraph
from folioscope.registry import QUERIES

LLM = sorted(n for n, q in QUERIES.items() if q.plan.__module__.startswith("folioscope.llm"))
CHUNK = "id long, scope string, kind string, ref string, section string, chunk_idx int, content string, content_hash string, embedding array<float>"


def chunk(i, content=None, embedding=None, ref="r"):
    return (i, "public", "wiki", ref, None, i if i is not None else 0, content, None, embedding)


def chunks(spark, rows):
    return spark.createDataFrame(rows, CHUNK)


@pytest.mark.parametrize("name", LLM)
def test_query_runs_and_repeats(name, spark, data, duck):
    q = QUERIES[name]
    if q.sql:
        compare(q.plan(spark, data), duck, q.sql)
    else:
        once = sorted(map(str, q.plan(spark, data).collect()))
        assert len(once) > 0 or name == "p3_found"
        if name.endswith("_found"):
            assert len(set(once)) == len(once)


def test_no_query_fails_on_empty_tables(spark, data, tmp_path):
    from folioscope.tables import table

    for name in ("chunks", "documents", "entities", "relationships", "graph_page_state", "eval_items", "mix_targets", "entity_pages"):
        table(spark, data, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in LLM:
        assert QUERIES[name].plan(spark, str(tmp_path)).count() == 0 or name in ("p9_report", "p1_recall"), name


# Similar vectors


def test_graph_recall():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(60, 24))
    x = (centers[rng.integers(0, 60, 3000)] + 0.4 * rng.normal(size=(3000, 24))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    truth = np.argsort(-s, axis=1)[:, :10]
    g = VectorGraph(x)
    ids, sims = g.neighbours_of_all(10)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), truth.tolist(), strict=True)]) >= 0.9
    assert (ids != np.arange(len(x))[:, None]).all()
    q, _ = g.query(x[:100], 11, 64)
    assert np.mean([len((set(a) - {i}) & set(b)) / 10 for i, (a, b) in enumerate(zip(q.tolist(), truth.tolist(), strict=False))]) >= 0.9
    assert VectorGraph(np.zeros((0, 4), np.float32)).query(x[:2, :4], 3, 8)[0].tolist() == [[-1] * 3] * 2
    one = VectorGraph(x[:1]).neighbours_of_all(3)
    assert (one[0] == -1).all()


def test_found_pairs_and_neighbours_against_brute_force(spark, data):
    from folioscope.tables import table

    c = table(spark, data, "chunks")
    rows = [(r["id"], r["embedding"]) for r in c.where(F.size("embedding") == 64).select("id", "embedding").collect()]
    ids = np.array([i for i, _ in rows])
    x = np.array([e for _, e in rows], np.float64)
    n = np.linalg.norm(x, axis=1)
    ids, x = ids[n > 0], x[n > 0] / n[n > 0][:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    near = {i: ids[np.lexsort((ids, -np.round(row, 5)))[:10]].tolist() for i, row in zip(ids.tolist(), s, strict=True)}
    at = {i: k for k, i in enumerate(ids.tolist())}
    truth = {(min(i, j), max(i, j)) for i, js in near.items() for j in js if s[at[i], at[j]] >= 0.9}
    got = {tuple(r) for r in similar_vectors.similar_pairs(c).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and not {p for p in got if s[at[p[0]], at[p[1]]] < 0.8999}
    found = similar_vectors.nearest_for_queries(c, c.where(F.col("id") % 100 == 0)).collect()
    hits = Counter(r["query_id"] for r in found if r["neighbour"] in near[r["query_id"]])
    asked = [i for i in ids.tolist() if i % 100 == 0]
    assert sum(hits[i] for i in asked) >= 0.9 * 10 * len(asked)


@pytest.mark.parametrize("shard,flat", [(5000, 256), (600, 256), (250, 16)])
def test_recall_holds_as_cells_grow(spark, monkeypatch, shard, flat):
    """Few cells, many cells, and a tree with branches; the data have 12 centres and much noise around them."""
    monkeypatch.setattr(similar_vectors, "FLAT", flat)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12, 24))[rng.integers(0, 12, 3000)] + 0.5 * rng.normal(size=(3000, 24))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    queries = c.where("id % 10 = 0")
    exact = similar_vectors.exact_for_queries(c, queries, dim=24, block=700)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit[::10] @ unit.T
    s[np.arange(300), np.arange(0, 3000, 10)] = -2
    assert np.allclose(sorted(r["similarity"] for r in exact.collect()), np.sort(np.sort(-s, axis=1)[:, :10] * -1, axis=None), atol=1e-5)
    found = similar_vectors.nearest_neighbours(c, dim=24, shard=shard).select(F.col("id").alias("query_id"), "similarity")
    r = similar_vectors.recall(found, exact, queries).first()
    assert (r["n_queries"], r["wanted"]) == (300, 3000) and r["met"] >= 0.95 * 3000
    asked = similar_vectors.nearest_for_queries(c, queries, dim=24, shard=shard).select("query_id", "similarity")
    assert similar_vectors.recall(asked, exact, queries).first()["met"] >= 0.95 * 3000


def test_hubs_keep_what_is_nearest():
    """Every point is nearest to one hub; its back-edges are pruned again and again, none is dropped unseen."""
    rng = np.random.default_rng(2)
    x = 0.2 * rng.normal(size=(2000, 16)).astype(np.float32)
    x[:, 0] += 1
    x[0] = np.eye(16, dtype=np.float32)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    ids, sims = VectorGraph(x).neighbours_of_all(10)
    assert (sims >= np.sort(-s, axis=1)[:, 9:10] * -1 - 1e-5).mean() >= 0.95 and set(ids[0]) == set(np.argsort(-s[0])[:10])


def test_vector_cases(spark):
    e = [1.0, 0.0, 0.0, 0.0]
    rows = [chunk(i, embedding=[float(2 + i % 3) * v for v in e]) for i in range(1, 30)]  # copies, scaled
    rows += [chunk(100, embedding=None), chunk(101, embedding=[]), chunk(102, embedding=[0.0] * 4), chunk(103, embedding=[1.0]), chunk(104, embedding=[math.nan, 0.0, 0.0, 1.0]), chunk(105, embedding=[None, 0.0, 0.0, 1.0]), chunk(None, embedding=e), chunk(1, embedding=[2.0 * v for v in e])]
    rows += [chunk(200, embedding=[0.99, 0.1, 0.0, 0.0])]
    got = {tuple(r) for r in similar_vectors.similar_pairs(chunks(spark, rows).withColumn("point", F.lit(1)), dim=4).collect()}
    assert {p for p in got if max(p) < 100} == {(min(a, b), max(a, b)) for a in range(1, 30) for b in [x for x in range(1, 12) if x != a][:10] if a != b}
    assert {p for p in got if max(p) == 200} == {(b, 200) for b in range(1, 11)}
    assert similar_vectors.similar_pairs(chunks(spark, rows[:1]), dim=4).count() == 0


def test_queries_in_a_large_group_get_its_smallest_ids(spark):
    rng = np.random.default_rng(4)
    rows = [chunk(i, embedding=[1.0, 2.0, 0.0, 0.0]) for i in range(1, 601)] + [chunk(1000 + i, embedding=rng.normal(size=4).tolist()) for i in range(600)]
    c = chunks(spark, rows)
    got = similar_vectors.nearest_for_queries(c, c.where("id IN (3, 300, 600)"), dim=4).collect()
    assert {(r["query_id"], r["neighbour"]) for r in got} == {(q, n) for q in (3, 300, 600) for n in [i for i in range(1, 12) if i != q][:10]}


# Near duplicates


def brute_similar(sets, least):
    return {(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= least * len(x | y) - 1e-12}


def test_no_near_duplicate_is_missed(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["der", "die", "und"] * 5
    texts = {}
    for i in range(160):
        if i % 3 == 0 or i < 10:
            words = rng.sample(vocabulary, rng.choice([21, 35, 60, 100, 170]))
        else:
            words = texts[rng.randrange(i)].split()
            words = [w for w in words if rng.random() > 0.06] + [f"x{rng.randrange(99)}" for _ in range(rng.randrange(6))]
            rng.shuffle(words)
        texts[i] = " ".join(words)
    texts[500], texts[501] = texts[0], texts[0].upper()
    sets = {i: set(t.lower().split()) for i, t in texts.items() if len(set(t.lower().split())) >= 20}
    rows = [chunk(i, t) for i, t in texts.items()] + [chunk(900, None), chunk(901, "kurz"), chunk(902, "a " * 5000), chunk(None, texts[1]), chunk(3, texts[3])]
    for limit in (4000, 12):  # the second sends every run to the pass over blocks
        got = [tuple(r) for r in covering.similar_pairs(chunks(spark, rows).withColumn("words", F.lit(0)), run_limit=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_similar(sets, 0.8)


def test_hot_signatures_go_around_the_partitions(spark, monkeypatch):
    """Texts of one template: their common words collide under masks, so that signatures are shared by many."""
    monkeypatch.setattr(covering, "HOT_LEAST", 3)
    rng = random.Random(8)
    texts = {i: " ".join([f"t{k}" for k in range(40)] + [f"v{rng.randrange(60)}" for _ in range(9)]) for i in range(120)}
    sets = {i: set(t.split()) for i, t in texts.items()}
    rows = [chunk(i, t) for i, t in texts.items()]
    base = covering.word_sets(chunks(spark, rows), "id", "content", 20)
    hot = covering.hot_signatures(base.select("set_hash", "words"), 120, 20, 0.8, 5.5, 8)
    assert hot and min(hot.values()) >= 2
    for limit in (8, 4000):
        got = [tuple(r) for r in covering.similar_pairs(chunks(spark, rows), run_limit=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_similar(sets, 0.8)


def test_signature_bytes_and_many_signatures_of_one_text():
    words = np.arange(1, 90_001, dtype=np.uint64)
    doc, _ = covering.batch_signatures(words, np.array([90_000]), 20, 0.8, 5.5)
    assert covering.signature_bytes({90_000: 2}, 20, 0.8, 5.5) == 2 * 36 * len(doc)


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(2)
    for number in range(6):
        c = covering.size_class(number, 20, 0.8, 5.5)
        assert c.radius // c.blocks <= c.rho
        for _ in range(30):
            n = int(rng.integers(c.low, c.high))
            base = rng.integers(0, 2**32, n, dtype=np.uint64)
            gone = int(rng.integers(0, c.radius // 2 + 1))
            other = np.concatenate([base[gone:], rng.integers(0, 2**32, c.radius - gone, dtype=np.uint64)])
            one = covering.class_signatures(base, np.zeros(len(base), np.int64), 1, number, c)
            two = covering.class_signatures(other, np.zeros(len(other), np.int64), 1, number, c)
            assert (one == two).any()


# Leakage


def test_fm_index_against_search():
    rng = np.random.default_rng(3)
    for sigma, n in ((3, 300), (40, 2000), (2, 64)):
        s = rng.integers(0, sigma, n)
        s[-1] = 0
        order = suffix_array(s)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        index = FMIndex(s, sigma, step=4)
        phrases = np.array([s[i : i + 3] for i in range(0, n - 3, 7)])
        phrases = phrases[(phrases > 0).all(axis=1)]
        if not len(phrases):
            continue
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - 2) if (s[i : i + 3] == p).all()]


def test_leak_cases(spark):
    item = " ".join(f"wort{i}" for i in range(20))
    docs = [(1, "Vor " + item.upper().replace(" ", ", ") + " nach"), (2, " ".join(item.split()[3:14])), (3, " ".join(item.split()[8:20]) + " x " + " ".join(item.split()[:12])), (4, None), (None, item), (5, ""), (6, ("und " * 50000) + item), (1, "nichts")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    items = spark.createDataFrame([(7, item), (8, "zu kurz"), (9, None), (None, item)], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked_items(d, items).collect()} == {(1, 7), (3, 7), (6, 7)}
    spans = {(r["doc_id"], r["first_word"], r["last_word"]) for r in leakage.leaked_spans(d, items).collect()}
    assert spans == {(1, 1, 20), (3, 0, 11), (3, 13, 24), (6, 50000, 50019)}
    assert {tuple(r) for r in leakage.leaked_spans(d, items, shard_words=5).select("doc_id", "item_id").distinct().collect()} == {(1, 7), (3, 7), (6, 7)}


# Splitting


def test_pieces_equal_the_greedy_cuts():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["wort ", "ende. ", "\n", "\n\n", "\n## Titel\n", "x" * 40]) for _ in range(rng.randrange(1, 900))) for _ in range(40)]
    texts += ["y" * 10000, "ä" * 1501, "a b " * 3000, "\n" * 4000]
    for text, cuts in zip(texts, splitting.cut_batch(texts, 1500, 150), strict=True):
        begin, last = 0, 0
        assert cuts[-1] == len(text) and cuts == sorted(set(cuts))
        for end in cuts:
            assert 0 < end - begin <= 1500 and begin <= last
            last, begin = end, end - 150
    with pytest.raises(ValueError):
        splitting.cut_batch(["x"], 100, 60)


def test_split_cases(spark):
    rows = chunks(spark, [chunk(1, "a" * 1500), chunk(2, "ü" * 1501), chunk(3, None), chunk(4, ""), chunk(5, "Satz. " * 50000), chunk(2, "ü" * 1501)]).withColumn("piece", F.lit(1))
    got = splitting.split_oversized(rows).collect()
    assert {r["chunk_id"] for r in got} == {2, 5} and sum(r["chunk_id"] == 2 and r["piece_idx"] == 0 for r in got) == 2
    assert all(len(r["piece"]) == r["end_char"] - r["start_char"] <= 1500 for r in got)
    five = sorted((r for r in got if r["chunk_id"] == 5), key=lambda r: r["piece_idx"])
    assert "".join(r["piece"][0 if i == 0 else 150 :] for i, r in enumerate(five)) == "Satz. " * 50000
    assert all(r["piece"].rstrip().endswith(".") for r in five)


# Encoding


def test_round_trips_of_the_transformations():
    alphabet = {c: 100 for c in "äöüßÄÖÜé€"}
    text = "Für größere Möbel gemäß Übergabe 5 € café"
    for chain in encoding.chains():
        g = encoding.garble(text, chain)
        if g is None or g == text or "\x00" in g:
            continue
        bad, out = encoding.Restorer([chain], alphabet)(g)
        assert bad and (out == text or len(chain[0][0]) and chain[0][0] != "utf-8"), chain
    r = encoding.Restorer([(("utf-8", "cp1252"),)], alphabet)
    for clean in (text, "ging über SÃO ROQUE nach FÂNZERES", "├── eingang\n│   └── x", "", "893 m³ und 5 m²"):
        assert r(clean) == (False, clean)
    assert r("f�r") == (True, "f�r")


def test_chains_are_learned_from_twins(spark):
    words = ["Prüfung", "Gärten", "Möbel", "Straße", "Zähler", "Förderung", "Übergabe", "Kündigung", "Rücklage", "Schätzung", "Erklärung", "Gebühr"]
    rows = [chunk(i, " ".join(words)) for i in range(40)]
    rows += [chunk(100 + i, encoding.garble(" ".join(words), (("utf-8", "cp1252"),))) for i in range(3)] + [chunk(200 + i, encoding.garble(" ".join(words), (("cp1252", "cp850"),))) for i in range(3)]
    rows += [chunk(300, "Neue Häuser".encode().decode("cp1252")), chunk(301, None), chunk(302, "", ref="MÃ¼ll"), chunk(303, "Preis 5 m³")]
    got = {(r["id"], r["field_name"]): r["restored"] for r in encoding.restored_fields(chunks(spark, rows).withColumn("restored", F.lit(1))).collect()}
    assert set(got) == {*((100 + i, "content") for i in range(3)), *((200 + i, "content") for i in range(3)), (300, "content"), (302, "ref")}
    assert got[100, "content"] == got[200, "content"] == " ".join(words) and got[300, "content"] == "Neue Häuser" and got[302, "ref"] == "Müll"


WORDS = ["Prüfung", "Gärten", "Möbel", "Straße", "Zähler", "Förderung", "Übergabe", "Kündigung", "Rücklage", "Schätzung", "Erklärung", "Gebühr"]


@pytest.mark.parametrize("mark", ["", " {}"])
def test_copies_of_a_garbled_text_are_found(spark, mark):
    """Copies, and near copies that differ by a number, of a text whose words are rarer elsewhere."""
    chain = (("cp1252", "cp850"),)
    rare = "Wärmedämmung Nebengebäudefläche"
    rows = [chunk(i, " ".join(WORDS) + f" {i}") for i in range(40)] + [chunk(50 + i, f"{rare} {i}") for i in range(4)]
    rows += [chunk(80 + i, encoding.garble(" ".join(WORDS) + f" {i}", chain)) for i in range(3)]
    rows += [chunk(100 + i, encoding.garble(rare, chain) + mark.format(i)) for i in range(30)]
    got = {r["id"]: r["restored"] for r in encoding.restored_fields(chunks(spark, rows)).where("field_name = 'content'").collect()}
    assert set(got) == {*range(80, 83), *range(100, 130)}
    assert got[100] == rare + mark.format(0)


# Scans

PAGE = "Mietvertrag Tarnitz – Huber Wohnbau\nNach dem Vertrag hat die Verwaltung die Abrech-\nnung zunächst bestätigt und der Kunde hat die\nRechnung am Montag ohne Abzug bezahlt, bevor der\n- 12 -\n\nMietvertrag Tarnitz – Huber Wohnbau\nVermieter die Unterlagen geprüft und dann alles\nan die Bank weitergeleitet hat."


def test_layout_of_a_page():
    p = scans.Page(PAGE)
    divided, paragraphs = p.body(set())
    assert p.page and len(p.numbers) == 1 and sum(s for _, _, s in p.headers) == 2 and divided == [("Abrech", "nung")]
    assert paragraphs == ["Nach dem Vertrag hat die Verwaltung die Abrechnung zunächst bestätigt und der Kunde hat die Rechnung am Montag ohne Abzug bezahlt, bevor der Vermieter die Unterlagen geprüft und dann alles an die Bank weitergeleitet hat."]
    assert not scans.Page("Schalter\nEin-\noder Ausbau").page and not scans.Page("").page
    assert not scans.Page("- a\n- b\n- c\n- d").page


def test_confusions():
    assert scans.edit_cost("Verbravch", "Verbrauch") < scans.MOST_COST and scans.edit_cost("Verrnerk", "Vermerk") < scans.MOST_COST
    assert scans.edit_cost("geänderten", "geänderte") >= scans.MOST_COST and scans.edit_cost("Haus", "Maus") >= scans.MOST_COST
    assert scans.fold("Kiinrnlig") == scans.fold("Künmhg")


def test_noise_and_repair(spark):
    clean = "Nach dem Vertrag hat die Verwaltung die Abrechnung zunächst bestätigt und geprüft. "
    page = PAGE.replace("Verwaltung", "Verwaltvng").replace("bestätigt", "besta'tigt")
    rows = [chunk(i, clean + str(i)) for i in range(30)] + [chunk(100, page), chunk(101, PAGE.replace("- 12 -\n", "").replace("Abrech-\nnung", "Abrechnung")), chunk(102, None), chunk(103, ""), chunk(100, page)]
    c = chunks(spark, rows).withColumn("noise", F.lit(1))
    got = {(r["id"], r["noise"]) for r in scans.noise(c).collect()}
    assert got == {(100, k) for k in ("hyphen", "page_number", "header", "misread")} | {(101, "header")}
    fixed = {r["id"]: r["repaired"] for r in scans.repaired(c).collect()}
    assert fixed[100].startswith("Nach dem Vertrag hat die Verwaltung die Abrechnung zunächst bestätigt und der Kunde")


def test_copies_of_a_page_keep_its_misreads(spark):
    clean = "Nach dem Vertrag hat die Verwaltung die Abrechnung zunächst bestätigt und geprüft. "
    page = PAGE.replace("Verwaltung", "Verwaltvng")
    rows = [chunk(i, clean + str(i)) for i in range(40)] + [chunk(100 + i, page, ref=f"r{i}") for i in range(20)]
    c = chunks(spark, rows)
    assert {r["id"] for r in scans.noise(c).where("noise = 'misread'").collect()} == set(range(100, 120))
    assert all("die Verwaltung die" in r["repaired"] for r in scans.repaired(c).where("id >= 100").collect())


# Names

ENTITY = "id string, label string, entity_type string, description string, wiki_page string, created_at string, updated_at string, valid_until string"


def test_variants(spark):
    sets = [
        ["Magdalena Gimukukrantz", "M. Gimukukrantz", "GIMUKUKRANTZ Magdalena", "Gimukukrantz, Magdalena", "Magdtalena Gimukukrantz", "Leni Gimukukrantz", "Dr. Magdalena Gimukukrantz"],
        ["Ludwig Gimukukrantz"],
        ["Josef F. Depetofenn", "Pepi Depetofenn", "Jossef Depetofenn"],
        ["Heinrich Depetofenn", "Heinrcih Depetofenn"],
        ["Sewuvatar Gartenpflege e.V.", "Sewuvatar-Gartenpflege", "Sewuvatar Gartenpfl. eingetragener Verein", "Gartenpflege Sewuvatar", "Fa. SEWUVATAR GARTENPFLEGE"],
        ["Sewuvatar Dachdeckerei GmbH"],
        ["Bömoherus Fördergesellschaft GmbH", "Boemoherus Foerdergesellschaft"],
        ["Tarekider Wohnbau KG"],
        ["Tarekider Wohnbau GmbH"],
    ]
    rows, truth, n = [], set(), 0
    for group in sets:
        ids = []
        for label in group:
            ids.append(f"e{n:03d}")
            rows.append((ids[-1], label, "CONCEPT" if n % 7 == 3 else "PERSON", None, None, "2024-01-01", "2024-01-01", None))
            n += 1
        truth |= {(a, b) for a in ids for b in ids if a < b}
    rows += [(f"f{i:03d}", f"{a} {b}", "PERSON", None, None, "", "", None) for i, (a, b) in enumerate((a, b) for a in ("Albrecht", "Walburga", "Konrad") for b in ("Nuramikamp", "Bilapäzeller", "Sufimabauer", "Kurukäzang"))]
    rows += [("g1", None, "PERSON", None, None, "", "", None), ("g2", "", "PERSON", None, None, "", "", None), ("g3", "12.3.2020", "DATE", None, None, "", "", None), (None, "Pepi Depetofenn", "PERSON", None, None, "", "", None), rows[0]]
    got = {tuple(r) for r in names.variant_pairs(spark.createDataFrame(rows, ENTITY).withColumn("tokens", F.lit(1))).collect()}
    assert got == truth


def test_every_match_shares_a_pair_of_tokens(spark):
    """What ``compare`` accepts among all pairs is met, with one surname in most labels; few other pairs are."""
    rng = random.Random(3)
    given = ["anneliese", "anni", "josef", "sepp", "heinrich", "heini", "thomas", "tomas", "georg", "schorsch", "maria", "martin", "seb", "sebastian"]
    rows = {" ".join(t): (t, i, "") for t, i in [([g, s], []) for g in given for s in ("mueller", "muller", rng.choice(["kranz", "krantz", "huber"]))] + [(["mueller"], [c]) for c in "ajmx"] + [(["mueller"], []), (["haus", "24", "immobilien"], []), (["haus", "42", "immobilien"], []), (["haus", "24", "imobilien"], []), (["gebaeudereinigung", "tarek"], []), (["reinigung", "tarek"], []), (["tarek", "wb"], []), (["tarek", "wohnbau"], [])]}
    rows = {f"{k}|{''.join(i)}": (t, i, l) for k, (t, i, l) in rows.items()}
    distinct = spark.createDataFrame([(k, t, i, l, 1) for k, (t, i, l) in rows.items()], "label_key string, tokens array<string>, initials array<string>, legal string, named int")
    pairs, ready = names.met_labels(distinct)
    met = {tuple(r) for r in pairs.collect()}
    weight = {t["t"]: -t["w"] for r in ready.collect() for t in r["ranked"]}
    df = {t["t"]: t["df"] for r in ready.collect() for t in r["ranked"]}
    accepted = {(a, b) for a in rows for b in rows if a < b and names.compare(rows[a], rows[b], weight, df, 0.72)[0]}
    assert accepted and not accepted - met and len(met) < len(rows) ** 2 / 6
    assert ("haus 24 immobilien|", "haus 24 imobilien|") in accepted and ("haus 24 immobilien|", "haus 42 immobilien|") not in accepted
    assert ("anneliese mueller|", "anni mueller|") in accepted


def test_name_parts():
    assert names.parse_label("Haus 5 Immobilien") == (["haus", "5", "immobilien"], [], "")
    assert names.parse_label("Hökuromon Steuerberatung a.g.") == (["hoekuromon", "steuerberatung"], [], "ag")
    assert names.parse_label("Dr. M. Huber") == (["huber"], ["m"], "") and names.parse_label("AG") == (["ag"], [], "")
    assert names.damerau("heinrcih", "heinrich", 1) == 1 and names.damerau("abc", "xyz", 2) == 3
    assert names.is_short_form("gartenpfl", "gartenpflege") and names.is_short_form("reinigung", "gebaeudereinigung") and not names.is_short_form("garten", "grundbesitz")


# Mixing


def test_flow_prefers_few_repeats_and_meets_quotas():
    offers = {("a",): (100, 3), ("b",): (50, 2), ("a", "b"): (40, 2)}
    flow = mixing.min_cost_flow(offers, {"a": 120.0, "b": 70.0})
    assert sum(v for (_, s), v in flow.items() if s == "a") == pytest.approx(120) and sum(v for (_, s), v in flow.items() if s == "b") == pytest.approx(70)
    used = {p: sum(v for (q, _), v in flow.items() if q == p) for p in offers}
    assert all(used[p] <= t + 1e-6 for p, (t, _) in offers.items())  # met without repeats
    flow, total = mixing.plan_mix({("a",): (10, 2), ("b",): (100, 1)}, {"a": 0.5, "b": 0.4, "none": 0.1}, None)
    assert total == pytest.approx(40, rel=1e-3)
    assert mixing.plan_mix({}, {"a": 1.0}, None) == ({}, 0.0)


def test_mix_cases(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["eins", "zwei", "drei", "vier"]) for _ in range(rng.randrange(5, 60)))
    docs = [(i, text(), ["A", "b ", "c"][i % 3 if i % 10 else 0]) for i in range(600)]
    docs += [(1000, docs[0][1], "b"), (1001, None, "a"), (1002, "", "a"), (1003, "x", None), (1004, "y", "other")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit(0))
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 2), ("c", 0.2, 3), ("missing", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(d, targets).collect()
    rep = {r["source"]: r for r in mixing.report(mixing.mix(d, targets), targets).collect()}
    assert rep["missing"]["reached_share"] == 0 and all(abs(rep[s]["reached_share"] - t / 0.9) < 0.01 for s, t in (("a", 0.2), ("b", 0.5), ("c", 0.2)))
    limit = {"a": 1, "b": 2, "c": 3}
    assert all(r["copies"] <= limit[r["source"]] for r in mixed) and {r["doc_id"] for r in mixed} <= set(range(600))


# Truncation


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Der Plan wurde bezahlt.", "whole"), ("Der Plan wurde bez", "cut"), ("Der Plan [...]", "cut"), ("Der Plan…", "cut"), ("Der Pl�", "cut"), ("", "whole"),
        ("Text.\n\n- a, 1.2.2020\n- b, 2.3.2021", "whole"), ("Text.\n\n- a, 1.2.2020\n- b", "cut"), ("| a | b |\n|---|---|\n| c | d |", "whole"), ("| a | b |\n|---|---|\n| c | d", "cut"),
        ("Ende.\n\nBeste Grüße\nAnna Huber", "whole"), ("Ende.\n\nStand: 2.3.2020", "whole"), ("Ende.\n\n- [[slug]]", "whole"), ("Ende.\n\n- [[slu", "cut"), ("---\ntitle: x\nsources: [a", "cut"),
        ("```\na = 1\n```", "whole"), ("```\na = 1", "cut"), ("(siehe Blatt 3)?)", "whole"), ("bezahlt am 12.", "unsure"), ("folgt am 2021-08-05.", "whole"),
    ],
)
def test_endings(text, kind):
    assert truncation.ending(text) == kind


def test_limits_are_found(spark):
    rng = random.Random(7)
    body = "wort " * 400
    docs = [(i, (body[: rng.randrange(100, 900)].rstrip() + "."), "S") for i in range(300)]
    docs += [(1000 + i, body[:255] if i % 2 else body[:254] + "x", "s ") for i in range(40)] + [(2000, "bezahlt am " + "x " * 120 + "12.", "s"), (3000, None, "s"), (3001, "", None)]
    docs = [(i, t if i != 2000 else ("y " * 126)[:251] + " 12.", s) for i, t, s in docs]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("cut", F.lit(1))
    got = {r["doc_id"]: r for r in truncation.truncated(d).collect()}
    assert {i for i, r in got.items() if r["cut"]} == {*range(1000, 1040), 2000} and got[1000]["at_limit"] and 3000 not in got
    rate = {r["source"]: r["n_cut"] for r in truncation.rates(d).collect()}
    assert rate == {"s": 41, "": 0}


def test_words_rule():
    assert re.findall(leakage.WORD, "a_b ü2 c-d") == ["a", "b", "ü2", "c", "d"]


def test_lost_characters_come_from_twins(spark):
    rows = [chunk(i, "Die Prüfung der Gärten") for i in range(20)] + [chunk(100, "Die Pr�fung der G�rten und H�ser"), chunk(101, "nichts")]
    got = {r["id"]: (r["restored"], r["complete"]) for r in encoding.restored_with_twins(chunks(spark, rows)).collect()}
    assert got == {100: ("Die Prüfung der Gärten und H�ser", False)}


def test_shapes_survive_confusions(spark):
    words = ["Verbrauch", "Vermerk", "Küchenantrag", "größere", "Balkon", "deutlich", "Zähler", "Wohnung", "Hausgeld"]
    rows = [(w.replace(m, r, 1), w) for w in words for r, m, _ in scans.CONFUSIONS if m in w]
    df = spark.createDataFrame(rows, "a string, b string").where(scans.shape("a") != scans.shape("b"))
    assert len(rows) > 30 and df.collect() == []
