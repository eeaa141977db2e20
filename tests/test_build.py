import datetime as dt

from folioscope.operators import build as B

P = "---\ntitle: A\ntopics: [x, A]\nsources: [s1]\n---\n[[b]] and [[c|alias]]\n"


def test_build_and_update(spark):
    pages = spark.createDataFrame([("public/a", P), ("public/n", "no front matter [[b]]"), ("public/e", None)], "wiki_page string, text string")
    e, r, p = B.graph_of(B.extracted(pages))
    assert {x["label"] for x in e.collect()} == {"A", "x", "s1", "b", "c"} and r.count() == 4 and p.count() == 5
    state = spark.createDataFrame([], "wiki_page string, body_hash string")
    old_e = e.where("label != 'x'")
    old_r = r.where("relation_type != 'STAMMT_VON'").selectExpr("id", "source_id", "target_id", "relation_type", "wiki_page", "'weak' AS confidence")
    new_e, new_r = B.update((old_e, old_r), pages, state)
    assert new_e.count() == 5 and new_r.count() == 4 and {x["confidence"] for x in new_r.collect()} == {"extracted", "inferred"}
    same = pages.selectExpr("wiki_page", "substring(sha2(text, 256), 1, 16) AS body_hash")
    new_e, new_r = B.update((old_e, old_r), pages.where("text IS NOT NULL"), same)
    assert new_e.count() == 4 and {x["confidence"] for x in new_r.collect()} == {"weak"}


def test_small():
    now = dt.datetime(2024, 1, 1, 5, 30)
    assert B.past_deadline(now, "05:30") and not B.past_deadline(now, "06:00") and not B.past_deadline(now, "soon")
    assert "New source s" in B.update_prompt("T", "x" * 30000, "s", "doc")
