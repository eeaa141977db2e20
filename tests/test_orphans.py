import itertools

import pytest

from folioscope.operators import orphans as O
from folioscope.streaming import operators as S

R = [
    ("t", "f", "r1", "2024-01", "k1", "2024-01-05"),
    ("t", "f", "r1", "2024-01", "k1", "2024-01-05"),  # delivered again
    ("t", "f", "r2", "2024-02", "k2", "2024-02-01"),  # arrives later
    ("t", "f", "r3", "2024-03", "k3", "2024-03-01"),  # deleted before
    ("t", "f", "r4", "2024-03", "none", "2024-03-01"),
    ("t", "f", "r5", "2024-03", None, "2024-03-01"),
    ("t", "f", "r6", "2024-03", "k3", None),
]
P = [("k1", "v", "2023-01-01", None), ("k1", "v", "2023-01-01", None), ("k2", "v", "2024-06-01", None), ("k3", "v", "2023-01-01", None), ("k3", "v", "2023-01-01", "2024-03-01"), (None, "v", None, None)]
EXPECTED = {"r2", "r3", "r4"}


def frames(spark, references, parents):
    return spark.createDataFrame(references, O.REFERENCE), spark.createDataFrame(parents, O.PARENT)


@pytest.fixture
def store(spark, tmp_path):
    return O.OrphanStore(spark, str(tmp_path / "state"), 4)


def ids(store):
    return sorted(r["record_id"] for r in O.orphans(store).collect())


def test_cases(spark, store):
    state = O.advance(store, *frames(spark, R, P))
    assert ids(state) == sorted(EXPECTED)
    counts = {(r["period"]): (r["n_orphans"], r["n_references"]) for r in O.snapshot(state).collect()}
    assert counts == {"2024-01": (0, 1), "2024-02": (1, 1), "2024-03": (2, 3)}


def test_order_of_batches_does_not_matter(spark, tmp_path):
    for order in itertools.permutations(range(3)):
        state = O.OrphanStore(spark, str(tmp_path / "".join(map(str, order))), 4)
        for number in order:
            state = O.advance(state, *frames(spark, R[number::3], P[number::3]))
        assert ids(state) == sorted(EXPECTED)


def test_arrival_resolves_and_deletion_reopens(spark, store):
    state = O.advance(store, *frames(spark, [("t", "f", "a", "2024-05", "k", "2024-05-05"), ("t", "f", "b", "2024-05", "other", "2024-05-05")], []))
    assert ids(state) == ["a", "b"]
    state = O.advance(state, *frames(spark, [], [("k", "v", "2024-01-01", None)]))
    assert ids(state) == ["b"]
    state = O.advance(state, *frames(spark, [("t", "f", "a", "2024-05", "k", "2024-05-05")], []))  # delivered again
    assert ids(state) == ["b"]
    before = state.references
    state = O.advance(state, *frames(spark, [], [("k", "v", "2024-01-01", "2024-02-02")]))
    assert ids(state) == ["a", "b"]
    assert sum(before[b] != n for b, n in state.references.items()) == 1  # one bucket is written anew
    state = O.advance(state, *frames(spark, [], []))
    assert ids(O.load(spark, state.folder, state.number, 4)) == ["a", "b"]


def test_a_repeated_batch_of_a_stream_changes_nothing(spark, tmp_path):
    each = S.pending_orphans(str(tmp_path / "s"), buckets=4)
    parts = [S.changes(*frames(spark, R[i::2], P[i::2])) for i in range(2)]
    for number, part in ((0, parts[0]), (1, parts[1]), (1, parts[1])):
        each(part, number)
    assert ids(O.load(spark, str(tmp_path / "s"), 1, 4)) == sorted(EXPECTED)
    counts = spark.read.parquet(str(tmp_path / "s/counts/v1")).collect()
    assert sum(r["n_orphans"] for r in counts) == len(EXPECTED)


def test_empty_and_extra_columns(spark, tmp_path):
    references, parents = frames(spark, [], [])
    assert ids(O.advance(O.OrphanStore(spark, str(tmp_path / "a")), references, parents)) == []
    references, parents = frames(spark, R, P)
    references = references.selectExpr("*", "'x' AS spans", "1 AS born", "2 AS bucket")
    parents = parents.selectExpr("*", "'y' AS orphan", "2 AS at", "3 AS bucket")
    assert ids(O.advance(O.OrphanStore(spark, str(tmp_path / "b")), references, parents)) == sorted(EXPECTED)


def test_one_key_holds_a_third(spark, store):
    rows = [("t", "f", f"r{i}", "2024-01", "hot" if i % 3 == 0 else f"k{i}", "2024-01-05") for i in range(3000)]
    state = O.advance(store, *frames(spark, rows, [("hot", "v", "2023-01-01", None)]))
    assert O.orphans(state).count() == 2000
