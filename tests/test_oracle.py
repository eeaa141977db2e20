"""Every core query against its SQL twin; those without one run and keep their schema."""

import pytest
from conftest import compare

import folioscope.plans  # noqa: F401
from folioscope.registry import QUERIES

CORE = sorted(n for n, q in QUERIES.items() if q.plan.__module__.startswith("folioscope.plans"))


@pytest.mark.parametrize("name", CORE)
def test_query(name, spark, data, duck):
    q = QUERIES[name]
    df = q.plan(spark, data)
    if q.sql:
        compare(df, duck, q.sql)
    else:
        assert df.columns and df.count() >= 0


def test_inventory_is_covered():
    import re

    rows = {row for q in QUERIES.values() for row in re.findall(r"\b[A-Z]\d{1,2}\b|\b[DQEH]-\d\b", q.operators)}
    for family, count in (("J", 19), ("A", 18), ("W", 8), ("U", 5), ("T", 24)):
        missing = [f"{family}{i}" for i in range(1, count + 1) if f"{family}{i}" not in rows]
        assert not missing, missing
