"""Named queries: a callable over (spark, directory) and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None
    operators: str


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, operators: str = "") -> Callable[[Plan], Plan]:
    """Register a plan under a name; ``operators`` lists the inventory rows it covers."""

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, plan, sql, operators)
        return plan

    return register
