"""Vectors in the JVM (for oracles and narrow use) and in NumPy (for bulk)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 where either vector has no length."""
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(F.lit(0.0))


def normalized(a: str | Column) -> Column:
    """Unit length; vectors without length stay as they are."""
    column = F.col(a) if isinstance(a, str) else a
    n = norm(column)
    return F.when(n > 0, F.transform(column, lambda x: (x.cast("double") / n).cast("float"))).otherwise(column)


def scored(rows: DataFrame, query: list[float], vector_column: str, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns and the cosine with one query vector: a matrix product per Arrow batch.

    Null vectors and those of another length are left out; vectors without length score 0.
    """
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            offsets = lists.offsets.to_numpy()
            x = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(-1, len(q)).astype(np.float64)
            n = np.linalg.norm(x, axis=1)
            s = np.divide(x @ q, n, out=np.zeros(len(x)), where=n > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s)], names=[*keep, name])

    shaped = rows.where(F.size(vector_column) == len(q)).select(*keep, vector_column)
    kinds = ", ".join(f"`{n}` {t}" for n, t in shaped.dtypes[:-1])
    return shaped.mapInArrow(score, f"{kinds}, `{name}` double")
