"""Set operations.

Unions are narrow (no shuffle): partitions of the inputs are simply
concatenated. ``distinct`` and grouped unions shuffle once on their keys,
after a partial aggregation per task.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRODUCT = ["Brand_Category", "Brand", "Size_ML"]


def union_all(frames: dict[str, DataFrame] | list[DataFrame], source_col: str | None = "source") -> DataFrame:
    """UNION ALL by column name; missing columns become NULL. With a dict
    and ``source_col``, each row records which input it came from."""
    if isinstance(frames, dict):
        items = [df.withColumn(source_col, F.lit(name)) if source_col else df for name, df in frames.items()]
    else:
        items = list(frames)
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), items)


def distinct_union(frames: list[DataFrame], column: str, descending: bool = False) -> DataFrame:
    """Sorted distinct values of one column over several tables."""
    vals = functools.reduce(lambda a, b: a.union(b), [f.select(column) for f in frames])
    out = vals.where(F.col(column).isNotNull()).distinct()
    return out.orderBy(F.col(column).desc() if descending else F.col(column))


def combined_totals(frames: list[DataFrame], keys: list[str] | None = None, value: str = "Qty") -> DataFrame:
    """Opening + receipts as one aggregate (union, then one group-by)."""
    keys = keys or PRODUCT
    u = functools.reduce(lambda a, b: a.unionByName(b), [f.select(*keys, value) for f in frames])
    return u.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(value))


def stack_tagged(history: DataFrame, forecast: DataFrame, tag_col: str = "type") -> DataFrame:
    """U4: history and forecast rows in one frame with a type tag."""
    return (history.withColumn(tag_col, F.lit("historical"))
            .unionByName(forecast.withColumn(tag_col, F.lit("forecast")), allowMissingColumns=True))
