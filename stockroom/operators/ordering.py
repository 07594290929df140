"""Sorting, top-k and paging.

Top-k is ``orderBy(...).limit(k)``, which Spark plans as
``TakeOrderedAndProject``: every task keeps its own k best rows and only
those reach the final merge, so no full sort or single-partition shuffle of
the input happens. Ties are always broken by the grouping key so that the
result is deterministic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_by(df: DataFrame, columns: list[str], ascending: bool | list[bool] = True) -> DataFrame:
    """Multi-key sort."""
    asc = ascending if isinstance(ascending, list) else [ascending] * len(columns)
    return df.orderBy(*[F.col(c).asc_nulls_last() if a else F.col(c).desc_nulls_last()
                        for c, a in zip(columns, asc)])


def user_sort(df: DataFrame, column: str, direction: str = "asc", allowed: list[str] | None = None) -> DataFrame:
    """Sort by a user-chosen column from an allow-list."""
    allowed = allowed or df.columns
    if column not in allowed:
        raise ValueError(f"cannot sort by {column!r}")
    if direction not in ("asc", "desc"):
        raise ValueError("direction must be 'asc' or 'desc'")
    others = [F.col(c) for c in df.columns if c != column]
    key = F.col(column).asc_nulls_last() if direction == "asc" else F.col(column).desc_nulls_last()
    return df.orderBy(key, *others)


def top_k(df: DataFrame, by: str, k: int, tie_break: list[str]) -> DataFrame:
    """The k rows with the largest ``by``; ties by ``tie_break`` asc."""
    return df.orderBy(F.col(by).desc(), *[F.col(c).asc() for c in tie_break]).limit(k)


def top_k_groups(df: DataFrame, group: list[str], value: str, k: int, agg: str = "sum",
                 out: str = "total") -> DataFrame:
    """Aggregate per group (partial + final hash aggregate), then top k."""
    fn = {"sum": F.sum, "count": lambda c: F.count(F.lit(1))}[agg]
    g = df.groupBy(*group).agg(fn(value).alias(out))
    return top_k(g, out, k, group)


def most_frequent(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """T4: ``value_counts().head(k)``; NULL values are not counted."""
    g = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return top_k(g, "count", k, [column])


HEAP = 10_000  # rows that a top-k may keep to find a page
RANGES = 256


def _ranges(df: DataFrame, key: Column, n: int, skip: int, stop: int, ranges: int) -> list[tuple]:
    """(condition, rows) of the parts that two keys around the rows ``skip`` to ``stop`` cut the ``n`` sorted rows of ``df``
    into: before, equal to, between, equal to and behind them.

    A sample only places the cuts: rows are counted exactly, with at most four comparisons a row, and equal keys never part."""
    kind = df.select(key.alias("k")).schema["k"].dataType
    some = [r["k"] for r in df.select(key.alias("k")).sample(min(1.0, 20 * ranges / n), seed=7).orderBy("k").collect()]
    # the number of sampled rows before a row varies by its root
    first, last = (min(x, n) / n * len(some) for x in (skip, stop))
    places = {math.floor(first - 2 * math.sqrt(first)) - 3, math.ceil(last + 2 * math.sqrt(last)) + 3}
    number, parts = F, 0
    for k in [some[i] for i in sorted(places) if 0 <= i < len(some)]:
        cut = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(kind.fields, k)])
        number, parts = number.when(key < cut, parts).when(key <= cut, parts + 1), parts + 2
    number = number.otherwise(parts) if parts else F.lit(0)
    counts = {r["i"]: r["n"] for r in df.groupBy(number.alias("i")).agg(F.count("*").alias("n")).collect()}
    return [(number == i, counts[i]) for i in sorted(counts)]


def page(df: DataFrame, page_no: int, page_size: int, order: list[str], heap: int = HEAP, ranges: int = RANGES) -> DataFrame:
    """T5: page ``page_no`` (1-based) of a totally ordered result, with the
    total page count ``max(1, ceil(rows / size))`` as a scalar subquery.

    Up to ``heap`` rows are found by a top-k. A deeper page would need a heap of all rows before it; there, the rows are
    cut at two keys around the page, the parts are counted, and only those that the page lies in are kept, again and
    again until few rows are left before the page. Each round is one counting pass; nothing is sorted but the rest."""
    if page_no < 1 or page_size < 1:
        raise ValueError("page and size start at 1")
    total = df.select(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(page_size))).cast("int")).scalar()
    skip, left, key = (page_no - 1) * page_size, df, F.struct(*order)
    n = df.count() if skip + page_size > heap else 0
    while skip + page_size > heap and skip < n:
        before, kept, cond, first = 0, 0, F.lit(False), None
        for own, rows in _ranges(left, key, n, skip, skip + page_size, ranges):
            if before + rows > skip and before < skip + page_size:
                first = before if first is None else first
                cond, kept = cond | own, kept + rows
            before += rows
        if kept == n:  # one key holds more rows than a heap: they are in one range and tie
            break
        left, n, skip = left.where(cond), kept, skip - first
    rows = left.limit(0) if n and skip >= n else left.orderBy(*order).offset(skip).limit(page_size)
    return rows.withColumn("total_pages", total).withColumn("page", F.lit(page_no))


def newest_first(df: DataFrame, date_col: str = "Date", tie_break: list[str] | None = None) -> DataFrame:
    """Newest date first, on a real DATE column."""
    return df.orderBy(F.col(date_col).desc(), *(tie_break or []))
