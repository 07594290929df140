"""Filters and search.

All predicates are Column expressions, so Catalyst pushes the ones on stored
columns into the Parquet scan (``PushedFilters``) and prunes partitions when
the table is partitioned by month.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import col_of


def exact_filters(df: DataFrame, **equals) -> DataFrame:
    """one equality per given argument; ``None`` adds no predicate."""
    preds = [F.col(k) == F.lit(v) for k, v in equals.items() if v is not None]
    return df.filter(functools.reduce(operator.and_, preds)) if preds else df


def date_range(df: DataFrame, date_col: str = "Date", start=None, end=None) -> DataFrame:
    """inclusive range on a DATE column, open at a missing end. Rows whose
    date is NULL (unparseable) drop out whenever a bound is given."""
    c = F.col(date_col)
    if start is not None:
        df = df.filter(c >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(c <= F.lit(end).cast("date"))
    return df


def on_date(df: DataFrame, day, date_col: str = "Date") -> DataFrame:
    """rows of one date."""
    return df.filter(F.col(date_col) == F.lit(day).cast("date"))


def on_latest_date(df: DataFrame, date_col: str = "Date") -> DataFrame:
    """F3 with the default pick (F11): rows of the newest date, found with a
    scalar subquery (partial max per task)."""
    latest = df.select(F.max(date_col)).scalar()
    return df.filter(F.col(date_col) == latest)


def contains_ci(c, needle: str, regex: bool = False) -> Column:
    """case-insensitive search; a literal needle becomes ``contains``
    on lower-cased text, a pattern becomes ``(?i)`` rlike. NULL -> false."""
    c = col_of(c)
    if regex:
        hit = c.rlike("(?i)" + needle)
    else:
        hit = F.lower(c).contains(needle.lower())
    return F.coalesce(hit, F.lit(False))


def search_any(df: DataFrame, columns: list[str], needle: str, regex: bool = False) -> DataFrame:
    """OR of the search over several columns."""
    return df.filter(functools.reduce(operator.or_, [contains_ci(c, needle, regex) for c in columns]))


def members_and_ranges(df: DataFrame, members: dict | None = None, ranges: dict | None = None) -> DataFrame:
    """``isin`` for each listed column and inclusive ``between`` ranges."""
    for c, values in (members or {}).items():
        if values:
            df = df.filter(F.col(c).isin(list(values)))
    for c, (lo, hi) in (ranges or {}).items():
        if lo is not None:
            df = df.filter(F.col(c) >= F.lit(lo))
        if hi is not None:
            df = df.filter(F.col(c) <= F.lit(hi))
    return df


def sign_filter(df: DataFrame, column: str, sign: str = "all") -> DataFrame:
    """all / positive / negative / zero."""
    c = F.col(column)
    preds = {"all": None, "positive": c > 0, "negative": c < 0, "zero": c == 0}
    if sign not in preds:
        raise ValueError(f"unknown sign {sign!r}")
    return df if preds[sign] is None else df.filter(preds[sign])


def text_equals(df: DataFrame, **filters) -> DataFrame:
    """F8: compare any column as text; the value ``'All'`` (or None) passes."""
    for k, v in filters.items():
        if v is None or v == "All":
            continue
        df = df.filter(F.col(k).cast("string") == F.lit(str(v)))
    return df


def option_list(df: DataFrame, column: str, **given) -> DataFrame:
    """distinct sorted values of ``column`` under the cascading filters."""
    return exact_filters(df, **given).select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def product_tree(df: DataFrame) -> DataFrame:
    """category -> brand -> sorted distinct sizes, one row per category
    with a MAP<brand, ARRAY<size>>. Two partial aggregations; each set is
    bounded by the product catalogue, never by sales rows."""
    per_brand = (df.groupBy("Brand_Category", "Brand")
                 .agg(F.array_sort(F.collect_set("Size_ML")).alias("sizes")))
    return (per_brand.groupBy("Brand_Category")
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("Brand", "sizes")))).alias("brands")))


def available_dates(df: DataFrame, date_col: str = "Date") -> DataFrame:
    """distinct dates, newest first (real dates, not text)."""
    return df.select(date_col).where(F.col(date_col).isNotNull()).distinct().orderBy(F.col(date_col).desc())


def low_stock(df: DataFrame, qty_col: str = "stock_quantity", level_col: str = "reorder_level") -> DataFrame:
    """``stock <= reorder level``."""
    return df.filter(F.col(qty_col) <= F.col(level_col))


def stock_status(df: DataFrame, qty_col: str = "quantity", rate_col: str = "rate") -> DataFrame:
    """stock and price status labels for every row."""
    q = F.coalesce(F.col(qty_col).cast("double"), F.lit(0.0))
    r = F.coalesce(F.col(rate_col).cast("double"), F.lit(0.0))
    return (df.withColumn("stock_status", F.when(q <= 0, "NOT AVAILABLE").when(q <= 5, "LOW STOCK")
                          .otherwise("AVAILABLE"))
            .withColumn("price_status", F.when(r <= 0, "Price not configured").otherwise("configured")))
