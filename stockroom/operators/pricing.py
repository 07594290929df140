"""Joining sales to the price list.

The price list is a dimension keyed by product. It is de-duplicated before
the join (lowest serial number wins), so a join can never multiply sales
rows, whatever key subset is used. Joins carry no hint: Spark broadcasts the
list only while it is under ``spark.sql.autoBroadcastJoinThreshold``; beyond
it the join is a shuffle join on the product key, which AQE splits if one
product is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import MONEY, line_total, serial_sort_key

PRODUCT = ["Brand_Category", "Brand", "Size_ML"]


def dedupe_prices(prices: DataFrame, keys: list[str] | None = None, order_col: str = "Sl_No") -> DataFrame:
    """D3: one price row per key; the row with the lowest ``order_col`` wins
    (ties broken by the remaining columns, so the choice is deterministic)."""
    keys = keys or PRODUCT
    rest = [c for c in prices.columns if c not in keys]
    order = F.struct(serial_sort_key(order_col).alias("_o"), *[F.col(c) for c in rest])
    picked = prices.groupBy(*keys).agg(F.min(order).alias("_p"))
    return picked.select(*keys, *[F.col(f"_p.{c}").alias(c) for c in rest])


def price_sales(sales: DataFrame, prices: DataFrame, keys: list[str] | None = None,
                price_col: str = "Mrp", qty_col: str = "Qty", unmatched: str = "zero",
                dedupe: bool = True) -> DataFrame:
    """Sales LEFT JOIN prices; adds ``unit_price`` and ``total``.

    ``unmatched='zero'`` prices an unknown product at 0 (J1), ``'null'`` keeps
    NULL so that sums skip it (J2).
    """
    keys = keys or PRODUCT
    p = prices.select(*keys, price_col)
    if dedupe:
        p = dedupe_prices(prices.select(*keys, price_col, "Sl_No"), keys).select(*keys, price_col)
    joined = sales.join(p, keys, "left")
    if unmatched == "zero":
        unit = F.coalesce(F.col(price_col), F.lit(0).cast(MONEY))
        total = line_total(qty_col, unit)
    elif unmatched == "null":
        unit = F.col(price_col)
        total = (F.col(qty_col) * unit).cast(MONEY)
    else:
        raise ValueError(f"unmatched must be 'zero' or 'null', got {unmatched!r}")
    return joined.withColumn("unit_price", unit.cast(MONEY)).withColumn("total", total).drop(price_col)


def enrich_stock_with_prices(stock: DataFrame, prices: DataFrame, price_cols: list[str] | None = None,
                             keys: list[str] | None = None) -> DataFrame:
    """Stock LEFT JOIN price master; missing Sl_No -> 999999, missing
    prices -> 0. Callers sort by ``Sl_No`` for display."""
    keys = keys or PRODUCT
    price_cols = price_cols or ["Mrp"]
    p = dedupe_prices(prices.select(*keys, "Sl_No", *price_cols), keys)
    out = stock.join(p, keys, "left")
    out = out.withColumn("Sl_No", serial_sort_key("Sl_No"))
    for c in price_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast(MONEY)))
    return out


def price_lookup(prices: DataFrame, brand=None, size=None, category=None) -> DataFrame:
    """prices by full product key, by brand + size, or all of one size.

    Adds ``match_count`` (rows returned) as a scalar subquery: a partial
    count per task, no single-partition window.
    """
    from .filters import exact_filters  # local import avoids a cycle

    p = dedupe_prices(prices)
    out = exact_filters(p, Brand=brand, Size_ML=size, Brand_Category=category)
    return out.withColumn("match_count", out.select(F.count(F.lit(1))).scalar())
