"""Registry of named queries: a Spark builder and, where SQL can express it,
the equivalent SQL text for the DuckDB oracle.

Names follow the operator inventory: lower-case row id plus a short name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.testdata import FIXTURE_SQL, ShopData
from .present import present

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

# Derived CTEs used by several oracle statements: name -> (sql, dependencies).
DERIVED_SQL: dict[str, tuple[str, list[str]]] = {
    # Three keys, an unknown product is priced at 0.
    "priced": ("""
SELECT s.Date, s.Brand_Category, s.Brand, s.Size_ML, s.Qty,
       COALESCE(p.Mrp, CAST(0 AS DECIMAL(18,2))) AS unit_price,
       CAST(COALESCE(s.Qty, 0) * COALESCE(p.Mrp, CAST(0 AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total
FROM daily_sales s LEFT JOIN price_list p
  ON s.Brand_Category = p.Brand_Category AND s.Brand = p.Brand AND s.Size_ML = p.Size_ML""",
               ["daily_sales", "price_list"]),
    # Three keys, an unknown price stays NULL and sums skip it.
    "priced3n": ("""
SELECT s.Date, s.Brand_Category, s.Brand, s.Size_ML, s.Qty, p.Mrp AS unit_price,
       CAST(s.Qty * p.Mrp AS DECIMAL(18,2)) AS total
FROM daily_sales s LEFT JOIN price_list p
  ON s.Brand_Category = p.Brand_Category AND s.Brand = p.Brand AND s.Size_ML = p.Size_ML""",
                 ["daily_sales", "price_list"]),
    # Brand + Size only; the price list is first reduced to one row per
    # (Brand, Size_ML), lowest serial number first.
    "price2": ("""
SELECT Brand, Size_ML, FIRST(Mrp ORDER BY Sl_No) AS Mrp FROM price_list GROUP BY Brand, Size_ML""", ["price_list"]),
    "priced2n": ("""
SELECT s.Date, s.Brand_Category, s.Brand, s.Size_ML, s.Qty, p.Mrp AS unit_price,
       CAST(s.Qty * p.Mrp AS DECIMAL(18,2)) AS total
FROM daily_sales s LEFT JOIN price2 p ON s.Brand = p.Brand AND s.Size_ML = p.Size_ML""",
                 ["daily_sales", "price2"]),
    "stock_dated": ("""
SELECT * FROM monthly_stock UNION ALL SELECT * FROM incoming_stock""", ["monthly_stock", "incoming_stock"]),
    "catalogue": ("""
SELECT p.Sl_No AS product_id,
       CONCAT('(', p.Brand_Category, ') - ', p.Brand, ' - ', CAST(p.Size_ML AS VARCHAR), ' ML') AS product_name,
       p.Brand_Category AS category, p.Mrp AS price, m.Qty AS stock_quantity, 60 AS reorder_level
FROM price_list p JOIN monthly_stock m
  ON p.Brand_Category = m.Brand_Category AND p.Brand = m.Brand AND p.Size_ML = m.Size_ML""",
                  ["price_list", "monthly_stock"]),
    "catalogue_sales": ("""
SELECT p.Sl_No AS product_id, s.Qty AS quantity_sold, s.Date AS sale_date
FROM daily_sales s JOIN price_list p
  ON p.Brand_Category = s.Brand_Category AND p.Brand = s.Brand AND p.Size_ML = s.Size_ML""",
                        ["daily_sales", "price_list"]),
    # Receipts (+) and sales (-) per product and date.
    "moves": ("""
SELECT Brand_Category, Brand, Size_ML, Date, CAST(SUM(i) AS BIGINT) AS Incoming_Qty,
       CAST(SUM(o) AS BIGINT) AS Sales_Qty, CAST(SUM(i) - SUM(o) AS BIGINT) AS Change
FROM (SELECT Brand_Category, Brand, Size_ML, Date, Qty AS i, 0 AS o FROM incoming_stock
      UNION ALL SELECT Brand_Category, Brand, Size_ML, Date, 0, Qty FROM daily_sales) u
GROUP BY Brand_Category, Brand, Size_ML, Date""", ["incoming_stock", "daily_sales"]),
    "opening": ("""
SELECT Brand_Category, Brand, Size_ML, CAST(SUM(Qty) AS BIGINT) AS b0 FROM monthly_stock
GROUP BY Brand_Category, Brand, Size_ML""", ["monthly_stock"]),
    "brand_baskets": ("""
SELECT Date, Brand_Category, LIST_DISTINCT(LIST(Brand)) AS items FROM daily_sales WHERE Brand IS NOT NULL
GROUP BY Date, Brand_Category""", ["daily_sales"]),
    "basket_items": ("SELECT Date, Brand_Category, UNNEST(items) AS it FROM brand_baskets", ["brand_baskets"]),
    "account_lines": (r"""
SELECT *, TRIM(REGEXP_REPLACE(stock_item_name, '(?i)\s*\d+\s*-\s*ML.*$', '')) AS brand,
       TRY_CAST(REGEXP_EXTRACT(UPPER(stock_item_name), '(\d+)\s*-\s*ML', 1) AS INTEGER) AS size_ml,
       'NOS' AS unit
FROM voucher_lines""", ["voucher_lines"]),
}


def with_ctes(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it names (and their dependencies)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        if n in DERIVED_SQL:
            for dep in DERIVED_SQL[n][1]:
                visit(dep)
        elif n not in FIXTURE_SQL:
            raise KeyError(n)
        order.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        body = DERIVED_SQL[n][0] if n in DERIVED_SQL else FIXTURE_SQL[n]
        parts.append(f"{n} AS ({body.strip()})")
    return "WITH " + ",\n".join(parts) + "\n" + sql.strip()


def register(name: str, sql: str | None = None, raw: bool = False):
    """Register ``fn(data: ShopData) -> DataFrame`` under ``name``.

    The stored callable takes ``(spark, sf_dir)``. Output goes through
    ``present`` unless ``raw``.
    """
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(ShopData(spark, sf_dir))
            return df if raw else present(df)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def D(expr: str) -> str:
    """SQL: a DATE rendered as ISO text (matches ``present``)."""
    return f"STRFTIME({expr}, '%Y-%m-%d')"


def M(expr: str) -> str:
    """SQL: money handed out as DOUBLE (matches ``present``)."""
    return f"CAST({expr} AS DOUBLE)"


def R(num: str, den: str) -> str:
    """SQL: ratio in DOUBLE, NULL for a zero denominator (matches ``reports.ratio``)."""
    return f"CASE WHEN ({den}) <> 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"
