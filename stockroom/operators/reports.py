"""Sales and stock reports.

Every report is a ``groupBy`` (or grouping sets / rollup) over rows that were
priced by ``pricing.price_sales``. Spark plans each as a partial hash
aggregate before the shuffle and a final one after it, so a hot product or a
hot day only adds one partial row per task to the shuffle; skew in the group
key does not reach the exchange.

Money is summed in DECIMAL (exact and order independent) and averages are
``sum / count`` in DOUBLE, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import fmt_year_month, iso_week, iso_week_year
from ..functions.numbers import MONEY_SUM

PRODUCT = ["Brand_Category", "Brand", "Size_ML"]


def _qty_sum(c: str = "Qty") -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def _money_sum(c: str = "total") -> Column:
    """pandas / ``$sum`` semantics: a group with no prices sums to 0."""
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY_SUM)


def ratio(num, den) -> Column:
    """``num / den`` in DOUBLE; NULL when ``den`` is 0."""
    n = num if isinstance(num, Column) else F.col(num)
    d = den if isinstance(den, Column) else F.col(den)
    return F.when(d != 0, n.cast("double") / d.cast("double"))


def mean(c: str) -> Column:
    """Average as exact sum over count (NULLs ignored, as pandas/Mongo do)."""
    return ratio(F.sum(c), F.count(c))


def period_columns(period: str, date_col: str = "Date") -> dict[str, Column]:
    d = F.col(date_col)
    if period == "isoweek":
        return {"year": iso_week_year(d), "week": iso_week(d)}
    if period == "month":
        return {"year": F.year(d).cast("int"), "month": F.month(d).cast("int")}
    if period == "yearmonth":
        return {"YearMonth": fmt_year_month(d)}
    if period == "day":
        return {date_col: d}
    if period == "all":
        return {}
    raise ValueError(f"unknown period {period!r}")


def sales_by_period(priced: DataFrame, period: str, by: list[str] | None = None,
                    qty_name: str = "total_quantity_sold", amount_name: str = "total_sales_amount",
                    date_col: str = "Date") -> DataFrame:
    """Quantity and value per period (and optional product keys).

    ``period``: ``isoweek`` (ISO week-year + week, A1/A3), ``month`` (A2/A4),
    ``yearmonth`` (A5/A6), ``day`` (A7/A8), ``all`` (A9).
    """
    keys = [c.alias(n) for n, c in period_columns(period, date_col).items()] + [F.col(c) for c in (by or [])]
    aggs = [_qty_sum().alias(qty_name), _money_sum().alias(amount_name)]
    return priced.groupBy(*keys).agg(*aggs) if keys else priced.agg(*aggs)


def subtotals_by(priced: DataFrame, label: str, per_date: bool = True, date_col: str = "Date") -> DataFrame:
    """A10: subtotals by one label column (NULL label -> 'N/A'), per date."""
    keys = ([F.col(date_col)] if per_date else []) + [F.coalesce(F.col(label), F.lit("N/A")).alias(label)]
    return priced.groupBy(*keys).agg(_qty_sum().alias("total_qty"), _money_sum().alias("total_amount"))


def detail_lines(priced: DataFrame, date_col: str = "Date") -> DataFrame:
    """Detail lines with unit price and line total."""
    return priced.select(date_col, *PRODUCT, "Qty", "unit_price", F.col("total").alias("line_total"))


ROW_TYPE = "Row_Type"


def sales_summary(priced: DataFrame, date_col: str = "Date") -> DataFrame:
    """Detail by (date, product) + subtotal per product + grand total,
    in one pass with ``GROUPING SETS``; ``Row_Type`` from ``grouping_id``."""
    g = (priced.groupingSets([[date_col, *PRODUCT], PRODUCT, []], date_col, *PRODUCT)
         .agg(_qty_sum().alias("total_qty"), _money_sum().alias("total_amount"),
              F.grouping(date_col).alias("_gd"), F.grouping("Brand").alias("_gb")))
    row_type = (F.when(F.col("_gd") == 0, "DETAIL").when(F.col("_gb") == 0, "SUBTOTAL")
                .otherwise("GRAND_TOTAL"))
    return g.withColumn(ROW_TYPE, row_type).drop("_gd", "_gb")


def stock_in_hand(stock: DataFrame, date_col: str = "Date") -> DataFrame:
    """Stock by (date, product) plus a grand total row."""
    g = (stock.groupingSets([[date_col, *PRODUCT], []], date_col, *PRODUCT)
         .agg(_qty_sum().alias("total_qty"), F.grouping_id().alias("_gid")))
    return g.withColumn(ROW_TYPE, F.when(F.col("_gid") == 0, "DETAIL").otherwise("GRAND_TOTAL")).drop("_gid")


def total_stock_with_stamps(stock: DataFrame, stamp_cols: list[str]) -> DataFrame:
    """Total per product with the latest audit stamps (``$max``)."""
    return stock.groupBy(*PRODUCT).agg(_qty_sum().alias("total_qty"),
                                       *[F.max(c).alias(f"latest_{c}") for c in stamp_cols])


def category_rollup(stock: DataFrame) -> DataFrame:
    """rollup(category, brand, size) with row types DETAIL,
    BRAND_SUBTOTAL, CATEGORY_SUBTOTAL, GRAND_TOTAL."""
    g = (stock.rollup("Brand_Category", "Brand", "Size_ML")
         .agg(_qty_sum().alias("total_qty"), F.grouping_id().alias("_gid")))
    row_type = (F.when(F.col("_gid") == 0, "DETAIL").when(F.col("_gid") == 1, "BRAND_SUBTOTAL")
                .when(F.col("_gid") == 3, "CATEGORY_SUBTOTAL").otherwise("GRAND_TOTAL"))
    return g.withColumn(ROW_TYPE, row_type).drop("_gid")


def brand_size_rollup(stock: DataFrame) -> DataFrame:
    """Total, by brand, by brand + size."""
    g = stock.rollup("Brand", "Size_ML").agg(_qty_sum().alias("total_qty"), F.grouping_id().alias("_gid"))
    row_type = F.when(F.col("_gid") == 0, "BRAND_SIZE").when(F.col("_gid") == 1, "BRAND").otherwise("TOTAL")
    return g.withColumn(ROW_TYPE, row_type).drop("_gid")


def category_brand_totals(stock: DataFrame) -> DataFrame:
    """Totals per (category, brand); NULL quantity counts as 0."""
    return stock.groupBy("Brand_Category", "Brand").agg(
        F.sum(F.coalesce(F.col("Qty"), F.lit(0))).cast("bigint").alias("total_qty"),
        F.count(F.lit(1)).alias("records"))


def group_summary(df: DataFrame, field: str, qty_col: str = "Qty") -> DataFrame:
    """Records and quantity per value of ``field``; the NULL group
    is kept; most records first."""
    return (df.groupBy(field).agg(F.count(F.lit(1)).alias("records"), _qty_sum(qty_col).alias("total_qty"))
            .orderBy(F.col("records").desc(), F.col(field).asc_nulls_last()))


def table_summary(tables: dict[str, DataFrame], qty_col: str = "Qty") -> DataFrame:
    """Per table, record count and quantity total (union of one-row
    aggregates)."""
    parts = [df.agg(F.count(F.lit(1)).alias("records"), _qty_sum(qty_col).alias("total_qty"))
             .select(F.lit(name).alias("table_name"), "records", "total_qty") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metric_cards(lines: DataFrame) -> DataFrame:
    """One row of dashboard metrics over voucher lines."""
    return lines.agg(
        F.count(F.lit(1)).alias("rows"),
        _qty_sum("quantity").alias("total_qty"),
        _money_sum("amount").alias("total_amount"),
        F.countDistinct("brand").alias("distinct_brands"),
        F.countDistinct("stock_item_name").alias("distinct_items"),
        F.countDistinct("size_ml").alias("distinct_sizes"),
        mean("rate").alias("avg_rate"))


def brand_size_summary(lines: DataFrame) -> DataFrame:
    """Per (brand, size): quantity, amount, mean rate."""
    return lines.groupBy("brand", "size_ml").agg(
        _qty_sum("quantity").alias("total_qty"), _money_sum("amount").alias("total_amount"),
        mean("rate").alias("avg_rate"))


def supplier_summary(lines: DataFrame, supplier_col: str = "supplier_name") -> DataFrame:
    """Per supplier: quantity, amount, distinct items."""
    return lines.groupBy(supplier_col).agg(
        _qty_sum("quantity").alias("total_qty"), _money_sum("amount").alias("total_amount"),
        F.countDistinct("stock_item_name").alias("distinct_items"))


def totals_by(lines: DataFrame, key: str) -> DataFrame:
    """Quantity and amount by one column (size, godown); NULL keys are
    dropped as pandas ``groupby`` does."""
    return (lines.where(F.col(key).isNotNull()).groupBy(key)
            .agg(_qty_sum("quantity").alias("total_qty"), _money_sum("amount").alias("total_amount")))


def item_sales(lines: DataFrame, date_col: str = "voucher_date") -> DataFrame:
    """A24 + A25: per (date, item, brand, size, rate, unit): quantity, amount,
    line count, and the calculated amount ``qty * rate`` beside the recorded
    one."""
    g = lines.groupBy(date_col, "stock_item_name", "brand", "size_ml", "rate", "unit").agg(
        _qty_sum("quantity").alias("total_qty"), _money_sum("amount").alias("total_amount"),
        F.count(F.lit(1)).alias("line_count"))
    return g.withColumn("calculated_amount", (F.col("total_qty") * F.col("rate")).cast(MONEY_SUM))


def item_sales_totals(lines: DataFrame, date_col: str = "voucher_date") -> DataFrame:
    """A24 totals: per date, all items."""
    return lines.groupBy(date_col).agg(_qty_sum("quantity").alias("total_qty"),
                                       _money_sum("amount").alias("total_amount"),
                                       F.count(F.lit(1)).alias("line_count"))


def sum_by(df: DataFrame, keys: list[str], value: str = "Qty", name: str = "total_qty") -> DataFrame:
    """Plain grouped sum."""
    return df.groupBy(*keys).agg(_qty_sum(value).alias(name))


def product_stats(df: DataFrame, value: str = "Qty") -> DataFrame:
    """Sum and mean per product."""
    return df.groupBy(*PRODUCT).agg(_qty_sum(value).alias("total_qty"), mean(value).alias("mean_qty"))


def with_grand_total(priced: DataFrame, amount_col: str = "total", name: str = "grand_total") -> DataFrame:
    """Total revenue on every row, as a scalar subquery (computed once
    with partial sums per task, no single-partition window)."""
    total = priced.select(_money_sum(amount_col)).scalar()
    return priced.withColumn(name, total)


# -- accounting lines: aggregate per item first, derive item attributes after --------------------
#
# Brand, size and unit are functions of the item name, so the line-level
# reports group by the name first (a partial aggregation that shrinks the
# rows to the item catalogue) and parse the name only once per distinct
# item instead of once per line. Results equal the line-level forms.

def _per_item(lines: DataFrame, keys: list[str], name_col: str = "stock_item_name") -> DataFrame:
    return lines.groupBy(name_col, *keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("quantity").alias("_qty"), F.sum("amount").alias("_amt"),
        F.sum("rate").alias("_rate_sum"), F.count("rate").alias("_rate_n"))


def metric_cards_by_item(lines: DataFrame, attributes) -> DataFrame:
    """A20 with ``attributes(df)`` adding brand / size_ml to distinct items."""
    items = attributes(_per_item(lines, []))
    return items.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.sum("_qty"), F.lit(0)).cast("bigint").alias("total_qty"),
        F.coalesce(F.sum("_amt"), F.lit(0)).cast(MONEY_SUM).alias("total_amount"),
        F.countDistinct("brand").alias("distinct_brands"),
        F.countDistinct("stock_item_name").alias("distinct_items"),
        F.countDistinct("size_ml").alias("distinct_sizes"),
        ratio(F.sum("_rate_sum"), F.sum("_rate_n")).alias("avg_rate"))


def brand_size_summary_by_item(lines: DataFrame, attributes) -> DataFrame:
    """A21 via per-item totals."""
    items = attributes(_per_item(lines, []))
    return items.groupBy("brand", "size_ml").agg(
        F.coalesce(F.sum("_qty"), F.lit(0)).cast("bigint").alias("total_qty"),
        F.coalesce(F.sum("_amt"), F.lit(0)).cast(MONEY_SUM).alias("total_amount"),
        ratio(F.sum("_rate_sum"), F.sum("_rate_n")).alias("avg_rate"))


def totals_by_item_attribute(lines: DataFrame, attributes, key: str) -> DataFrame:
    """A23 (size) via per-item totals; NULL keys dropped."""
    items = attributes(_per_item(lines, []))
    return (items.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.coalesce(F.sum("_qty"), F.lit(0)).cast("bigint").alias("total_qty"),
                 F.coalesce(F.sum("_amt"), F.lit(0)).cast(MONEY_SUM).alias("total_amount")))


def item_sales_by_item(lines: DataFrame, attributes, date_col: str = "voucher_date") -> DataFrame:
    """A24 + A25 via per-(date, item, rate) totals."""
    g = attributes(_per_item(lines, [date_col, "rate"]))
    out = g.select(date_col, "stock_item_name", "brand", "size_ml", "rate", "unit",
                   F.coalesce(F.col("_qty"), F.lit(0)).cast("bigint").alias("total_qty"),
                   F.coalesce(F.col("_amt"), F.lit(0)).cast(MONEY_SUM).alias("total_amount"),
                   F.col("_rows").alias("line_count"))
    return out.withColumn("calculated_amount", (F.col("total_qty") * F.col("rate")).cast(MONEY_SUM))
