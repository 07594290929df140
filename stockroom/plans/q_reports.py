"""Registered report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pricing, reports
from ..operators.items import with_item_attributes
from ..sources.testdata import ShopData
from .registry import D, M, R, register, with_ctes

PRODUCT = ["Brand_Category", "Brand", "Size_ML"]
P = "Brand_Category, Brand, Size_ML"
Q = "CAST(COALESCE(SUM(Qty), 0) AS BIGINT)"
A = "COALESCE(SUM(total), 0)"


def priced(d: ShopData):
    """Three-key price join, unknown products priced at 0."""
    return pricing.price_sales(d.daily_sales(), d.price_list())


def priced3n(d: ShopData):
    """Three keys, unknown price stays NULL."""
    return pricing.price_sales(d.daily_sales(), d.price_list(), unmatched="null")


def priced2n(d: ShopData):
    """Brand + Size only, unknown price stays NULL."""
    return pricing.price_sales(d.daily_sales(), d.price_list(), keys=["Brand", "Size_ML"], unmatched="null")


# -- joins ---------------------------------------------------------------------

@register("j01_sales_price_lookup", with_ctes(
    "SELECT Date, Brand_Category, Brand, Size_ML, Qty, unit_price, total FROM priced", "priced"))
def j01(d):
    """Every sale with its unit price (0 when unknown) and line total."""
    return priced(d).select("Date", *PRODUCT, "Qty", "unit_price", "total")


@register("j02_sales_price_two_keys", with_ctes(
    "SELECT Date, Brand_Category, Brand, Size_ML, Qty, unit_price, total FROM priced2n", "priced2n"))
def j02(d):
    """Brand + Size join; unknown price stays NULL."""
    return priced2n(d).select("Date", *PRODUCT, "Qty", "unit_price", "total")


@register("j03_sales_price_null_kept", with_ctes(
    "SELECT Date, Brand_Category, Brand, Size_ML, Qty, unit_price, total FROM priced3n", "priced3n"))
def j03(d):
    """Three-key join, pandas form (NULL kept)."""
    return priced3n(d).select("Date", *PRODUCT, "Qty", "unit_price", "total")


@register("j04_opening_stock_enriched", with_ctes(f"""
SELECT m.Date, m.Brand_Category, m.Brand, m.Size_ML, m.Qty,
       COALESCE(p.Sl_No, 999999) AS Sl_No, COALESCE(p.Mrp, CAST(0 AS DECIMAL(18,2))) AS Mrp
FROM monthly_stock m LEFT JOIN price_list p
  ON m.Brand_Category = p.Brand_Category AND m.Brand = p.Brand AND m.Size_ML = p.Size_ML""",
    "monthly_stock", "price_list"))
def j04(d):
    """Opening stock with serial number (999999 when unknown) and price."""
    out = pricing.enrich_stock_with_prices(d.monthly_stock(), d.price_list())
    return out.select("Date", *PRODUCT, "Qty", "Sl_No", "Mrp").orderBy("Sl_No", *PRODUCT)


# -- period reports (Mongo path: J1) -----------------------------------------------

@register("a01_iso_week_sales", with_ctes(f"""
SELECT CAST(ISOYEAR(Date) AS INTEGER) AS year, CAST(WEEKOFYEAR(Date) AS INTEGER) AS week,
       {Q} AS total_quantity_sold, {M(A)} AS total_sales_amount
FROM priced GROUP BY 1, 2""", "priced"))
def a01(d):
    """A1: totals per ISO week (year = ISO week-year)."""
    return reports.sales_by_period(priced(d), "isoweek").orderBy("year", "week")


@register("a02_month_sales", with_ctes(f"""
SELECT CAST(YEAR(Date) AS INTEGER) AS year, CAST(MONTH(Date) AS INTEGER) AS month,
       {Q} AS total_quantity_sold, {M(A)} AS total_sales_amount
FROM priced GROUP BY 1, 2""", "priced"))
def a02(d):
    """A2: totals per calendar month."""
    return reports.sales_by_period(priced(d), "month").orderBy("year", "month")


@register("a03_iso_week_product_sales", with_ctes(f"""
SELECT CAST(ISOYEAR(Date) AS INTEGER) AS year, CAST(WEEKOFYEAR(Date) AS INTEGER) AS week, {P},
       {Q} AS total_quantity_sold, {M(A)} AS total_sales_amount
FROM priced GROUP BY 1, 2, {P}""", "priced"))
def a03(d):
    """A3: ISO-week totals per product."""
    return reports.sales_by_period(priced(d), "isoweek", by=PRODUCT)


@register("a04_month_product_sales", with_ctes(f"""
SELECT CAST(YEAR(Date) AS INTEGER) AS year, CAST(MONTH(Date) AS INTEGER) AS month, {P},
       {Q} AS total_quantity_sold, {M(A)} AS total_sales_amount
FROM priced GROUP BY 1, 2, {P}""", "priced"))
def a04(d):
    """A4: month totals per product (the flagship report)."""
    return reports.sales_by_period(priced(d), "month", by=PRODUCT)


# -- pandas path (J3 / J2, NULL prices skipped) ------------------------------------------

@register("a05_year_month_product_sales", with_ctes(f"""
SELECT STRFTIME(Date, '%Y-%m') AS YearMonth, {P}, {Q} AS Qty, {M(A)} AS Sales_Amount
FROM priced3n GROUP BY 1, {P}""", "priced3n"))
def a05(d):
    """A5: YearMonth x product (the table written per month)."""
    return reports.sales_by_period(priced3n(d), "yearmonth", by=PRODUCT, qty_name="Qty",
                                   amount_name="Sales_Amount")


@register("a06_year_month_totals", with_ctes(f"""
SELECT STRFTIME(Date, '%Y-%m') AS YearMonth, {Q} AS Qty, {M(A)} AS Total_Sales_Amount
FROM priced3n GROUP BY 1""", "priced3n"))
def a06(d):
    """Month grand totals."""
    return reports.sales_by_period(priced3n(d), "yearmonth", qty_name="Qty", amount_name="Total_Sales_Amount")


@register("a07_daily_totals", with_ctes(f"""
SELECT Date, {Q} AS Total_Qty, {M(A)} AS Total_Sales FROM priced2n GROUP BY Date""", "priced2n"))
def a07(d):
    """Day totals."""
    return reports.sales_by_period(priced2n(d), "day", qty_name="Total_Qty", amount_name="Total_Sales")


@register("a08_daily_product_totals", with_ctes(f"""
SELECT Date, {P}, {Q} AS Total_Qty, {M(A)} AS Total_Sales FROM priced2n GROUP BY Date, {P}""", "priced2n"))
def a08(d):
    """Day x product totals."""
    return reports.sales_by_period(priced2n(d), "day", by=PRODUCT, qty_name="Total_Qty",
                                   amount_name="Total_Sales")


@register("a09_grand_total", with_ctes(f"""
SELECT {Q} AS total_qty, {M(A)} AS total_revenue FROM priced2n""", "priced2n"))
def a09(d):
    """One-row grand total."""
    return reports.sales_by_period(priced2n(d), "all", qty_name="total_qty", amount_name="total_revenue")


@register("a10_category_subtotals", with_ctes(f"""
SELECT Date, COALESCE(Brand_Category, 'N/A') AS Brand_Category, {Q} AS total_qty, {M(A)} AS total_amount
FROM priced GROUP BY 1, 2""", "priced"))
def a10(d):
    """A10: per date, subtotals by category."""
    return reports.subtotals_by(priced(d), "Brand_Category")


@register("a10_brand_subtotals", with_ctes(f"""
SELECT Date, COALESCE(Brand, 'N/A') AS Brand, {Q} AS total_qty, {M(A)} AS total_amount
FROM priced GROUP BY 1, 2""", "priced"))
def a10b(d):
    """A10: per date, subtotals by brand."""
    return reports.subtotals_by(priced(d), "Brand")


@register("a11_detail_lines", with_ctes(f"""
SELECT Date, {P}, Qty, unit_price, total AS line_total FROM priced""", "priced"))
def a11(d):
    """Detail lines with unit price and line total (all dates)."""
    return reports.detail_lines(priced(d))


@register("a12_sales_summary", with_ctes(f"""
SELECT Date, {P}, {Q} AS total_qty, {M(A)} AS total_amount,
       CASE GROUPING(Date, Brand_Category, Brand, Size_ML) WHEN 0 THEN 'DETAIL' WHEN 8 THEN 'SUBTOTAL'
            ELSE 'GRAND_TOTAL' END AS Row_Type
FROM priced GROUP BY GROUPING SETS ((Date, {P}), ({P}), ())""", "priced"))
def a12(d):
    """Detail + product subtotals + grand total in one rowset."""
    out = reports.sales_summary(priced(d))
    # grouping_id over (Date, product...) is 8 for the product subtotal.
    return out


@register("a13_stock_in_hand", with_ctes(f"""
SELECT Date, {P}, {Q} AS total_qty,
       CASE WHEN GROUPING(Date, Brand_Category, Brand, Size_ML) = 0 THEN 'DETAIL' ELSE 'GRAND_TOTAL' END AS Row_Type
FROM (SELECT * FROM monthly_stock UNION ALL SELECT * FROM incoming_stock) s
GROUP BY GROUPING SETS ((Date, {P}), ())""", "monthly_stock", "incoming_stock"))
def a13(d):
    """Stock in hand (opening + receipts) by date and product, plus a grand total."""
    return reports.stock_in_hand(d.monthly_stock().unionByName(d.incoming_stock()))


@register("a14_total_stock_latest", with_ctes(f"""
SELECT {P}, {Q} AS total_qty, MAX(Date) AS latest_Date FROM incoming_stock GROUP BY {P}""", "incoming_stock"))
def a14(d):
    """Total receipts per product with the latest stamp."""
    return reports.total_stock_with_stamps(d.incoming_stock(), ["Date"])


@register("a15_category_rollup", with_ctes(f"""
SELECT {P}, {Q} AS total_qty,
       CASE GROUPING(Brand_Category, Brand, Size_ML) WHEN 0 THEN 'DETAIL' WHEN 1 THEN 'BRAND_SUBTOTAL'
            WHEN 3 THEN 'CATEGORY_SUBTOTAL' ELSE 'GRAND_TOTAL' END AS Row_Type
FROM incoming_stock GROUP BY ROLLUP (Brand_Category, Brand, Size_ML)""", "incoming_stock"))
def a15(d):
    """Category / brand / size roll-up of receipts."""
    return reports.category_rollup(d.incoming_stock())


@register("a16_brand_size_rollup", with_ctes(f"""
SELECT Brand, Size_ML, {Q} AS total_qty,
       CASE GROUPING(Brand, Size_ML) WHEN 0 THEN 'BRAND_SIZE' WHEN 1 THEN 'BRAND' ELSE 'TOTAL' END AS Row_Type
FROM monthly_stock GROUP BY ROLLUP (Brand, Size_ML)""", "monthly_stock"))
def a16(d):
    """Opening stock total, by brand, by brand + size."""
    return reports.brand_size_rollup(d.monthly_stock())


@register("a17_category_brand_totals", with_ctes("""
SELECT Brand_Category, Brand, CAST(SUM(COALESCE(Qty, 0)) AS BIGINT) AS total_qty, COUNT(*) AS records
FROM monthly_stock GROUP BY Brand_Category, Brand""", "monthly_stock"))
def a17(d):
    """Category + brand totals of the opening stock."""
    return reports.category_brand_totals(d.monthly_stock())


@register("a18_group_summary", with_ctes(f"""
SELECT Brand_Category, COUNT(*) AS records, {Q} AS total_qty FROM daily_sales GROUP BY Brand_Category""",
    "daily_sales"))
def a18(d):
    """Records and quantity per category, NULL group kept."""
    return reports.group_summary(d.daily_sales(), "Brand_Category")


@register("a19_table_summary", with_ctes(f"""
SELECT 'daily_sales' AS table_name, COUNT(*) AS records, {Q} AS total_qty FROM daily_sales
UNION ALL SELECT 'incoming_stock', COUNT(*), {Q} FROM incoming_stock
UNION ALL SELECT 'monthly_stock', COUNT(*), {Q} FROM monthly_stock""",
    "daily_sales", "incoming_stock", "monthly_stock"))
def a19(d):
    """Record count and quantity per table."""
    return reports.table_summary({"daily_sales": d.daily_sales(), "incoming_stock": d.incoming_stock(),
                                  "monthly_stock": d.monthly_stock()})


TQ = "CAST(COALESCE(SUM(quantity), 0) AS BIGINT)"
TA = "COALESCE(SUM(amount), 0)"


@register("a20_metric_cards", with_ctes(f"""
SELECT COUNT(*) AS rows, {TQ} AS total_qty, {M(TA)} AS total_amount,
       COUNT(DISTINCT brand) AS distinct_brands, COUNT(DISTINCT stock_item_name) AS distinct_items,
       COUNT(DISTINCT size_ml) AS distinct_sizes, {R('SUM(rate)', 'COUNT(rate)')} AS avg_rate
FROM account_lines""", "account_lines"))
def a20(d):
    """Dashboard metrics over voucher lines."""
    return reports.metric_cards_by_item(d.voucher_lines(), with_item_attributes)


@register("a21_brand_size_summary", with_ctes(f"""
SELECT brand, size_ml, {TQ} AS total_qty, {M(TA)} AS total_amount, {R('SUM(rate)', 'COUNT(rate)')} AS avg_rate
FROM account_lines GROUP BY brand, size_ml""", "account_lines"))
def a21(d):
    """Brand x size: quantity, amount, mean rate."""
    return reports.brand_size_summary_by_item(d.voucher_lines(), with_item_attributes)


@register("a22_supplier_summary", with_ctes(f"""
SELECT supplier_name, {TQ} AS total_qty, {M(TA)} AS total_amount, COUNT(DISTINCT stock_item_name) AS distinct_items
FROM voucher_lines GROUP BY supplier_name""", "voucher_lines"))
def a22(d):
    """Per supplier: quantity, amount, distinct items."""
    return reports.supplier_summary(d.voucher_lines())


@register("a23_size_totals", with_ctes(f"""
SELECT size_ml, {TQ} AS total_qty, {M(TA)} AS total_amount FROM account_lines
WHERE size_ml IS NOT NULL GROUP BY size_ml""", "account_lines"))
def a23(d):
    """Totals by size."""
    return reports.totals_by_item_attribute(d.voucher_lines(), with_item_attributes, "size_ml")


@register("a23_godown_totals", with_ctes(f"""
SELECT godown, {TQ} AS total_qty, {M(TA)} AS total_amount FROM voucher_lines
WHERE godown IS NOT NULL GROUP BY godown""", "voucher_lines"))
def a23b(d):
    """Totals by godown."""
    return reports.totals_by(d.voucher_lines(), "godown")


@register("a24_item_sales", with_ctes(f"""
SELECT voucher_date, stock_item_name, brand, size_ml, rate, unit, {TQ} AS total_qty, {M(TA)} AS total_amount,
       COUNT(*) AS line_count, CAST({TQ} * rate AS DOUBLE) AS calculated_amount
FROM account_lines GROUP BY voucher_date, stock_item_name, brand, size_ml, rate, unit""", "account_lines"))
def a24(d):
    """A24 + A25: item sales per date with calculated beside recorded amount."""
    return reports.item_sales_by_item(d.voucher_lines(), with_item_attributes)


@register("a24_item_sales_totals", with_ctes(f"""
SELECT voucher_date, {TQ} AS total_qty, {M(TA)} AS total_amount, COUNT(*) AS line_count
FROM voucher_lines GROUP BY voucher_date""", "voucher_lines"))
def a24t(d):
    """Per-date totals over all items."""
    return reports.item_sales_totals(d.voucher_lines())


@register("a26_date_category_brand_sum", with_ctes(f"""
SELECT Date, Brand_Category, Brand, {Q} AS total_qty FROM daily_sales GROUP BY Date, Brand_Category, Brand""",
    "daily_sales"))
def a26(d):
    """Quantity by (Date, Category, Brand)."""
    return reports.sum_by(d.daily_sales(), ["Date", "Brand_Category", "Brand"])


@register("a27_product_stats", with_ctes(f"""
SELECT {P}, {Q} AS total_qty, {R('SUM(Qty)', 'COUNT(Qty)')} AS mean_qty FROM daily_sales GROUP BY {P}""",
    "daily_sales"))
def a27(d):
    """Sum and mean per product."""
    return reports.product_stats(d.daily_sales())


@register("a27_month_totals", with_ctes(f"""
SELECT STRFTIME(Date, '%Y-%m') AS YearMonth, {Q} AS total_qty FROM daily_sales GROUP BY 1""", "daily_sales"))
def a27m(d):
    """Quantity per calendar month."""
    return reports.sum_by(d.daily_sales().withColumn("YearMonth", F.date_format("Date", "yyyy-MM")),
                          ["YearMonth"])


@register("a28_revenue_on_every_row", with_ctes(f"""
SELECT Date, {P}, Qty, total, (SELECT {M(A)} FROM priced) AS grand_total FROM priced""", "priced"))
def a28(d):
    """The total revenue on every sales row."""
    return reports.with_grand_total(priced(d)).select("Date", *PRODUCT, "Qty", "total", "grand_total")


@register("a30_collapse_products", with_ctes(f"""
SELECT {P}, {Q} AS Qty FROM incoming_stock GROUP BY {P}""", "incoming_stock"))
def a30(d):
    """One row per product over all dates."""
    return reports.sum_by(d.incoming_stock(), PRODUCT, name="Qty")
