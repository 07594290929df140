"""Registered filter, sort, window, set and series queries (F, T, W, U, Z4, Z7, Z9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import fmt_year_month
from ..operators import analytics, filters, ordering, pricing, reports, series, sets
from .q_reports import priced
from .registry import D, M, R, register, with_ctes

PRODUCT = ["Brand_Category", "Brand", "Size_ML"]
P = "Brand_Category, Brand, Size_ML"
SALE_COLS = ["Date", *PRODUCT, "Qty"]

# Fixed parameters of the registered filter queries.
BRAND, CATEGORY, SIZE = "Brand#13", "PROMO", 11
RANGE_START, RANGE_END = "1996-01-01", "1996-12-31"
LOW_STOCK_LEVEL = 60
PAGE_NO, PAGE_SIZE = 3, 25
DEEP_PAGE, DEEP_SIZE = 2500, 20
TREND_DAYS = 30


# -- filters -------------------------------------------------------------------

@register("f01_exact_filters", with_ctes(f"""
SELECT Date, {P}, Qty FROM daily_sales WHERE Brand = '{BRAND}' AND Brand_Category = '{CATEGORY}'""",
    "daily_sales"))
def f01(d):
    """optional exact filters (brand and category given, size absent)."""
    return filters.exact_filters(d.daily_sales(), Brand=BRAND, Brand_Category=CATEGORY, Size_ML=None)


@register("f02_date_range", with_ctes(f"""
SELECT Date, {P}, Qty, total FROM priced WHERE Date >= DATE '{RANGE_START}' AND Date <= DATE '{RANGE_END}'""",
    "priced"))
def f02(d):
    """inclusive date range."""
    return filters.date_range(priced(d), "Date", RANGE_START, RANGE_END).select(*SALE_COLS, "total")


@register("f03_latest_date_rows", with_ctes(f"""
SELECT Date, {P}, Qty FROM daily_sales WHERE Date = (SELECT MAX(Date) FROM daily_sales)""", "daily_sales"))
def f03(d):
    """F3 + F11 default: rows of the newest date."""
    return filters.on_latest_date(d.daily_sales())


@register("f04_search_literal", with_ctes("""
SELECT Brand, Brand_Category, Size_ML, Sl_No, Mrp FROM price_list WHERE CONTAINS(LOWER(Brand), 'brand#1')""",
    "price_list"))
def f04(d):
    """case-insensitive substring search on one column."""
    return d.price_list().filter(filters.contains_ci("Brand", "BRAND#1"))


@register("f04_search_regex", with_ctes("""
SELECT Brand, Brand_Category, Size_ML, Sl_No, Mrp FROM price_list
WHERE REGEXP_MATCHES(Brand, '(?i)brand#2[0-9]')""", "price_list"))
def f04r(d):
    """case-insensitive regular expression on one column."""
    return d.price_list().filter(filters.contains_ci("Brand", "brand#2[0-9]", regex=True))


@register("f05_search_any_column", with_ctes("""
SELECT guid, voucher_date, party_name, stock_item_name, quantity FROM voucher_lines
WHERE COALESCE(CONTAINS(LOWER(stock_item_name), 'ring'), FALSE) OR COALESCE(CONTAINS(LOWER(party_name), 'ring'), FALSE)""",
    "voucher_lines"))
def f05(d):
    """OR search across columns."""
    out = filters.search_any(d.voucher_lines(), ["stock_item_name", "party_name"], "ring")
    return out.select("guid", "voucher_date", "party_name", "stock_item_name", "quantity")


@register("f06_members_and_ranges", with_ctes("""
SELECT guid, godown, stock_item_name, quantity, amount FROM voucher_lines
WHERE godown IN ('NATION_1', 'NATION_2', 'NATION_3') AND quantity >= 10 AND quantity <= 20""", "voucher_lines"))
def f06(d):
    """membership and numeric range filters."""
    out = filters.members_and_ranges(d.voucher_lines(), {"godown": ["NATION_1", "NATION_2", "NATION_3"]},
                                     {"quantity": (10, 20)})
    return out.select("guid", "godown", "stock_item_name", "quantity", "amount")


@register("f07_negative_movements", with_ctes("""
SELECT event_id, STRFTIME(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, delta FROM stock_movements WHERE delta < 0""",
    "stock_movements"))
def f07(d):
    """sign filter (negative amounts)."""
    return filters.sign_filter(d.stock_movements(), "delta", "negative")


@register("f08_text_equals", with_ctes(f"""
SELECT Date, {P}, Qty FROM daily_sales WHERE CAST(Size_ML AS VARCHAR) = '{SIZE}'""", "daily_sales"))
def f08(d):
    """F8: compare a field as text; 'All' passes for the others."""
    return filters.text_equals(d.daily_sales(), Size_ML=SIZE, Brand="All")


@register("f09_brand_options", with_ctes(f"""
SELECT DISTINCT Brand FROM price_list WHERE Brand_Category = '{CATEGORY}' AND Brand IS NOT NULL""", "price_list"))
def f09(d):
    """brands offered in one category."""
    return filters.option_list(d.price_list(), "Brand", Brand_Category=CATEGORY)


@register("f09_size_options", with_ctes(f"""
SELECT DISTINCT Size_ML FROM price_list WHERE Brand_Category = '{CATEGORY}' AND Brand = '{BRAND}'""",
    "price_list"))
def f09s(d):
    """sizes of one category + brand (cascading)."""
    return filters.option_list(d.price_list(), "Size_ML", Brand_Category=CATEGORY, Brand=BRAND)


@register("f10_product_tree", with_ctes("""
SELECT Brand_Category, TO_JSON(MAP_FROM_ENTRIES(LIST(STRUCT_PACK(k := Brand, v := sizes) ORDER BY Brand))) AS brands
FROM (SELECT Brand_Category, Brand, LIST_SORT(LIST_DISTINCT(LIST(Size_ML))) AS sizes FROM price_list
      GROUP BY Brand_Category, Brand) t GROUP BY Brand_Category""", "price_list"))
def f10(d):
    """category -> brand -> sorted sizes, as JSON text per category."""
    t = filters.product_tree(d.price_list())
    return t.select("Brand_Category", F.to_json("brands").alias("brands"))


@register("f11_available_dates", with_ctes("""
SELECT DISTINCT Date FROM daily_sales WHERE Date IS NOT NULL""", "daily_sales"))
def f11(d):
    """distinct dates, newest first."""
    return filters.available_dates(d.daily_sales())


@register("f12_prices_of_size", with_ctes(f"""
SELECT Brand, Brand_Category, Size_ML, Sl_No, Mrp, COUNT(*) OVER () AS match_count
FROM price_list WHERE Size_ML = {SIZE}""", "price_list"))
def f12(d):
    """all prices of one size, with the count."""
    return pricing.price_lookup(d.price_list(), size=SIZE)


FIRST = "(SELECT {c} FROM price_list ORDER BY Sl_No LIMIT 1)"


def _first_product(d, col):
    """A lookup key taken from the data: the product with the lowest serial."""
    return d.price_list().orderBy("Sl_No").limit(1).select(col).scalar()


@register("f12_price_by_product", with_ctes(f"""
SELECT Brand, Brand_Category, Size_ML, Sl_No, Mrp, COUNT(*) OVER () AS match_count FROM price_list
WHERE Brand = {FIRST.format(c="Brand")} AND Size_ML = {FIRST.format(c="Size_ML")}
  AND Brand_Category = {FIRST.format(c="Brand_Category")}""", "price_list"))
def f12p(d):
    """price by the full product key (the first product of the list)."""
    return pricing.price_lookup(d.price_list(), brand=_first_product(d, "Brand"), size=_first_product(d, "Size_ML"),
                                category=_first_product(d, "Brand_Category"))


@register("f12_price_by_brand_size", with_ctes(f"""
SELECT Brand, Brand_Category, Size_ML, Sl_No, Mrp, COUNT(*) OVER () AS match_count FROM price_list
WHERE Brand = {FIRST.format(c="Brand")} AND Size_ML = {FIRST.format(c="Size_ML")}""", "price_list"))
def f12b(d):
    """prices by brand + size (one per category)."""
    return pricing.price_lookup(d.price_list(), brand=_first_product(d, "Brand"), size=_first_product(d, "Size_ML"))


@register("f13_low_stock", with_ctes(f"""
SELECT {P}, Qty, {LOW_STOCK_LEVEL} AS reorder_level FROM monthly_stock WHERE Qty <= {LOW_STOCK_LEVEL}""",
    "monthly_stock"))
def f13(d):
    """stock at or below the reorder level."""
    stock = d.monthly_stock().select(*PRODUCT, "Qty", F.lit(LOW_STOCK_LEVEL).alias("reorder_level"))
    return filters.low_stock(stock, "Qty", "reorder_level")


@register("f14_stock_status", with_ctes(f"""
SELECT n.{P.replace(', ', ', n.')}, n.quantity, COALESCE(p.Mrp, CAST(0 AS DECIMAL(18,2))) AS rate,
       CASE WHEN n.quantity <= 0 THEN 'NOT AVAILABLE' WHEN n.quantity <= 5 THEN 'LOW STOCK' ELSE 'AVAILABLE' END
         AS stock_status,
       CASE WHEN COALESCE(p.Mrp, 0) <= 0 THEN 'Price not configured' ELSE 'configured' END AS price_status
FROM (SELECT {P}, CAST(SUM(q) AS BIGINT) AS quantity FROM (
        SELECT {P}, Qty AS q FROM monthly_stock UNION ALL SELECT {P}, Qty FROM incoming_stock
        UNION ALL SELECT {P}, -Qty FROM daily_sales) u GROUP BY {P}) n
LEFT JOIN price_list p ON n.Brand_Category = p.Brand_Category AND n.Brand = p.Brand AND n.Size_ML = p.Size_ML""",
    "monthly_stock", "incoming_stock", "daily_sales", "price_list"))
def f14(d):
    """stock and price status of every product (net stock = opening +
    receipts - sales)."""
    signed = sets.union_all([d.monthly_stock().select(*PRODUCT, F.col("Qty").alias("q")),
                             d.incoming_stock().select(*PRODUCT, F.col("Qty").alias("q")),
                             d.daily_sales().select(*PRODUCT, (-F.col("Qty")).alias("q"))], source_col=None)
    net = signed.groupBy(*PRODUCT).agg(F.sum("q").cast("bigint").alias("quantity"))
    enriched = pricing.enrich_stock_with_prices(net, d.price_list()).withColumnRenamed("Mrp", "rate").drop("Sl_No")
    return filters.stock_status(enriched, "quantity", "rate")


# -- sort / top-k / paging -------------------------------------------------------------

@register("t01_price_list_sorted", with_ctes("SELECT Brand, Brand_Category, Size_ML, Sl_No, Mrp FROM price_list",
                                             "price_list"))
def t01(d):
    """Multi-key ascending sort."""
    return ordering.sort_by(d.price_list(), ["Sl_No", *PRODUCT])


@register("t02_user_sort", with_ctes("SELECT Brand, Brand_Category, Size_ML, Sl_No, Mrp FROM price_list",
                                     "price_list"))
def t02(d):
    """Sort by a user-chosen column and direction."""
    return ordering.user_sort(d.price_list(), "Mrp", "desc")


@register("t03_top_brands_by_amount", with_ctes(f"""
SELECT Brand, {M('COALESCE(SUM(total), 0)')} AS total FROM priced GROUP BY Brand
ORDER BY COALESCE(SUM(total), 0) DESC, Brand LIMIT 20""", "priced"))
def t03a(d):
    """Top 20 brands by amount."""
    return ordering.top_k_groups(priced(d), ["Brand"], "total", 20)


@register("t03_top_brands_by_qty", with_ctes("""
SELECT Brand, SUM(Qty) AS total FROM daily_sales GROUP BY Brand ORDER BY SUM(Qty) DESC, Brand LIMIT 20""",
    "daily_sales"))
def t03q(d):
    """Top 20 brands by quantity."""
    return ordering.top_k_groups(d.daily_sales(), ["Brand"], "Qty", 20)


@register("t03_top_suppliers", with_ctes(f"""
SELECT supplier_name, {M('SUM(amount)')} AS total FROM voucher_lines GROUP BY supplier_name
ORDER BY SUM(amount) DESC, supplier_name LIMIT 20""", "voucher_lines"))
def t03s(d):
    """Top 20 suppliers by purchase amount."""
    return ordering.top_k_groups(d.voucher_lines(), ["supplier_name"], "amount", 20)


@register("t04_top_products", with_ctes(f"""
SELECT {P}, SUM(Qty) AS total FROM daily_sales GROUP BY {P} ORDER BY SUM(Qty) DESC, {P} LIMIT 5""",
    "daily_sales"))
def t04(d):
    """T4: top 5 products by quantity."""
    return ordering.top_k_groups(d.daily_sales(), PRODUCT, "Qty", 5)


@register("t04_most_frequent_items", with_ctes("""
SELECT stock_item_name, COUNT(*) AS count FROM voucher_lines WHERE stock_item_name IS NOT NULL
GROUP BY stock_item_name ORDER BY COUNT(*) DESC, stock_item_name LIMIT 10""", "voucher_lines"))
def t04f(d):
    """T4: the 10 most frequent item names."""
    return ordering.most_frequent(d.voucher_lines(), "stock_item_name", 10)


@register("t05_page", with_ctes(f"""
SELECT Brand, Brand_Category, Size_ML, Sl_No, Mrp,
       CAST(GREATEST(1, CEIL((SELECT COUNT(*) FROM price_list) / {PAGE_SIZE}.0)) AS INTEGER) AS total_pages,
       {PAGE_NO} AS page
FROM price_list ORDER BY Sl_No LIMIT {PAGE_SIZE} OFFSET {(PAGE_NO - 1) * PAGE_SIZE}""", "price_list"))
def t05(d):
    """T5: page 3 of 25 rows, with the total page count."""
    return ordering.page(d.price_list(), PAGE_NO, PAGE_SIZE, ["Sl_No"])


@register("t05_deep_page", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS l_quantity,
       CAST(GREATEST(1, CEIL((SELECT COUNT(*) FROM lineitem) / {DEEP_SIZE}.0)) AS INTEGER) AS total_pages, {DEEP_PAGE} AS page
FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
LIMIT {DEEP_SIZE} OFFSET {(DEEP_PAGE - 1) * DEEP_SIZE}""")
def t05_deep(d):
    """T5: a page far behind the first rows of the line items."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    rows = d.table("lineitem").select(*order[:-1], F.col("l_quantity").cast("double").alias("l_quantity"))
    return ordering.page(rows, DEEP_PAGE, DEEP_SIZE, order)


@register("t06_newest_first", with_ctes(f"""
SELECT Date, CAST(SUM(Qty) AS BIGINT) AS total_qty FROM daily_sales GROUP BY Date""", "daily_sales"))
def t06(d):
    """Daily totals, newest first (real dates)."""
    return ordering.newest_first(reports.sum_by(d.daily_sales(), ["Date"]))


# -- windows -----------------------------------------------------------------------------

@register("w01_average_rank", with_ctes(f"""
SELECT Date, {P}, Qty,
       RANK() OVER (PARTITION BY Brand ORDER BY Qty DESC) + (COUNT(*) OVER (PARTITION BY Brand, Qty) - 1) / 2.0
         AS qty_rank
FROM daily_sales""", "daily_sales"))
def w01(d):
    """Rank of quantity within brand, ties averaged."""
    return analytics.average_rank(d.daily_sales(), ["Brand"], "Qty", "qty_rank").select(*SALE_COLS, "qty_rank")


@register("w05_month_brand_share", with_ctes(f"""
SELECT YearMonth, Brand, total_qty, {M('total_amount')} AS total_amount,
       {R('total_qty', 'SUM(total_qty) OVER (PARTITION BY YearMonth)')} AS total_qty_share,
       {R('total_amount', 'SUM(total_amount) OVER (PARTITION BY YearMonth)')} AS total_amount_share
FROM (SELECT STRFTIME(Date, '%Y-%m') AS YearMonth, Brand, CAST(SUM(Qty) AS BIGINT) AS total_qty,
             COALESCE(SUM(total), 0) AS total_amount FROM priced GROUP BY 1, 2) g""", "priced"))
def w05(d):
    """Share of each brand in its month, by quantity and by amount."""
    g = reports.sales_by_period(priced(d), "yearmonth", by=["Brand"], qty_name="total_qty",
                                amount_name="total_amount")
    g = analytics.share_of_total(g, ["YearMonth"], "total_qty")
    return analytics.share_of_total(g, ["YearMonth"], "total_amount")


@register("w06_month_dimension_totals", with_ctes(f"""
SELECT YearMonth, 'Brand' AS dimension, Brand AS value, CAST(SUM(Qty) AS BIGINT) AS total_qty,
       {M('COALESCE(SUM(total), 0)')} AS total_amount
FROM (SELECT *, STRFTIME(Date, '%Y-%m') AS YearMonth FROM priced) t GROUP BY YearMonth, Brand
UNION ALL
SELECT YearMonth, 'Size_ML', CAST(Size_ML AS VARCHAR), CAST(SUM(Qty) AS BIGINT), {M('COALESCE(SUM(total), 0)')}
FROM (SELECT *, STRFTIME(Date, '%Y-%m') AS YearMonth FROM priced) t GROUP BY YearMonth, Size_ML""", "priced"))
def w06(d):
    """Per month, totals by brand and by size in one grouping-sets pass."""
    p = priced(d).withColumn("YearMonth", fmt_year_month("Date"))
    return analytics.period_dimension_totals(p, "YearMonth", ["Brand", "Size_ML"])


@register("w08_recent_trend", with_ctes(f"""
SELECT * FROM (SELECT Date, CAST(SUM(Qty) AS BIGINT) AS total_qty FROM daily_sales GROUP BY Date
               ORDER BY Date DESC LIMIT {TREND_DAYS}) t""", "daily_sales"))
def w08(d):
    """The last 30 present days of the daily trend."""
    return analytics.last_n_periods(reports.sum_by(d.daily_sales(), ["Date"]), "Date", TREND_DAYS)


# -- sets ---------------------------------------------------------------------------------

@register("u01_union_all", with_ctes(f"""
SELECT Date, {P}, Qty, 'daily_sales' AS source FROM daily_sales
UNION ALL SELECT Date, {P}, Qty, 'incoming_stock' FROM incoming_stock""", "daily_sales", "incoming_stock"))
def u01(d):
    """Union all with provenance."""
    return sets.union_all({"daily_sales": d.daily_sales(), "incoming_stock": d.incoming_stock()})


@register("u02_distinct_dates", with_ctes("""
SELECT Date FROM daily_sales WHERE Date IS NOT NULL UNION SELECT Date FROM incoming_stock WHERE Date IS NOT NULL""",
    "daily_sales", "incoming_stock"))
def u02(d):
    """Sorted distinct dates of two tables."""
    return sets.distinct_union([d.daily_sales(), d.incoming_stock()], "Date")


@register("u03_opening_plus_receipts", with_ctes(f"""
SELECT {P}, CAST(SUM(Qty) AS BIGINT) AS Qty FROM (
  SELECT {P}, Qty FROM monthly_stock UNION ALL SELECT {P}, Qty FROM incoming_stock) u GROUP BY {P}""",
    "monthly_stock", "incoming_stock"))
def u03(d):
    """Opening + receipts as one aggregate."""
    return sets.combined_totals([d.monthly_stock(), d.incoming_stock()])


# -- daily series -----------------------------------------------------------------------------

SERIES_SQL = """
daily AS (SELECT Date, CAST(SUM(Qty) AS BIGINT) AS y FROM daily_sales GROUP BY Date),
grid AS (SELECT CAST(UNNEST(GENERATE_SERIES(MIN(Date), MAX(Date), INTERVAL 1 DAY)) AS DATE) AS Date FROM daily),
series AS (SELECT g.Date, COALESCE(d.y, 0) AS y FROM grid g LEFT JOIN daily d ON g.Date = d.Date)"""


def _roll(n: int, what: str) -> str:
    frame = f"OVER (ORDER BY Date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    full = f"COUNT(y) {frame} = {n}"
    if what == "mean":
        return f"CASE WHEN {full} THEN CAST(SUM(y) {frame} AS DOUBLE) / {float(n)} END"
    return (f"CASE WHEN {full} THEN SQRT(CAST({n} * SUM(y * y) {frame} - SUM(y) {frame} * SUM(y) {frame} AS DOUBLE)"
            f" / {float(n * (n - 1))}) END")


FEATURES_SQL = f"""
features AS (SELECT Date, y, LAG(y, 1) OVER (ORDER BY Date) AS lag_1, LAG(y, 2) OVER (ORDER BY Date) AS lag_2,
  LAG(y, 3) OVER (ORDER BY Date) AS lag_3, LAG(y, 7) OVER (ORDER BY Date) AS lag_7,
  {_roll(7, 'mean')} AS rolling_mean_7, {_roll(7, 'std')} AS rolling_std_7, {_roll(14, 'mean')} AS rolling_mean_14,
  CAST(DAY(Date) AS INTEGER) AS day, CAST(MONTH(Date) AS INTEGER) AS month, CAST(YEAR(Date) AS INTEGER) AS year,
  CAST(ISODOW(Date) - 1 AS INTEGER) AS weekday, CAST(WEEKOFYEAR(Date) AS INTEGER) AS week,
  CAST(CASE WHEN ISODOW(Date) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend FROM series),
table_ AS (SELECT * FROM features WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL
  AND lag_7 IS NOT NULL AND rolling_mean_7 IS NOT NULL AND rolling_std_7 IS NOT NULL AND rolling_mean_14 IS NOT NULL)"""


def _series_sql(body: str) -> str:
    base = with_ctes("SELECT 1", "daily_sales")
    head = base[: base.rindex("\n")]
    return f"{head},{SERIES_SQL},{FEATURES_SQL}\n{body}"


def _total_series(d):
    return series.daily_series(d.daily_sales(), "Qty")


@register("w04_dense_daily_series", _series_sql("SELECT Date, y FROM series"))
def w04(d):
    """Dense daily quantity series, missing days 0."""
    return _total_series(d)


@register("z04_feature_table", _series_sql("SELECT * FROM table_"))
def z04(d):
    """Z4 (W2, W3, X12): lags 1/2/3/7, rolling mean 7/14 and sample std 7
    (ending the day before), calendar parts; warm-up rows dropped."""
    return series.feature_table(_total_series(d))


@register("z07_time_split", _series_sql("""
SELECT Date, y, CASE WHEN ROW_NUMBER() OVER (ORDER BY Date) <= (4 * COUNT(*) OVER ()) // 5 THEN 'train'
                     ELSE 'test' END AS split FROM table_"""))
def z07(d):
    """Time-ordered 80/20 split of the feature table."""
    return series.time_split(series.feature_table(_total_series(d)).select("Date", "y"))


@register("z09_naive_forecast_metrics", _series_sql("""
SELECT COUNT(*) AS n, SUM(ABS(CAST(y - lag_1 AS DOUBLE))) / COUNT(*) AS mae,
       SQRT(SUM(CAST((y - lag_1) * (y - lag_1) AS DOUBLE)) / COUNT(*)) AS rmse,
       CASE WHEN SUM(CAST(y AS DOUBLE) * y) - SUM(CAST(y AS DOUBLE)) * SUM(CAST(y AS DOUBLE)) / COUNT(*) <> 0
            THEN 1 - SUM(CAST((y - lag_1) * (y - lag_1) AS DOUBLE))
                 / (SUM(CAST(y AS DOUBLE) * y) - SUM(CAST(y AS DOUBLE)) * SUM(CAST(y AS DOUBLE)) / COUNT(*)) END AS r2
FROM (SELECT *, CASE WHEN ROW_NUMBER() OVER (ORDER BY Date) <= (4 * COUNT(*) OVER ()) // 5 THEN 'train'
                     ELSE 'test' END AS split FROM table_) t WHERE split = 'test'"""))
def z09(d):
    """MAE, RMSE and R2 of the previous-day forecast on the test split."""
    t = series.time_split(series.feature_table(_total_series(d)))
    return series.regression_metrics(t.filter(F.col("split") == "test"), "y", "lag_1")
