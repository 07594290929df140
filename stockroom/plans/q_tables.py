"""Registered table-write, duplicate-policy and column-function queries
(K1-K4, K6, A29, X2-X19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as X
from ..functions import numbers as N
from ..functions import text as T
from ..operators.clean import merge_duplicates
from ..sinks.tables import upsert, upsert_counts
from .registry import DERIVED_SQL, M, register, with_ctes

PRODUCT = ["Brand_Category", "Brand", "Size_ML"]
P = "Brand_Category, Brand, Size_ML"
KEY = ["Date", *PRODUCT]

DERIVED_SQL.update({
    "k_old": (f"SELECT Date, {P}, CAST(SUM(Qty) AS BIGINT) AS Qty FROM daily_sales GROUP BY Date, {P}",
              ["daily_sales"]),
    "k_new": (f"SELECT Date, {P}, CAST(SUM(Qty) AS BIGINT) AS Qty FROM incoming_stock GROUP BY Date, {P}",
              ["incoming_stock"]),
    "reprice": ("""
SELECT p_brand AS Brand, p_type AS Brand_Category, p_size AS Size_ML, MAX(p_partkey) AS Sl_No,
       CAST(MAX_BY(p_retailprice, p_partkey) AS DECIMAL(18,2)) AS Mrp
FROM part GROUP BY p_brand, p_type, p_size""", []),
    "sales_rows": ("""
SELECT ROW_NUMBER() OVER (PARTITION BY CAST(l_shipdate AS DATE), p_type, p_brand, p_size
                          ORDER BY l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity AS INT), l_extendedprice,
                                   l_discount, l_tax) AS "row",
       CAST(l_shipdate AS DATE) AS Date, p_type AS Brand_Category, p_brand AS Brand, p_size AS Size_ML,
       CAST(l_quantity AS INT) AS Qty
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F'""", []),
})


def _agg(df):
    return df.groupBy(*KEY).agg(F.sum("Qty").cast("bigint").alias("Qty"))


def _old_new(d):
    return _agg(d.daily_sales()), _agg(d.incoming_stock())


def _reprice(d):
    part = d.table("part")
    return (part.groupBy(F.col("p_brand").alias("Brand"), F.col("p_type").alias("Brand_Category"),
                         F.col("p_size").alias("Size_ML"))
            .agg(F.max("p_partkey").alias("Sl_No"), F.max_by("p_retailprice", "p_partkey").cast(N.MONEY).alias("Mrp")))


J = " AND ".join(f"o.{k} = n.{k}" for k in KEY)
C = ", ".join(f"COALESCE(o.{k}, n.{k}) AS {k}" for k in KEY)


@register("k01_upsert_set", with_ctes(f"""
SELECT {C}, CASE WHEN n.Brand IS NOT NULL THEN n.Qty ELSE o.Qty END AS Qty
FROM k_old o FULL OUTER JOIN k_new n ON {J}""", "k_old", "k_new"))
def k01(d):
    """K1: upsert 'set' of a new batch into a keyed table (Date + product)."""
    old, new = _old_new(d)
    return upsert(old, new, KEY, "set", stamps=False)


@register("k02_upsert_increment", with_ctes(f"""
SELECT {C}, COALESCE(o.Qty, 0) + COALESCE(n.Qty, 0) AS Qty FROM k_old o FULL OUTER JOIN k_new n ON {J}""",
    "k_old", "k_new"))
def k02(d):
    """K2: upsert 'increment' (Qty = old + new, insert when absent)."""
    old, new = _old_new(d)
    return upsert(old, new, KEY, "inc", stamps=False)


@register("k03_insert_if_absent", with_ctes(f"""
SELECT Date, {P}, Qty FROM k_old
UNION ALL SELECT Date, {P}, Qty FROM k_new n WHERE NOT EXISTS (SELECT 1 FROM k_old o WHERE {J})""",
    "k_old", "k_new"))
def k03(d):
    """K3: insert only keys not present."""
    old, new = _old_new(d)
    return upsert(old, new, KEY, "insert_only", stamps=False)


@register("k04_price_upsert_shift_old", with_ctes(f"""
SELECT COALESCE(o.Brand, n.Brand) AS Brand, COALESCE(o.Brand_Category, n.Brand_Category) AS Brand_Category,
       COALESCE(o.Size_ML, n.Size_ML) AS Size_ML,
       CASE WHEN n.Brand IS NOT NULL THEN n.Sl_No ELSE o.Sl_No END AS Sl_No,
       {M('CASE WHEN n.Brand IS NOT NULL THEN n.Mrp ELSE o.Mrp END')} AS Mrp,
       {M('CASE WHEN o.Brand IS NOT NULL AND n.Brand IS NOT NULL AND o.Mrp IS DISTINCT FROM n.Mrp THEN o.Mrp END')}
         AS Mrp_OLD
FROM price_list o FULL OUTER JOIN reprice n
  ON o.Brand = n.Brand AND o.Brand_Category = n.Brand_Category AND o.Size_ML = n.Size_ML""",
    "price_list", "reprice"))
def k04(d):
    """K4: price upsert that moves a changed price to Mrp_OLD."""
    old = d.price_list().withColumn("Mrp_OLD", F.lit(None).cast(N.MONEY))
    return upsert(old, _reprice(d), PRODUCT, "set_shift", stamps=False)


_LOOK = "'(' || Brand_Category || ') - ' || Brand || ' - ' || CAST(Size_ML AS VARCHAR) || ' ML' AS LookColumn"


@register("k05_price_import", with_ctes(f"""
SELECT *, {_LOOK} FROM (
  SELECT COALESCE(o.Brand, n.Brand) AS Brand, COALESCE(o.Brand_Category, n.Brand_Category) AS Brand_Category,
         COALESCE(o.Size_ML, n.Size_ML) AS Size_ML, CASE WHEN n.Brand IS NOT NULL THEN n.Sl_No ELSE o.Sl_No END AS Sl_No,
         {M('CASE WHEN n.Brand IS NOT NULL THEN n.Mrp ELSE o.Mrp END')} AS Mrp
  FROM price_list o FULL OUTER JOIN reprice n
    ON o.Brand = n.Brand AND o.Brand_Category = n.Brand_Category AND o.Size_ML = n.Size_ML) u""",
    "price_list", "reprice"))
def k05(d):
    """K5: plain price upsert of an imported list; the LookColumn is generated."""
    look = T.look_column(*PRODUCT).alias("LookColumn")
    return upsert(d.price_list().select("*", look), _reprice(d).select("*", look), PRODUCT, "set", stamps=False)


@register("k07_copy_by_id", """
SELECT o_orderkey AS id, CAST(o_custkey AS BIGINT) AS customer, STRFTIME(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day
FROM orders""")
def k07(d):
    """K7: copy every row of one table into another that already has some, by id."""
    o = d.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("long").alias("customer"),
                                 F.col("o_orderdate").cast("date").alias("day"))
    stale = o.where(F.col("day") < "1996-01-01").withColumn("customer", F.lit(-1).cast("long"))
    return upsert(stale, o, ["id"], "set", stamps=False)


@register("k06_upsert_counts", with_ctes(f"""
SELECT CAST(SUM(CASE WHEN o.Brand IS NOT NULL AND n.Brand IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS matched_count,
       CAST(SUM(CASE WHEN o.Brand IS NOT NULL AND n.Brand IS NOT NULL AND o.Qty IS DISTINCT FROM n.Qty THEN 1 ELSE 0 END)
            AS BIGINT) AS modified_count,
       CAST(SUM(CASE WHEN o.Brand IS NULL AND n.Brand IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS upserted_count
FROM k_old o FULL OUTER JOIN k_new n ON {J}""", "k_old", "k_new"))
def k06(d):
    """K6: matched / modified / upserted counts of the K1 upsert."""
    old, new = _old_new(d)
    return upsert_counts(old, new, KEY, ["Qty"])


# -- A29: duplicate policies over the ordered sales rows ------------------------------------------

@register("a29_dedupe_sum", with_ctes(f"SELECT Date, {P}, CAST(SUM(Qty) AS BIGINT) AS Qty FROM daily_sales "
                                      f"GROUP BY Date, {P}", "daily_sales"))
def a29s(d):
    """A29 / D5 'sum'."""
    return merge_duplicates(d.daily_sales(), KEY, "sum")


@register("a29_dedupe_exact_then_sum", with_ctes(f"""
SELECT Date, {P}, CAST(SUM(Qty) AS BIGINT) AS Qty FROM (SELECT DISTINCT Date, {P}, Qty FROM daily_sales) t
GROUP BY Date, {P}""", "daily_sales"))
def a29e(d):
    """A29 / D5 'exact_then_sum' (identical rows dropped first)."""
    return merge_duplicates(d.daily_sales(), KEY, "exact_then_sum")


@register("a29_dedupe_last", with_ctes(f"""
SELECT Date, {P}, "row", Qty FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY Date, {P} ORDER BY "row" DESC) AS rk
                                   FROM sales_rows) t WHERE rk = 1""", "sales_rows"))
def a29l(d):
    """A29 / D5 'last' by file row order."""
    return merge_duplicates(d.sales_requests(), KEY, "last", order_col="row")


@register("a29_dedupe_first", with_ctes(f"""
SELECT Date, {P}, "row", Qty FROM sales_rows WHERE "row" = 1""", "sales_rows"))
def a29f(d):
    """A29 / D5 'first' (insert first only)."""
    return merge_duplicates(d.sales_requests(), KEY, "first", order_col="row")


@register("a29_dedupe_sum_last", with_ctes(f"""
SELECT Date, {P}, CAST(MAX("row") AS BIGINT) AS "row", CAST(SUM(Qty) AS BIGINT) AS Qty FROM sales_rows
GROUP BY Date, {P}""", "sales_rows"))
def a29sl(d):
    """Quantities summed, other values from the last row."""
    return merge_duplicates(d.sales_requests(), KEY, "sum_last", order_col="row")


# -- X: column functions over values derived from the data -----------------------------------------

@register("x07_date_round_trip", with_ctes("""
SELECT Date, STRFTIME(Date, '%-d/%-m/%Y') AS dmy_text,
       STRFTIME(CAST(STRPTIME(STRFTIME(Date, '%-d/%-m/%Y'), '%d/%m/%Y') AS DATE), '%Y-%m-%d') AS parsed_dmy,
       STRFTIME(Date, '%Y%m%d') AS compact_text, STRFTIME(Date, '%d/%m/%Y') AS fmt_dmy,
       STRFTIME(Date, '%Y-%m') AS year_month,
       CAST(DAY(Date) AS INTEGER) AS day, CAST(MONTH(Date) AS INTEGER) AS month, CAST(YEAR(Date) AS INTEGER) AS year,
       CAST(ISODOW(Date) - 1 AS INTEGER) AS weekday, CAST(WEEKOFYEAR(Date) AS INTEGER) AS week,
       CAST(ISOYEAR(Date) AS INTEGER) AS week_year,
       CAST(CASE WHEN ISODOW(Date) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
       STRFTIME(Date - INTERVAL 1 DAY, '%Y-%m-%d') AS previous_day, STRFTIME(Date + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day
FROM (SELECT DISTINCT Date FROM daily_sales) t""", "daily_sales"))
def x07(d):
    """Dates formatted as text and parsed back; calendar parts."""
    days = d.daily_sales().select("Date").distinct()
    t = F.date_format("Date", "d/M/yyyy")
    out = days.select("Date", t.alias("dmy_text"), X.fmt_iso(X.parse_day_first(t)).alias("parsed_dmy"),
                      F.date_format("Date", "yyyyMMdd").alias("compact_text"), X.fmt_dmy("Date").alias("fmt_dmy"),
                      X.fmt_year_month("Date").alias("year_month"),
                      *[c.alias(n) for n, c in X.calendar_parts("Date").items()],
                      X.iso_week_year("Date").alias("week_year"),
                      X.fmt_iso(X.previous_day("Date")).alias("previous_day"),
                      X.fmt_iso(X.next_day("Date")).alias("next_day"))
    # the compact form must parse back to the same day
    return out.filter(X.parse_yyyymmdd("compact_text") == F.col("Date"))


@register("x14_item_text", with_ctes(r"""
SELECT stock_item_name,
       TRIM(REGEXP_REPLACE(stock_item_name, '(?i)\s*\d+\s*-\s*ML.*$', '')) AS brand,
       TRIM(REGEXP_REPLACE(stock_item_name, '(?i)\s+\d+\s*-\s*ML$', '')) AS brand_trailing,
       TRY_CAST(NULLIF(REGEXP_EXTRACT(UPPER(stock_item_name), '(\d+)\s*-\s*ML', 1), '') AS INTEGER) AS size_ml,
       TRIM(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(UPPER(stock_item_name), '[-_,]', ' ', 'g'),
            '[.''"]', '', 'g'), 'MILLILITERS|MILLILITRES|MILLILITER|MILLILITRE', 'ML', 'g'), '\s+', ' ', 'g'))
         AS normalized,
       '(' || 'ITEM' || ') - ' || TRIM(REGEXP_REPLACE(stock_item_name, '(?i)\s*\d+\s*-\s*ML.*$', '')) || ' - '
         || CAST(TRY_CAST(NULLIF(REGEXP_EXTRACT(UPPER(stock_item_name), '(\d+)\s*-\s*ML', 1), '') AS INTEGER) AS VARCHAR)
         || ' ML' AS look_column
FROM (SELECT DISTINCT stock_item_name FROM voucher_lines) t""", "voucher_lines"))
def x14(d):
    """X14, X15, X18, X19 over every distinct item name."""
    names = d.voucher_lines().select("stock_item_name").distinct()
    return names.select("stock_item_name", T.brand_from_item("stock_item_name").alias("brand"),
                        T.brand_from_item("stock_item_name", trailing_only=True).alias("brand_trailing"),
                        T.size_from_item("stock_item_name").alias("size_ml"),
                        T.normalize_item_name("stock_item_name").alias("normalized"),
                        T.look_column(F.lit("ITEM"), T.brand_from_item("stock_item_name"),
                                      T.size_from_item("stock_item_name")).alias("look_column"))


@register("x01_text_and_numbers", """
SELECT o_orderkey AS id, COALESCE(TRIM(s), '') AS trimmed, CAST(o_orderkey AS INTEGER) AS whole,
       STRFTIME(day, '%Y-%m-%d') AS day_from_dmy, STRFTIME(day, '%Y-%m-%d') AS day_from_iso,
       -1050.5 - o_orderkey % 7 AS signed_number, 1200.0 + o_orderkey % 7 AS without_units
FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN '  ' || o_orderkey || ' x ' END AS s, CAST(o_orderdate AS DATE) AS day
      FROM orders) o""")
def x01(d):
    """X1, X5, X9, X16 b and c: values written as the shop's files have them and parsed back."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    s = F.when(k % 3 > 0, F.concat(F.lit("  "), k.cast("string"), F.lit(" x ")))
    signed = F.concat(F.lit("-1,05"), (k % 7).cast("string"), F.lit(".50 NOS"))
    units = F.concat(F.lit("1,20"), (k % 7).cast("string"), F.lit(" NOS"))
    return d.table("orders").select(
        k.alias("id"), T.trim_or_blank(s).alias("trimmed"), N.int_or_fail(k.cast("string")).alias("whole"),
        X.parse_dmy_or_iso(F.date_format(day, "dd/MM/yyyy")).alias("day_from_dmy"),
        X.parse_dmy_or_iso(F.date_format(day, "yyyy-MM-dd")).alias("day_from_iso"),
        N.first_number_signed(signed).alias("signed_number"), N.number_strip_units(units).alias("without_units"))


@register("x16_number_parsing", with_ctes("""
SELECT guid, stock_item_name, quantity, CAST(quantity AS DOUBLE) AS qty_from_text,
       CAST(rate AS DOUBLE) AS rate_from_text, 'NOS' AS unit_from_text, CAST(quantity AS INTEGER) AS strict_int,
       CAST(quantity AS INTEGER) AS lenient_int, 0.0 AS bad_number
FROM voucher_lines""", "voucher_lines"))
def x16(d):
    """Quantities and rates written as accounting text
    ('12 NOS', '1,050.00/NOS') and parsed back."""
    v = d.voucher_lines()
    qty_text = F.concat(F.col("quantity").cast("string"), F.lit(" NOS"))
    rate_text = F.concat(F.format_number(F.col("rate").cast("double"), 2), F.lit("/NOS"))
    rate, unit = N.split_rate_unit(rate_text)
    return v.select("guid", "stock_item_name", "quantity", N.first_number_plain(qty_text).alias("qty_from_text"),
                    rate.alias("rate_from_text"), unit.alias("unit_from_text"),
                    N.strict_int(F.col("quantity").cast("string")).alias("strict_int"),
                    N.lenient_int(F.concat(F.col("quantity").cast("string"), F.lit(".9"))).alias("lenient_int"),
                    N.coerce_number(F.concat(F.lit("x"), F.col("guid"))).alias("bad_number"))
