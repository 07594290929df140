"""Registered analysis queries: baskets, rules, matching, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import IGNORED_SEARCH_WORDS, KNOWN_SIZES_ML, NUMBER_WORDS, SALES_QUESTION_PHRASES
from ..operators import baskets, matching
from ..operators.items import with_item_attributes
from .registry import register, with_ctes

MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.1
# Fixed run date used when a question names no date ('today' included).
AS_OF = "2026-04-07"


def _brand_baskets(d):
    return baskets.baskets(d.daily_sales(), ["Date", "Brand_Category"], "Brand")


@register("z01_brand_baskets", with_ctes("""
SELECT Date, Brand_Category, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(LIST(Brand))), ',') AS items
FROM daily_sales WHERE Brand IS NOT NULL GROUP BY Date, Brand_Category""", "daily_sales"))
def z01(d):
    """The brands sold per (date, category), as a sorted set."""
    return _brand_baskets(d).withColumn("items", F.array_join("items", ","))


@register("z01_size_baskets", with_ctes("""
SELECT Brand, Date, Brand_Category, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(LIST(CAST(Size_ML AS VARCHAR)))), ',')
       AS items
FROM daily_sales WHERE Size_ML IS NOT NULL GROUP BY Brand, Date, Brand_Category""", "daily_sales"))
def z01s(d):
    """The sizes sold per (brand, date, category)."""
    b = baskets.baskets(d.daily_sales(), ["Brand", "Date", "Brand_Category"], "Size_ML")
    return b.withColumn("items", F.array_join("items", ","))


def _itemsets(d):
    """Mined on vouchers: one holds a few brands however many there are,
    while a day's basket of a category comes to hold every brand."""
    return baskets.frequent_itemsets(d.voucher_brands(), min_support=MIN_SUPPORT)


# Level by level: a set of k brands joins the next brand of the same voucher.
# Voucher sets of over four brands are far below the support asked for.
_LEVELS = """
, vb AS (SELECT l_orderkey AS k, p_brand AS it FROM lineitem JOIN part ON l_partkey = p_partkey
         WHERE p_brand IS NOT NULL GROUP BY 1, 2),
n AS (SELECT COUNT(DISTINCT k) AS n FROM vb),
l1 AS (SELECT it AS a, COUNT(*) AS freq FROM vb GROUP BY 1),
f1 AS (SELECT * FROM l1, n WHERE freq >= CEIL(CAST(0.01 AS DOUBLE) * n)),
v AS (SELECT k, it FROM vb WHERE it IN (SELECT a FROM f1)),
l2 AS (SELECT x.it AS a, y.it AS b, COUNT(*) AS freq FROM v x JOIN v y ON x.k = y.k AND x.it < y.it GROUP BY 1, 2),
l3 AS (SELECT x.it AS a, y.it AS b, z.it AS c, COUNT(*) AS freq FROM v x JOIN v y ON x.k = y.k AND x.it < y.it
       JOIN v z ON x.k = z.k AND y.it < z.it GROUP BY 1, 2, 3),
l4 AS (SELECT x.it AS a, y.it AS b, z.it AS c, w.it AS d, COUNT(*) AS freq FROM v x JOIN v y ON x.k = y.k AND x.it < y.it
       JOIN v z ON x.k = z.k AND y.it < z.it JOIN v w ON x.k = w.k AND z.it < w.it GROUP BY 1, 2, 3, 4),
itemsets AS (
  SELECT s AS items, len(s) AS size, freq, CAST(freq AS DOUBLE) / n AS support FROM (
    SELECT [a] AS s, freq FROM l1 UNION ALL SELECT [a, b], freq FROM l2 UNION ALL SELECT [a, b, c], freq FROM l3
    UNION ALL SELECT [a, b, c, d], freq FROM l4) u, n WHERE freq >= CEIL(CAST(0.01 AS DOUBLE) * n))
"""


@register("z02_frequent_itemsets", "WITH one AS (SELECT 1)" + _LEVELS + """
SELECT array_to_string(items, ',') AS items, CAST(size AS INTEGER) AS size, freq, support FROM itemsets""")
def z02(d):
    """Frequent brand sets (support >= 1 % of vouchers), FP-growth."""
    return _itemsets(d).withColumn("items", F.array_join("items", ","))


@register("z02_frequent_pairs", with_ctes("""
SELECT a || ',' || b AS items, freq, CAST(freq AS DOUBLE) / (SELECT COUNT(*) FROM brand_baskets) AS support
FROM (SELECT x.it AS a, y.it AS b, COUNT(*) AS freq FROM basket_items x JOIN basket_items y
        ON x.Date = y.Date AND x.Brand_Category = y.Brand_Category AND x.it < y.it GROUP BY 1, 2) p
WHERE freq >= CEIL(CAST(0.01 AS DOUBLE) * (SELECT COUNT(*) FROM brand_baskets))""", "basket_items"))
def z02p(d):
    """The frequent pairs (checked against SQL pair counts)."""
    f = baskets.frequent_pairs(_brand_baskets(d), min_support=MIN_SUPPORT)
    return f.select(F.array_join("items", ",").alias("items"), "freq", "support")


@register("z03_association_rules", "WITH one AS (SELECT 1)" + _LEVELS + """
SELECT array_to_string(p.items, ',') AS antecedents, array_to_string(q.items, ',') AS consequents,
       p.support AS antecedent_support, q.support AS consequent_support, i.support AS support,
       i.support / p.support AS confidence, i.support / p.support / q.support AS lift
FROM itemsets i JOIN itemsets p ON p.size < i.size AND list_has_all(i.items, p.items)
JOIN itemsets q ON q.size = i.size - p.size AND list_has_all(i.items, q.items) AND NOT list_has_any(p.items, q.items)
WHERE i.support / p.support >= 0.1""")
def z03(d):
    """Z3: rules with any split of a frequent itemset (multi-item
    consequents), confidence >= 0.1, with support, confidence and lift."""
    r = baskets.association_rules(_itemsets(d), MIN_CONFIDENCE)
    return r.select(F.array_join("antecedent", ",").alias("antecedents"),
                    F.array_join("consequent", ",").alias("consequents"), "antecedent_support",
                    "consequent_support", "support", "confidence", "lift")


# -- word matching ---------------------------------------------------------------

def _requests(d):
    """Spoken-style requests: one per part, '<name> <size> ml'."""
    return d.table("part").select(F.col("p_partkey").alias("request_id"),
                                  F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" ml"))
                                  .alias("text"))


def _sql_search_words(t: str) -> str:
    x = f"LOWER(COALESCE({t}, ''))"
    x = f"REGEXP_REPLACE({x}, '&', ' and ', 'g')"
    x = f"REGEXP_REPLACE({x}, '[-_.,]', ' ', 'g')"
    x = f"REGEXP_REPLACE({x}, '[''\"]', '', 'g')"
    x = f"REGEXP_REPLACE({x}, 'millilit(er|re)s?|lit(er|re)s?', ' ', 'g')"
    x = f"REGEXP_REPLACE({x}, '\\bm\\s?l\\b', ' ', 'g')"
    x = f"REGEXP_REPLACE({x}, '\\bwhiske?y\\b', 'whisky', 'g')"
    x = f"TRIM(REGEXP_REPLACE({x}, '\\s+', ' ', 'g'))"
    ignored = ", ".join(f"'{w}'" for w in IGNORED_SEARCH_WORDS)
    return (f"LIST_DISTINCT(LIST_FILTER(STRING_SPLIT({x}, ' '), lambda w: w <> '' AND NOT LIST_CONTAINS([{ignored}], w)))")


def _sql_digits(t: str) -> str:
    x = f"LOWER(COALESCE({t}, ''))"
    for word, digit in NUMBER_WORDS.items():
        x = f"REGEXP_REPLACE({x}, '\\b{word}\\b', '{digit}', 'g')"
    return f"TRIM(REGEXP_REPLACE({x}, '\\s+', ' ', 'g'))"


SIZES = "|".join(str(s) for s in KNOWN_SIZES_ML)


def _sql_spoken_size(t: str) -> str:
    return f"TRY_CAST(NULLIF(REGEXP_EXTRACT({_sql_digits(t)}, '\\b({SIZES})\\b', 1), '') AS INTEGER)"


def _sql_spoken_item_name(t: str) -> str:
    x = f"REGEXP_REPLACE({_sql_digits(t)}, 'millilit(er|re)s?|lit(er|re)s?', ' ', 'g')"
    size = f"REGEXP_EXTRACT({x}, '\\b({SIZES})\\b', 1)"
    x = f"CASE WHEN {size} <> '' THEN REGEXP_REPLACE({x}, '\\b' || {size} || '\\b', ' ', 'g') ELSE {x} END"
    x = f"REGEXP_REPLACE({x}, '\\bm\\s?l\\b', ' ', 'g')"
    x = f"REGEXP_REPLACE({x}, '-', ' ', 'g')"
    return f"TRIM(REGEXP_REPLACE({x}, '\\s+', ' ', 'g'))"


@register("z05_item_matching", with_ctes(f"""
SELECT request_id, text, spoken_size, m.stock_item_name AS matched_item, m.brand AS matched_brand,
       m.size_ml AS matched_size, m.tier
FROM (SELECT request_id, text, words, spoken_size,
             ARG_MIN(STRUCT_PACK(stock_item_name := i.stock_item_name, brand := i.brand, size_ml := i.size_ml,
                                 tier := CASE WHEN spoken_size IS NULL OR i.size_ml = spoken_size THEN 1 ELSE 4 END),
                     STRUCT_PACK(t := CASE WHEN spoken_size IS NULL OR i.size_ml = spoken_size THEN 1 ELSE 4 END,
                                 n := i.stock_item_name, b := i.brand, s := i.size_ml)) AS m
      FROM (SELECT p_partkey AS request_id, CONCAT(p_name, ' ', CAST(p_size AS VARCHAR), ' ml') AS text,
                   {_sql_search_words(_sql_spoken_item_name("CONCAT(p_name, ' ', CAST(p_size AS VARCHAR), ' ml')"))}
                     AS words,
                   {_sql_spoken_size("CONCAT(p_name, ' ', CAST(p_size AS VARCHAR), ' ml')")} AS spoken_size
            FROM part) r
      LEFT JOIN (SELECT DISTINCT stock_item_name, brand, size_ml FROM account_lines) i
        ON LEN(r.words) = 0 OR LIST_BOOL_AND(LIST_TRANSFORM(r.words,
             lambda w: CONTAINS(LOWER(COALESCE(i.brand, '')) || ' ' || LOWER(COALESCE(i.stock_item_name, '')), w)))
      GROUP BY request_id, text, words, spoken_size) t""", "account_lines"))
def z05(d):
    """The best stock item for every request (word match, size tiers)."""
    names = d.voucher_lines().select("stock_item_name").distinct()
    items = with_item_attributes(names).select("stock_item_name", "brand", "size_ml")
    return matching.match_items(_requests(d), items)


@register("z06_question_routing", f"""
SELECT conv_id, turn, role,
       REGEXP_MATCHES(LOWER(COALESCE(text, '')), '{"|".join(SALES_QUESTION_PHRASES)}') AS is_sales_query,
       STRFTIME(CASE WHEN INSTR(LOWER(COALESCE(text, '')), 'today') > 0 THEN DATE '{AS_OF}'
            WHEN REGEXP_EXTRACT(LOWER(COALESCE(text, '')), '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1) <> ''
              THEN CAST(TRY_STRPTIME(REGEXP_EXTRACT(LOWER(COALESCE(text, '')), '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1),
                                     '%Y-%m-%d') AS DATE)
            WHEN REGEXP_EXTRACT(LOWER(COALESCE(text, '')), '\\b(\\d{{2}}/\\d{{2}}/\\d{{4}})\\b', 1) <> ''
              THEN CAST(TRY_STRPTIME(REGEXP_EXTRACT(LOWER(COALESCE(text, '')), '\\b(\\d{{2}}/\\d{{2}}/\\d{{4}})\\b', 1),
                                     '%d/%m/%Y') AS DATE)
            ELSE DATE '{AS_OF}' END, '%Y-%m-%d') AS query_date
FROM conversations""")
def z06(d):
    """Every conversation turn routed (sales question or not) with the
    date it refers to."""
    out = matching.route_questions(d.table("conversations"), "text", AS_OF)
    return out.select("conv_id", "turn", "role", "is_sales_query", "query_date")
