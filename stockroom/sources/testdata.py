"""Business tables derived from the driver's test tables.

The shop's own tables (daily sales, receipts, opening stock, price list,
accounting voucher lines, stock movements) are derived from the TPC-H-like
Parquet tables with one fixed mapping. Each derivation exists twice: as a
lazy DataFrame (what the library runs) and as SQL text (what the DuckDB
oracle runs), and both must stay in step.

Scale notes: every fact table is a join of ``lineitem`` with small
dimensions. We never hint those joins: Spark's planner broadcasts a side
whose scan is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
shuffles both sides, and AQE re-checks the real sizes at run time. Only the
columns each report needs are read (Parquet column pruning), and the
``l_linestatus`` predicate reaches the scan as a pushed filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import MONEY

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

PRODUCT = ["Brand_Category", "Brand", "Size_ML"]

# Every product is in the price list. Every tenth (by its first part key) has
# no price yet, so that the rules for missing prices are exercised.
FIXTURE_SQL: dict[str, str] = {
    "price_list": """
SELECT p_brand AS Brand, p_type AS Brand_Category, p_size AS Size_ML,
       MIN(p_partkey) AS Sl_No, CAST(CASE WHEN MIN(p_partkey) % 10 <> 0
       THEN MIN_BY(p_retailprice, p_partkey) END AS DECIMAL(18,2)) AS Mrp
FROM part GROUP BY p_brand, p_type, p_size""",
    "daily_sales": """
SELECT CAST(l_shipdate AS DATE) AS Date, p_type AS Brand_Category, p_brand AS Brand,
       p_size AS Size_ML, CAST(l_quantity AS INT) AS Qty
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F'""",
    "incoming_stock": """
SELECT CAST(l_shipdate AS DATE) AS Date, p_type AS Brand_Category, p_brand AS Brand,
       p_size AS Size_ML, CAST(l_quantity AS INT) AS Qty
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O'""",
    "monthly_stock": """
SELECT DATE '1995-01-01' AS Date, p_type AS Brand_Category, p_brand AS Brand, p_size AS Size_ML,
       CAST(MIN(p_partkey) % 100 + 50 AS INT) AS Qty
FROM part GROUP BY p_type, p_brand, p_size""",
    "voucher_lines": """
SELECT CAST(l_orderkey AS VARCHAR) AS guid, CAST(o_orderdate AS DATE) AS voucher_date,
       c_name AS party_name, s_name AS supplier_name, n_name AS godown,
       CONCAT(UPPER(p_name), ' ', CAST(p_size AS VARCHAR), ' - ML') AS stock_item_name,
       CAST(l_quantity AS INT) AS quantity, CAST(p_retailprice AS DECIMAL(18,2)) AS rate,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey""",
    "stock_movements": """
SELECT event_id, ts, user_id,
       CASE WHEN event_type = 'signup' THEN 1 ELSE -1 END * CAST(FLOOR(value) AS INT) AS delta
FROM events WHERE event_type IN ('signup', 'purchase')""",
}


_RELATIONS: dict[tuple[int, str], DataFrame] = {}


class ShopData:
    """Lazy accessors for the raw and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """The raw table. The resolved relation (file listing and Parquet
        footer schema, no data) is kept per session and path, so repeated
        reports do not list and open the files again."""
        path = f"{self.sf_dir}/{name}.parquet"
        key = (id(self.spark), path)
        cached = _RELATIONS.get(key)
        # ids can be reused after a session is stopped: check the owner too
        if cached is None or cached.sparkSession is not self.spark:
            cached = _RELATIONS[key] = self.spark.read.parquet(path)
        return cached

    # -- dimensions ----------------------------------------------------------
    def price_list(self) -> DataFrame:
        """Unique on product: Brand, Brand_Category, Size_ML, Sl_No, Mrp."""
        part = self.table("part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
        return (part.groupBy(F.col("p_brand").alias("Brand"), F.col("p_type").alias("Brand_Category"),
                             F.col("p_size").alias("Size_ML"))
                .agg(F.min("p_partkey").alias("Sl_No"),
                     F.min_by("p_retailprice", "p_partkey").cast(MONEY).alias("Mrp"))
                .withColumn("Mrp", F.when(F.col("Sl_No") % 10 != 0, F.col("Mrp"))))

    def _part_products(self) -> DataFrame:
        return self.table("part").select(
            "p_partkey", F.col("p_type").alias("Brand_Category"), F.col("p_brand").alias("Brand"),
            F.col("p_size").alias("Size_ML"))

    # -- facts -----------------------------------------------------------------
    def _movements(self, status: str) -> DataFrame:
        li = (self.table("lineitem").filter(F.col("l_linestatus") == status)
              .select("l_partkey", "l_shipdate", "l_quantity"))
        return (li.join(self._part_products(), li.l_partkey == F.col("p_partkey"))
                .select(F.col("l_shipdate").cast("date").alias("Date"), *PRODUCT,
                        F.col("l_quantity").cast("int").alias("Qty")))

    def daily_sales(self) -> DataFrame:
        """Date, Brand_Category, Brand, Size_ML, Qty (line items with status F)."""
        return self._movements("F")

    def incoming_stock(self) -> DataFrame:
        """Receipts: same shape as sales (line items with status O)."""
        return self._movements("O")

    def monthly_stock(self) -> DataFrame:
        """Opening stock on 1995-01-01, one row per product."""
        part = self.table("part").select("p_partkey", "p_brand", "p_type", "p_size")
        return (part.groupBy(F.col("p_type").alias("Brand_Category"), F.col("p_brand").alias("Brand"),
                             F.col("p_size").alias("Size_ML"))
                .agg((F.min("p_partkey") % 100 + 50).cast("int").alias("Qty"))
                .select(F.lit("1995-01-01").cast("date").alias("Date"), *PRODUCT, "Qty"))

    def voucher_lines(self) -> DataFrame:
        """Accounting voucher lines: one row per line item."""
        li = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
                                           "l_extendedprice")
        orders = self.table("orders").select("o_orderkey", "o_orderdate", "o_custkey")
        part = self.table("part").select("p_partkey", "p_name", "p_size", "p_retailprice")
        cust = self.table("customer").select("c_custkey", "c_name")
        supp = self.table("supplier").select("s_suppkey", "s_name", "s_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_name")
        j = (li.join(orders, li.l_orderkey == orders.o_orderkey)
             .join(part, li.l_partkey == part.p_partkey)
             .join(cust, orders.o_custkey == cust.c_custkey)
             .join(supp, li.l_suppkey == supp.s_suppkey)
             .join(nation, supp.s_nationkey == nation.n_nationkey))
        return j.select(
            F.col("l_orderkey").cast("string").alias("guid"),
            F.col("o_orderdate").cast("date").alias("voucher_date"),
            F.col("c_name").alias("party_name"), F.col("s_name").alias("supplier_name"),
            F.col("n_name").alias("godown"),
            F.concat(F.upper("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" - ML"))
            .alias("stock_item_name"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("p_retailprice").cast(MONEY).alias("rate"),
            F.col("l_extendedprice").cast(MONEY).alias("amount"))

    def voucher_brands(self) -> DataFrame:
        """One basket per voucher: the sorted set of its brands."""
        from ..operators.baskets import baskets
        lines = self.table("lineitem").select("l_orderkey", "l_partkey").join(
            self.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        return baskets(lines, ["l_orderkey"], "p_brand")

    def date_keyed_stock(self) -> DataFrame:
        """Date-keyed current inventory: opening rows plus receipt rows."""
        return self.monthly_stock().unionByName(self.incoming_stock())

    def catalogue(self, reorder_level: int = 60) -> DataFrame:
        """Product catalogue for the catalogue batch job (I13): one row per
        priced product; product_id is its serial number."""
        p = self.price_list()
        m = self.monthly_stock().select(*PRODUCT, F.col("Qty").alias("stock_quantity"))
        from ..functions.text import look_column
        return p.join(m, PRODUCT).select(
            F.col("Sl_No").alias("product_id"), look_column(*PRODUCT).alias("product_name"),
            F.col("Brand_Category").alias("category"), F.col("Mrp").alias("price"), "stock_quantity",
            F.lit(reorder_level).alias("reorder_level"))

    def catalogue_sales(self) -> DataFrame:
        """Sales of catalogue products: product_id, quantity_sold, sale_date."""
        p = self.price_list().select(*PRODUCT, "Sl_No")
        return self.daily_sales().join(p, PRODUCT).select(
            F.col("Sl_No").alias("product_id"), F.col("Qty").alias("quantity_sold"), F.col("Date").alias("sale_date"))

    def sales_requests(self) -> DataFrame:
        """A sales file with a defined row order (I9): the sold line items,
        numbered within each (product, date) by their line-item identity.
        Identical line items may swap numbers; they are indistinguishable in
        the output."""
        from pyspark.sql import Window
        li = (self.table("lineitem").filter(F.col("l_linestatus") == "F")
              .select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity",
                      "l_extendedprice", "l_discount", "l_tax"))
        j = li.join(self._part_products(), li.l_partkey == F.col("p_partkey"))
        j = j.select(F.col("l_shipdate").cast("date").alias("Date"), *PRODUCT,
                     F.col("l_quantity").cast("int").alias("Qty"), "l_orderkey", "l_linenumber", "l_suppkey",
                     "l_extendedprice", "l_discount", "l_tax")
        w = Window.partitionBy("Date", *PRODUCT).orderBy("l_orderkey", "l_linenumber", "l_suppkey", "Qty",
                                                          "l_extendedprice", "l_discount", "l_tax")
        return j.withColumn("row", F.row_number().over(w).cast("bigint")).select("row", "Date", *PRODUCT, "Qty")

    def stock_movements(self) -> DataFrame:
        """Signed stock events keyed by user_id (stands in for a product)."""
        ev = self.table("events").filter(F.col("event_type").isin("signup", "purchase"))
        sign = F.when(F.col("event_type") == "signup", F.lit(1)).otherwise(F.lit(-1))
        return ev.select("event_id", "ts", "user_id",
                         (sign * F.floor("value").cast("int")).alias("delta"))
