"""Market baskets, frequent itemsets and association rules.

Frequent itemsets come from ``pyspark.ml.fpm.FPGrowth`` (parallel FP-growth:
transactions are sharded by item, each shard grows its own conditional
trees; nothing is collected to the driver). FPGrowth's own rules allow only
one consequent item, while the reference allows any split of an itemset, so
rules are generated here: every non-empty proper subset of each frequent
itemset (by bitmask, with array functions) becomes an antecedent, and the
supports of both sides are looked up with joins against the itemset table.
Every subset of a frequent itemset is frequent, so the lookups always hit.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def baskets(df: DataFrame, keys: list[str], item: str, name: str = "items") -> DataFrame:
    """One basket per key: the sorted set of items (a set, because
    FP-growth rejects repeated items). NULL items are left out."""
    return (df.where(F.col(item).isNotNull()).groupBy(*keys)
            .agg(F.array_sort(F.collect_set(F.col(item).cast("string"))).alias(name)))


def frequent_itemsets(basket_df: DataFrame, items_col: str = "items", min_support: float = 0.01,
                      partitions: int | None = None) -> DataFrame:
    """Itemsets with support >= ``min_support`` (fraction of baskets).
    Output: items (sorted array), size, freq, support."""
    fp = FPGrowth(itemsCol=items_col, minSupport=min_support, minConfidence=1.0)
    if partitions:
        fp = fp.setNumPartitions(partitions)
    model = fp.fit(basket_df.select(items_col))
    n = basket_df.select(F.count(F.lit(1))).scalar()
    f = model.freqItemsets
    return f.select(F.array_sort("items").alias("items"), F.size("items").alias("size"),
                    F.col("freq").cast("bigint").alias("freq"), (F.col("freq") / n).alias("support"))


def frequent_pairs(basket_df: DataFrame, items_col: str = "items", min_support: float = 0.01) -> DataFrame:
    """Z2 for pairs alone, counted directly: every basket's pairs, partially
    aggregated, without mining larger sets. Output as ``frequent_itemsets``."""
    items = F.col(items_col)
    rest = F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y: F.array(x, y)))
    pairs = basket_df.select(items_col).select(F.explode(F.flatten(rest)).alias("items"))
    n = basket_df.select(F.count(F.lit(1))).scalar()
    counted = pairs.groupBy("items").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= F.ceil(min_support * n))
    return counted.select("items", F.lit(2).alias("size"), "freq", (F.col("freq") / n).alias("support"))


def association_rules(itemsets: DataFrame, min_confidence: float = 0.1) -> DataFrame:
    """Z3: rules A -> C for every frequent itemset I and every non-empty
    proper subset A of I (C = I - A), with support(I), confidence =
    support(I) / support(A) and lift = confidence / support(C); only rules
    with confidence >= ``min_confidence``."""
    multi = itemsets.filter(F.col("size") >= 2)
    masks = F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2), F.col("size")).cast("long") - 2)
    split = multi.select("items", F.col("support").alias("support"), F.explode(masks).alias("mask"))

    def pick(bit: int):
        return F.filter("items", lambda x, i: (F.col("mask").bitwiseAND(F.pow(F.lit(2), i).cast("long")) != 0)
                        == F.lit(bit == 1))

    rules = split.select(pick(1).alias("antecedent"), pick(0).alias("consequent"), "support")
    sup = itemsets.select(F.col("items").alias("_k"), F.col("support").alias("_s"))
    rules = (rules.join(sup.withColumnRenamed("_s", "antecedent_support"), F.col("antecedent") == F.col("_k"))
             .drop("_k")
             .join(sup.withColumnRenamed("_s", "consequent_support"), F.col("consequent") == F.col("_k"))
             .drop("_k"))
    rules = rules.withColumn("confidence", F.col("support") / F.col("antecedent_support"))
    rules = rules.withColumn("lift", F.col("confidence") / F.col("consequent_support"))
    return rules.filter(F.col("confidence") >= min_confidence)
