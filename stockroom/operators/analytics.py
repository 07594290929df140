"""Window and analytic operators.

Design rule: aggregate first, window second. A window partitioned by a hot
key (one brand may hold a third of all rows) would put that whole key in one
task, so every window here runs over an aggregated table whose size is
bounded by distinct values (brands x months, brand x quantity), never by
raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .reports import _money_sum, _qty_sum, ratio


def average_rank(df: DataFrame, partition: list[str], value: str, name: str = "rank",
                 descending: bool = True) -> DataFrame:
    """Rank of ``value`` within ``partition``; ties get the average rank
    (pandas ``rank(method='average')``). NULL values get a NULL rank.

    Computed as: rows with a better value + (ties + 1) / 2, from a count per
    (partition, value). The counts are a partial aggregation, the window runs
    over distinct values only, and the ranks are joined back to the rows.
    """
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*partition, value).agg(F.count(F.lit(1)).alias("_n")))
    order = F.col(value).desc() if descending else F.col(value).asc()
    before = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(*partition, value,
                          (F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2.0)
                          .alias(name))
    return df.join(ranks, [*partition, value], "left")


def share_of_total(agg: DataFrame, within: list[str], value: str, name: str | None = None) -> DataFrame:
    """``value / sum(value) over (partition by within)`` on an already
    aggregated table (e.g. month x brand)."""
    # With no grouping the total is a scalar subquery (partial sums per task),
    # never a window over one partition.
    total = F.sum(value).over(Window.partitionBy(*within)) if within else agg.select(F.sum(value)).scalar()
    return agg.withColumn(name or f"{value}_share", ratio(F.col(value), total))


def period_dimension_totals(priced: DataFrame, period_col: str, dims: list[str]) -> DataFrame:
    """Per period, totals by each dimension separately, in one pass with
    grouping sets. Output: period, dimension name, dimension value (text),
    quantity, amount."""
    sets = [[period_col, d] for d in dims]
    g = priced.groupingSets(sets, period_col, *dims).agg(
        _qty_sum().alias("total_qty"), _money_sum().alias("total_amount"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    dim_name = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dims])
    dim_value = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")) for d in dims])
    return g.select(period_col, dim_name.alias("dimension"), dim_value.alias("value"), "total_qty", "total_amount")


def last_n_periods(df: DataFrame, date_col: str, n: int) -> DataFrame:
    """The last ``n`` present dates (a top-n, not a full sort), oldest
    first."""
    return df.orderBy(F.col(date_col).desc()).limit(n).orderBy(date_col)
