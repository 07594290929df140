"""Daily series and forecasting features.

A series is first aggregated per (key, date) with a distributed partial
aggregation; only then is it densified and windowed. Windows are
partitioned by the series key, so each task holds one series of at most a
few thousand days. The all-products series has no key and therefore one
window partition: it is one row per calendar day, bounded by the calendar,
not by the data volume.

Rolling statistics are computed from exact running sums (integers or
decimals), so they do not depend on evaluation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import calendar_parts

DEFAULT_LAGS = (1, 2, 3, 7)
DEFAULT_MEANS = (7, 14)
DEFAULT_STDS = (7,)


def daily_series(df: DataFrame, value: str = "Qty", keys: list[str] | None = None, date_col: str = "Date",
                 name: str = "y") -> DataFrame:
    """One row per key and calendar day between the key's first and last
    date; days without rows get 0."""
    keys = keys or []
    daily = df.groupBy(*keys, date_col).agg(F.sum(value).alias(name))
    bounds = daily.groupBy(*keys).agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    grid = bounds.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias(date_col))
    return (grid.join(daily, [*keys, date_col], "left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(0).cast(daily.schema[name].dataType))))


def _window(keys, date_col):
    w = Window.orderBy(date_col)
    return Window.partitionBy(*keys).orderBy(date_col) if keys else w


def add_features(series: DataFrame, keys: list[str] | None = None, date_col: str = "Date", name: str = "y",
                 lags=DEFAULT_LAGS, means=DEFAULT_MEANS, stds=DEFAULT_STDS, shift: int = 1,
                 calendar: bool = True) -> DataFrame:
    """W2 + W3 + X12: lag columns, rolling means and rolling sample standard
    deviations, and calendar parts.

    ``shift=1`` ends every rolling window on the previous day (no target
    leak); ``shift=0`` includes the current day as the reference's models
    did. A rolling value is NULL until its window is full.
    """
    keys = keys or []
    w = _window(keys, date_col)
    y = F.col(name)
    out = series
    for n in lags:
        out = out.withColumn(f"lag_{n}", F.lag(y, n).over(w))
    for n in sorted(set(means) | set(stds)):
        frame = w.rowsBetween(-(n - 1) - shift, -shift)
        cnt, s1, s2 = F.count(y).over(frame), F.sum(y).over(frame), F.sum(y * y).over(frame)
        full = cnt == n
        if n in means:
            out = out.withColumn(f"rolling_mean_{n}", F.when(full, s1.cast("double") / F.lit(float(n))))
        if n in stds:
            num = (F.lit(n) * s2 - s1 * s1).cast("double")
            out = out.withColumn(f"rolling_std_{n}", F.when(full, F.sqrt(num / F.lit(float(n * (n - 1))))))
    if calendar:
        for cname, c in calendar_parts(date_col).items():
            out = out.withColumn(cname, c)
    return out


def feature_table(series: DataFrame, keys: list[str] | None = None, date_col: str = "Date", name: str = "y",
                  missing: str = "drop", **kw) -> DataFrame:
    """The feature table. ``missing='drop'`` removes warm-up rows with any
    NULL feature; ``'zero'`` fills them with 0."""
    f = add_features(series, keys, date_col, name, **kw)
    feats = [c for c in f.columns if c not in (*(keys or []), date_col, name)]
    if missing == "drop":
        return f.dropna(subset=feats)
    if missing == "zero":
        return f.fillna(0, subset=feats)
    raise ValueError("missing must be 'drop' or 'zero'")


def time_split(df: DataFrame, date_col: str = "Date", train_fraction: tuple[int, int] = (4, 5),
               keys: list[str] | None = None) -> DataFrame:
    """Time-ordered split; the first ``floor(n * 4 / 5)`` rows (per key)
    are ``train``, the rest ``test``."""
    keys = keys or []
    num, den = train_fraction
    w = _window(keys, date_col)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys)) if keys else df.select(F.count(F.lit(1))).scalar()
    cut = F.expr(f"div({num} * _n, {den})")
    return (df.withColumn("_n", n).withColumn("_rn", F.row_number().over(w))
            .withColumn("split", F.when(F.col("_rn") <= cut, "train").otherwise("test"))
            .drop("_n", "_rn"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """MAE, RMSE and R2 (one row, or one per key)."""
    y = F.col(actual).cast("double")
    err = y - F.col(predicted).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
            F.sum(err * err).alias("_ssr"), F.sum(y * y).alias("_syy"), F.sum(y).alias("_sy")]
    g = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    sst = F.col("_syy") - F.col("_sy") * F.col("_sy") / F.col("n")
    return (g.withColumn("r2", F.when(sst != 0, 1 - F.col("_ssr") / sst))
            .select(*(keys or []), "n", "mae", "rmse", "r2"))
