"""Cleaning, validation and in-file duplicate policies.

``validate`` splits a frame into good and bad rows in one pass: every rule is
a Column, the reasons are collected into an array column, and the two
outputs are two filters over the same (cacheable) projection. Nothing is
collected to the driver; ``on_invalid='fail'`` checks ``bad.isEmpty()``,
a job that stops at the first bad row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_day_first
from ..functions.numbers import lenient_int, strict_int
from ..functions.text import trim_or_blank

PRODUCT = ["Brand_Category", "Brand", "Size_ML"]


class InvalidRowsError(ValueError):
    """Raised by ``on_invalid='fail'``; carries the DataFrame of bad rows."""

    def __init__(self, message: str, bad: DataFrame):
        super().__init__(message)
        self.bad = bad


def standardize(df: DataFrame, has_date: bool = True, ints: str = "strict", text_cols: list[str] | None = None,
                date_parser=parse_day_first) -> DataFrame:
    """Trim text (NULL -> ''), parse Size_ML / Qty as integers and
    the date day-first. Unparseable values become NULL; ``validate`` turns
    them into reasons."""
    to_int = strict_int if ints == "strict" else lenient_int
    out = df
    for c in text_cols or ["Brand_Category", "Brand"]:
        if c in df.columns:
            out = out.withColumn(c, trim_or_blank(c))
    for c in ("Size_ML", "Qty"):
        if c in df.columns:
            out = out.withColumn(c, to_int(c))
    if has_date and "Date" in df.columns and dict(df.dtypes)["Date"] == "string":
        out = out.withColumn("Date", date_parser("Date"))
    return out


def validate(df: DataFrame, min_qty: int = 0, required_text: list[str] | None = None, has_date: bool = True,
             on_invalid: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """D6 + D7: returns ``(good, bad)``; ``bad`` has a ``reasons`` array.

    ``min_qty=0`` accepts Qty >= 0, ``min_qty=1`` requires Qty > 0.
    ``on_invalid``: ``quarantine`` (return both), ``fail`` (raise when any
    row is bad), ``coerce`` (bad numbers -> 0, then rows under ``min_qty``
    dropped; no bad output).
    """
    required_text = required_text if required_text is not None else [c for c in ("Brand_Category", "Brand")
                                                                      if c in df.columns]
    if on_invalid == "coerce":
        out = df
        for c in ("Size_ML", "Qty"):
            if c in df.columns:
                out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
        good = out.filter(F.col("Qty") >= min_qty)
        for c in required_text:
            good = good.filter(F.col(c) != "")
        return good, df.limit(0).withColumn("reasons", F.array().cast("array<string>"))
    checks = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"blank {c}")) for c in required_text]
    if "Size_ML" in df.columns:
        checks.append(F.when(F.col("Size_ML").isNull(), F.lit("bad Size_ML")))
    if "Qty" in df.columns:
        checks.append(F.when(F.col("Qty").isNull(), F.lit("bad Qty"))
                      .when(F.col("Qty") < min_qty, F.lit(f"Qty below {min_qty}")))
    if has_date and "Date" in df.columns:
        checks.append(F.when(F.col("Date").isNull(), F.lit("bad Date")))
    tagged = df.withColumn("reasons", F.filter(F.array(*checks), lambda x: x.isNotNull()))
    good = tagged.filter(F.size("reasons") == 0).drop("reasons")
    bad = tagged.filter(F.size("reasons") > 0)
    if on_invalid == "fail":
        if not bad.isEmpty():
            raise InvalidRowsError("input has invalid rows", bad)
    elif on_invalid != "quarantine":
        raise ValueError(f"unknown on_invalid {on_invalid!r}")
    return good, bad


def merge_duplicates(df: DataFrame, keys: list[str], policy: str = "sum", value: str = "Qty",
                     order_col: str | None = None) -> DataFrame:
    """One row per key.

    - ``sum``: add the values; other columns are those of the first row by
      ``order_col``, or each the smallest where none is given;
    - ``exact_then_sum``: drop identical rows first, then add;
    - ``last`` / ``first``: keep the whole row that is last / first by
      ``order_col`` (required: input order is not defined in Spark);
    - ``sum_last``: add ``value``, other columns from the last row.

    All are partial aggregations (``max_by`` / ``min_by`` on a struct), so a
    key holding a third of the rows does not reach one task whole.
    """
    if policy in ("sum", "exact_then_sum"):
        src = df.dropDuplicates() if policy == "exact_then_sum" else df
        others = [c for c in df.columns if c not in keys and c != value]
        aggs = [F.sum(value).cast("bigint").alias(value)] + [
            (F.min_by(c, order_col) if order_col else F.min(c)).alias(c) for c in others]
        return src.groupBy(*keys).agg(*aggs).select(*df.columns)
    if order_col is None:
        raise ValueError(f"policy {policy!r} needs an explicit order_col")
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    if policy in ("last", "first"):
        pick = F.max_by(row, order_col) if policy == "last" else F.min_by(row, order_col)
        g = df.groupBy(*keys).agg(pick.alias("_r"))
        return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)
    if policy == "sum_last":
        g = df.groupBy(*keys).agg(F.max_by(row, order_col).alias("_r"), F.sum(value).cast("bigint").alias("_v"))
        cols = [F.col("_v").alias(c) if c == value else F.col(f"_r.{c}").alias(c) for c in rest]
        return g.select(*keys, *cols).select(*df.columns)
    raise ValueError(f"unknown duplicate policy {policy!r}")


def first_per_key(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """K3 helper: the first row per key by ``order_col``. ``groupBy`` puts
    NULL keys in one group, so key equality is null-safe; ``min_by`` is a
    partial aggregation, so a hot key is never gathered whole."""
    return merge_duplicates(df, keys, policy="first", order_col=order_col)
