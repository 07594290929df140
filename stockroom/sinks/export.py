"""CSV outputs.

Exports are written by the executors (one file per task); nothing is
collected to the driver. An ordered export is range-partitioned by its sort
key, so the part files, read in name order, form one sorted report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _texty(df: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, date_format)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, date_format: str = "yyyy-MM-dd",
              mode: str = "overwrite") -> None:
    """K9: CSV with a header; with ``order`` the files are globally sorted."""
    out = _texty(df, date_format)
    if order:
        out = out.orderBy(*order)
    out.write.mode(mode).option("header", True).csv(path)


SPREAD = 8


def write_per_period(df: DataFrame, path: str, period_col: str, date_format: str = "yyyy-MM-dd") -> None:
    """One output folder per day / month (``partitionBy``); rows are
    clustered by the period first so each task writes few folders. A period
    is spread over ``SPREAD`` tasks, so a busy one is no single task."""
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD))
    _texty(df, date_format).repartition(period_col, spread).write.mode("overwrite").partitionBy(period_col) \
        .option("header", True).csv(path)


# Fixed value: section order of the summary report (detail, subtotals, total).
SECTION_ORDER = {"DETAIL": 0, "SUBTOTAL": 1, "BRAND_SUBTOTAL": 1, "CATEGORY_SUBTOTAL": 2, "GRAND_TOTAL": 3}


def write_report(summary: DataFrame, path: str, keys: list[str], row_type: str = "Row_Type") -> None:
    """Detail, subtotal and grand-total rows of a grouping-sets report
    in one sorted CSV output (sections in order, keys sorted within)."""
    section = F.coalesce(*[F.when(F.col(row_type) == k, F.lit(v)) for k, v in SECTION_ORDER.items()], F.lit(9))
    ordered = (summary.withColumn("_section", section)
               .orderBy("_section", *[F.col(k).asc_nulls_last() for k in keys]).drop("_section"))
    _texty(ordered).write.mode("overwrite").option("header", True).csv(path)
