"""Item attributes parsed from accounting item names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import brand_from_item, size_from_item


def with_item_attributes(df: DataFrame, name_col: str = "stock_item_name", unit: str = "NOS") -> DataFrame:
    """Adds ``brand`` (name without the size suffix), ``size_ml`` and a
    default ``unit`` when the input has none."""
    out = df.withColumn("brand", brand_from_item(name_col)).withColumn("size_ml", size_from_item(name_col))
    if "unit" not in df.columns:
        out = out.withColumn("unit", F.lit(unit))
    return out
