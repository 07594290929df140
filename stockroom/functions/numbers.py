"""Numeric coercion and arithmetic helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of, try_cast

MONEY = "decimal(18,2)"
MONEY_SUM = "decimal(28,2)"

# Fixed value: sort key given to rows without a serial number.
MISSING_SERIAL = 999999


def strict_int(c) -> Column:
    """Whole numbers only; ``'1.5'`` and ``'abc'`` become NULL."""
    return try_cast(F.trim(col_of(c).cast("string")), "int")


def lenient_int(c) -> Column:
    """``int(float(x))``, truncating toward zero; bad input -> NULL."""
    return try_cast(try_cast(F.trim(col_of(c).cast("string")), "double"), "int")


def coerce_number(c, default: float = 0.0, to: str = "double") -> Column:
    """Numeric value, or ``default`` when missing or not a number."""
    return F.coalesce(try_cast(F.trim(col_of(c).cast("string")), to), F.lit(default).cast(to))


def int_or_fail(c) -> Column:
    """X5 (failing form, ``$toInt``): a plain cast; with ANSI mode on (the
    Spark 4 default) a bad value fails the query instead of becoming NULL."""
    return F.trim(col_of(c).cast("string")).cast("int")


def signed_qty(kind_col, qty_col, negative_kinds=("sale", "sales", "sold")) -> Column:
    """Receipts count ``+qty``, sales ``-qty``."""
    return F.when(F.lower(col_of(kind_col)).isin(*negative_kinds), -col_of(qty_col)).otherwise(col_of(qty_col))


def first_number_plain(c) -> Column:
    """First run of digits and dots, as a double; 0 when none."""
    s = F.regexp_extract(F.coalesce(col_of(c), F.lit("")), r"([\d.]+)", 1)
    return F.coalesce(try_cast(s, "double"), F.lit(0.0))


def first_number_signed(c) -> Column:
    """Commas removed, first signed decimal number; 0 when none."""
    s = F.regexp_replace(F.coalesce(col_of(c), F.lit("")), ",", "")
    return F.coalesce(try_cast(F.regexp_extract(s, r"(-?\d+(\.\d+)?)", 1), "double"), F.lit(0.0))


def number_strip_units(c, unit: str = "NOS") -> Column:
    """Drop commas and the unit word, then parse; 0 when not a number."""
    s = F.trim(F.replace(F.regexp_replace(F.coalesce(col_of(c), F.lit("")), ",", ""), F.lit(unit), F.lit("")))
    return F.coalesce(try_cast(s, "double"), F.lit(0.0))


def quantity_signed_int(c) -> Column:
    """Journal quantity: first signed number, truncated to an int; 0 when none."""
    s = F.regexp_extract(F.coalesce(col_of(c), F.lit("")), r"(-?\d+(\.\d+)?)", 1)
    return F.coalesce(try_cast(try_cast(s, "double"), "int"), F.lit(0))


def split_rate_unit(c, default_unit: str = "NOS") -> tuple[Column, Column]:
    """``'2114.00/NOS'`` -> (2114.0, 'NOS'); blank -> (0.0, default unit).

    A non-numeric rate part becomes NULL (flagged by the caller as invalid).
    """
    text = F.trim(F.coalesce(col_of(c), F.lit("")))
    parts = F.split(text, "/")
    rate_text = F.trim(F.regexp_replace(F.get(parts, 0), ",", ""))
    rate = F.when(text == "", F.lit(0.0)).otherwise(try_cast(rate_text, "double"))
    unit_part = F.trim(F.get(parts, 1))
    unit = F.when(unit_part.isNull(), F.lit(default_unit)).otherwise(unit_part)
    return rate, unit


def money(c) -> Column:
    """Money as DECIMAL(18,2) (binary floats make sums order dependent)."""
    return col_of(c).cast(MONEY)


def line_total(qty, price) -> Column:
    """``qty * price`` with a missing price counted as 0 (X21, ``$ifNull``)."""
    return (F.coalesce(col_of(qty), F.lit(0)) * F.coalesce(col_of(price), F.lit(0).cast(MONEY))).cast(MONEY)


def serial_sort_key(c) -> Column:
    """Null-safe numeric sort key."""
    return F.coalesce(try_cast(col_of(c), "bigint"), F.lit(MISSING_SERIAL).cast("bigint"))


def clamp_at_zero(c) -> Column:
    """``max(0, x)``."""
    return F.greatest(col_of(c), F.lit(0))
