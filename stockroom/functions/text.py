"""Text clean-up and parsing (X1, X14, X15, X18-X20, X23 and the search normaliser).

Every function returns a Column built from JVM-side functions, so it runs
inside whole-stage codegen; none of them needs Python at run time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of, try_cast

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------
# Millilitre spellings folded to "ML" by the item-name normaliser.
MILLILITRE_WORDS = ["MILLILITERS", "MILLILITRES", "MILLILITER", "MILLILITRE"]
# Spoken number words and what they become (includes the usual mishearings).
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "too": "2", "to": "2", "three": "3",
    "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
# Bottle sizes recognised in spoken requests, in millilitres.
KNOWN_SIZES_ML = [60, 90, 180, 200, 250, 275, 330, 375, 500, 650, 700, 750, 1000]
# Words ignored when matching a request against item names.
IGNORED_SEARCH_WORDS = ["the", "a", "an", "of", "and", "ml", "m", "l",
                        "milliliter", "milliliters", "millilitre", "millilitres",
                        "liter", "liters", "litre", "litres"]
# Phrases that make a chat question a sales question.
SALES_QUESTION_PHRASES = [
    "daily sale", "daily sales", "sales today", "today sale", "today sales",
    "sale figure", "sales figure", "total sale", "total sales", "quantity sold",
    "bottles sold", "voucher sales", "sales trend", "sales graph", "sales chart",
]
# ---------------------------------------------------------------------------


def trim_or_blank(c) -> Column:
    """Trimmed text, NULL -> ''."""
    return F.coalesce(F.trim(col_of(c).cast("string")), F.lit(""))


def blank_to_null(c) -> Column:
    """Trimmed text with '' turned into NULL."""
    t = F.trim(col_of(c).cast("string"))
    return F.when(t == "", F.lit(None).cast("string")).otherwise(t)


def size_from_item(c, journal: bool = False) -> Column:
    """Size in ML from an item name such as ``'ROYAL STAG 750 - ML'``.

    ``journal=True`` also accepts ``'750ML'`` / ``'750 ML'`` as whole words.
    """
    text = F.upper(F.coalesce(col_of(c), F.lit("")))
    if not journal:
        return try_cast(F.regexp_extract(text, r"(\d+)\s*-\s*ML", 1), "int")
    dashed = F.regexp_extract(text, r"(\d+)\s*-\s*ML", 1)
    plain = F.regexp_extract(text, r"\b(\d+)\s*ML\b", 1)
    # The reference's alternation takes whichever form occurs first.
    dashed_pos = F.regexp_instr(text, F.lit(r"(\d+)\s*-\s*ML"))
    plain_pos = F.regexp_instr(text, F.lit(r"\b(\d+)\s*ML\b"))
    pick = F.when((dashed != "") & ((plain == "") | (dashed_pos <= plain_pos)), dashed).otherwise(plain)
    return try_cast(pick, "int")


def brand_from_item(c, trailing_only: bool = False) -> Column:
    """Item name without its size suffix.

    Default: cut the size and everything after it. ``trailing_only``: remove
    the size only when it ends the name.
    """
    pattern = r"(?i)\s+\d+\s*-\s*ML$" if trailing_only else r"(?i)\s*\d+\s*-\s*ML.*$"
    return F.trim(F.regexp_replace(F.coalesce(col_of(c), F.lit("")), pattern, ""))


def look_column(category, brand, size) -> Column:
    """``'(Category) - Brand - 750 ML'``."""
    return F.concat(F.lit("("), col_of(category).cast("string"), F.lit(") - "),
                    col_of(brand).cast("string"), F.lit(" - "), col_of(size).cast("string"), F.lit(" ML"))


def normalize_item_name(c) -> Column:
    """Upper case, punctuation dropped or spaced, millilitre words -> ML,
    runs of white space squeezed."""
    t = F.upper(F.coalesce(col_of(c).cast("string"), F.lit("")))
    t = F.regexp_replace(t, r"[-_,]", " ")
    t = F.regexp_replace(t, r"[.'\"]", "")
    t = F.regexp_replace(t, "|".join(MILLILITRE_WORDS), "ML")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def _squeeze(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def spoken_to_digits(c) -> Column:
    """Number words -> digits, whole words only, lower case."""
    t = F.lower(F.coalesce(col_of(c), F.lit("")))
    for word, digit in NUMBER_WORDS.items():
        t = F.regexp_replace(t, rf"\b{word}\b", digit)
    return _squeeze(t)


def spoken_size(c) -> Column:
    """First known bottle size mentioned in a spoken request, else NULL."""
    t = spoken_to_digits(c)
    sizes = "|".join(str(s) for s in KNOWN_SIZES_ML)
    return try_cast(F.regexp_extract(t, rf"\b({sizes})\b", 1), "int")


def spoken_item_name(c) -> Column:
    """Request text without the unit words and without the recognised
    size (the first known size mentioned; every whole-word occurrence of it
    is removed). Unit words are removed as whole words (the reference also
    cut the letters 'ml' out of the middle of words; not reproduced)."""
    t = spoken_to_digits(c)
    t = F.regexp_replace(t, r"millilit(er|re)s?|lit(er|re)s?", " ")
    sizes = "|".join(str(s) for s in KNOWN_SIZES_ML)
    size = F.regexp_extract(t, rf"\b({sizes})\b", 1)
    t = F.when(size != "", F.regexp_replace(t, F.concat(F.lit(r"\b"), size, F.lit(r"\b")), F.lit(" "))) \
        .otherwise(t)
    t = F.regexp_replace(t, r"\bm\s?l\b", " ")
    t = F.regexp_replace(t, "-", " ")
    return _squeeze(t)


def normalize_for_search(c) -> Column:
    """Z5 helper: lower case, '&' -> 'and', punctuation spaced, unit words
    dropped (whole words), both whisky spellings folded to 'whisky'."""
    t = F.lower(F.coalesce(col_of(c), F.lit("")))
    t = F.regexp_replace(t, "&", " and ")
    t = F.regexp_replace(t, r"[-_.,]", " ")
    t = F.regexp_replace(t, r"['\"]", "")
    t = F.regexp_replace(t, r"millilit(er|re)s?|lit(er|re)s?", " ")
    t = F.regexp_replace(t, r"\bm\s?l\b", " ")
    t = F.regexp_replace(t, r"\bwhiske?y\b", "whisky")
    return _squeeze(t)


def search_words(c) -> Column:
    """Z5 helper: distinct non-ignored words of the normalised request."""
    words = F.split(normalize_for_search(c), " ")
    ignored = F.array(*[F.lit(w) for w in IGNORED_SEARCH_WORDS])
    return F.array_distinct(F.filter(F.array_except(words, ignored), lambda w: w != ""))


def is_sales_question(c) -> Column:
    """Any of the sales phrases occurs (case-insensitive)."""
    t = F.lower(F.coalesce(col_of(c), F.lit("")))
    return F.regexp_like(t, F.lit("|".join(SALES_QUESTION_PHRASES)))


def question_date(c, as_of) -> Column:
    """ISO date in the text, else ``dd/mm/yyyy``, else ``as_of``.

    'today' maps to ``as_of`` as well (a fixed run date keeps output
    reproducible). An impossible ISO date is returned as NULL.
    """
    t = F.lower(F.coalesce(col_of(c), F.lit("")))
    iso = F.regexp_extract(t, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    dmy = F.regexp_extract(t, r"\b(\d{2}/\d{2}/\d{4})\b", 1)
    as_of_col = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    return (F.when(F.instr(t, "today") > 0, as_of_col)
            .when(iso != "", F.try_to_date(iso, "yyyy-MM-dd"))
            .when(dmy != "", F.try_to_date(dmy, "dd/MM/yyyy"))
            .otherwise(as_of_col))


def clean_header(name: str) -> str:
    """Header names are trimmed (and a stray BOM removed)."""
    return name.replace("﻿", "").strip()


def keep_column(name: str) -> bool:
    """Drop pandas index columns and the document id."""
    return not (name.startswith("Unnamed") or name == "_id")
