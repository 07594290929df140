"""Helpers shared by the training-data operators.

Text rules used throughout: white space is ``[\\x20\\x09-\\x0D]``, a word is a
run of anything else, and only A-Z are lower-cased. ``bytes.split()`` and
``bytes.lower()`` follow exactly these rules on UTF-8.

Rows whose id is null take no part in any operator and are not returned.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

WHITE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folded_key(col: Column) -> Column:
    """A string that is equal for two texts exactly if they are equal with A-Z lower-cased.

    The UTF-8 bytes are read as Latin-1 and lower-cased: A-Z become a-z, and
    of the other bytes only lead bytes change (C0-DE to E0-FE). The number of
    continuation bytes that follow still tells a changed lead byte from an
    original one, so nothing else is made equal. Several times faster than
    ``translate``.
    """
    return F.lower(F.decode(col.cast("binary"), "ISO-8859-1"))


def strip_white(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE))


def fold(col: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(col.cast("string").cast("binary")) % modulus


def row_key(text: Column) -> Column:
    """Tells apart rows that share an id but not the text."""
    return F.xxhash64(text)
