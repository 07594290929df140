"""CSV sources.

Every column is read as text (no schema inference, which would be a second
pass over the data and guesses types per file); typing happens in
``operators.clean.standardize`` with explicit, tolerant rules.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_header, keep_column


class MissingColumnsError(ValueError):
    def __init__(self, path: str, missing: list[str]):
        super().__init__(f"{path}: missing required columns {missing}")
        self.missing = missing


def _reader(spark: SparkSession, multiline: bool = False, encoding: str = "UTF-8"):
    # S3: quoted fields may hold commas; the CSV reader drops a UTF-8 BOM.
    return (spark.read.option("header", True).option("inferSchema", False).option("quote", '"')
            .option("escape", '"').option("encoding", encoding).option("multiLine", multiline))


def _normalise_headers(df: DataFrame) -> DataFrame:
    """Trimmed header names; pandas index columns and ``_id`` dropped."""
    cols = [(c, clean_header(c)) for c in df.columns]
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in cols if keep_column(new)])


def load_csv(spark: SparkSession, path: str, required_columns: list[str] | None = None,
             multiline: bool = False, with_file: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """One CSV (or a folder of CSVs with the same header), all columns as
    text, header names trimmed; raises listing missing required columns."""
    df = _reader(spark, multiline, encoding).csv(path)
    if with_file:
        df = df.withColumn("_file", F.col("_metadata.file_path"))
    df = _normalise_headers(df)
    missing = [c for c in (required_columns or []) if c not in df.columns]
    if missing:
        raise MissingColumnsError(path, missing)
    return df


def file_headers(spark: SparkSession, folder: str, pattern: str = "*.csv", encoding: str = "UTF-8") -> DataFrame:
    """The header line of every file in ``folder``: (file_path, columns).

    The files are read as text once; the header is the first line of the
    split that starts at byte 0 of each file (``monotonically_increasing_id``
    grows with the row order inside a split). No file is opened on the
    driver."""
    # the CSV reader decodes; with a separator that no header has, a record is a line
    raw = (spark.read.schema("value string").option("pathGlobFilter", pattern).option("encoding", encoding)
           .option("sep", "\x00").option("quote", "").csv(folder))
    lines = (raw
             .select("value", F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_block_start").alias("_start"),
                     F.monotonically_increasing_id().alias("_id")))
    first = (lines.filter(F.col("_start") == 0).groupBy("file_path")
             .agg(F.min_by("value", "_id").alias("header")))
    cols = F.transform(F.split(F.regexp_replace("header", "^﻿", ""), ","),
                       lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', "")))
    return first.select("file_path", cols.alias("columns"))


def load_folder(spark: SparkSession, folder: str, required_columns: list[str], pattern: str = "*.csv",
                multiline: bool = False, encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """All CSV files of a folder as one frame with file provenance.

    A file lacking a required column is reported ``failed`` (not fatal).
    Files are grouped by header layout and each layout is read once with
    its own header, so files with a different column order still line up by
    name. Returns ``(rows, file_report)``; ``rows`` has ``_file``.
    """
    heads = file_headers(spark, folder, pattern, encoding)
    req = F.array(*[F.lit(c) for c in required_columns])
    report = heads.select("file_path", "columns",
                          F.array_except(req, F.col("columns")).alias("missing"))
    report = report.withColumn("status", F.when(F.size("missing") == 0, "ok").otherwise("failed"))
    # Layouts are few (one per distinct header); the list of paths per layout
    # is file metadata, not data.
    layouts = (report.filter(F.col("status") == "ok").groupBy("columns")
               .agg(F.collect_list("file_path").alias("paths")).collect())
    frames = []
    for row in layouts:
        df = _reader(spark, multiline, encoding).csv(list(row["paths"]))
        df = df.withColumn("_file", F.col("_metadata.file_path"))
        frames.append(_normalise_headers(df))
    if not frames:
        schema = ", ".join(f"`{c}` string" for c in required_columns) + ", _file string"
        rows = spark.createDataFrame([], schema)
    else:
        rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows, report


def csv_to_json(spark: SparkSession, src: str, dst: str) -> None:
    """Re-encode CSV records as JSON lines at a new path (the source
    file is never overwritten)."""
    if src.rstrip("/") == dst.rstrip("/"):
        raise ValueError("refusing to overwrite the source")
    load_csv(spark, src).write.mode("overwrite").json(dst)
