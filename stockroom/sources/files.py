"""File content hashes and the processed-file guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_hashes(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """SHA-256 of every file's content, computed on the executors
    (``binaryFile`` source; one row per file)."""
    r = spark.read.format("binaryFile")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    files = r.load(path)
    return files.select(F.col("path").alias("file_path"), F.sha2(F.col("content"), 256).alias("file_hash"),
                        F.col("length").alias("file_size"))


def unprocessed(hashes: DataFrame, log: DataFrame | None) -> DataFrame:
    """Files whose hash is not in the processed log (left anti join).
    Register a file in the log only after its data has been committed."""
    if log is None:
        return hashes
    return hashes.join(log.select("file_hash"), "file_hash", "left_anti")


def log_rows(hashes: DataFrame, run_ts, status: str = "completed") -> DataFrame:
    """Rows to append to the processed-file log for a committed batch."""
    return hashes.select("file_hash", F.element_at(F.split("file_path", "/"), -1).alias("file_name"),
                         F.lit(status).alias("status"), F.lit(run_ts).cast("timestamp").alias("processed_at"))
