"""End-to-end jobs: daily sales files to tables, and the multi-day
inventory run. Both follow one order: read -> clean (good, bad) ->
aggregate -> check -> write, so a crash at any point leaves what was there
before, and the same job run again completes it.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inventory as inv
from ..operators.clean import merge_duplicates, standardize, validate
from ..session import cut_lineage
from ..sinks.tables import FILES, MONTH, month_of, processed, read_table, upsert_counts, upsert_months, write_run
from ..sources import csv as csvsrc
from ..sources import files

PRODUCT = ["Brand_Category", "Brand", "Size_ML"]
SALES_COLUMNS = ["Date", *PRODUCT, "Qty"]


def load_sales_folder(spark: SparkSession, folder: str, base: str, run_ts, table: str = "daily_sales",
                      min_qty: int = 0, dedupe: str = "sum", mode: str = "set") -> dict[str, DataFrame | list[str]]:
    """Daily sales CSV folder -> keyed table ``{base}/{table}``, partitioned by month.

    Rows of files that a month of the table already has are skipped (S12); files
    missing a column are reported ``failed`` (S2); bad rows are quarantined
    (D6); duplicates per key are merged (D5); the batch is upserted (K1 / K2)
    and rewrites only the months it has rows of. A retry adds nothing.
    Returns the file report, the bad rows, the upsert counts (K6) and the months.
    """
    path, keys = f"{base.rstrip('/')}/{table}", ["Date", *PRODUCT]
    hashes = files.file_hashes(spark, folder, "*.csv").select(F.col("file_path").alias("_file"), "file_hash")
    rows, report = csvsrc.load_folder(spark, folder, SALES_COLUMNS)
    good, bad = validate(standardize(rows.join(hashes, "_file")), min_qty=min_qty)
    current = read_table(spark, path)
    fresh = cut_lineage(processed(current, good.select(*SALES_COLUMNS, "file_hash").withColumn(MONTH, month_of("Date"))))
    files_of = fresh.groupBy(*keys).agg(F.array_sort(F.collect_set("file_hash")).alias(FILES))
    same = functools.reduce(lambda a, b: a & b, [F.col(f"b.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys])
    merged = merge_duplicates(fresh.select(*SALES_COLUMNS), keys, dedupe)
    batch = merged.alias("b").join(files_of.alias("f"), same).select("b.*", f"f.{FILES}")
    # counted before the months change
    old = batch.limit(0) if current is None else current.join(fresh.select(MONTH).distinct(), MONTH, "left_semi")
    counts = cut_lineage(upsert_counts(old.select(*SALES_COLUMNS), merged, keys, ["Qty"]))
    months = upsert_months(spark, path, batch, keys, "Date", mode, run_ts)
    return {"files": report, "bad_rows": bad, "counts": counts, "months": months}


def run_inventory_days(base: str, initial: DataFrame, incoming: DataFrame, sales: DataFrame, run_ts,
                       on_negative: str = "fail", snapshot_dates: list | None = None) -> dict[str, DataFrame]:
    """The multi-day run as one job: closed-form balances, the
    failure check, then the tables of the run, which become visible together: balances
    per movement day, the final inventory, the cleaned inputs, the daily summary, and
    the stock of every product on each of ``snapshot_dates`` (one plan for all dates)."""
    spark = initial.sparkSession
    r = inv.multi_day_inventory(initial, incoming, sales)
    if on_negative == "fail" and not r["violations"].isEmpty():
        raise inv.NegativeStockError("sales exceed stock on hand", r["violations"])
    balances = cut_lineage(r["balances"])
    tables = {"inventory_balances": balances,
              "final_inventory": r["final"].withColumn("updated_at", F.lit(run_ts).cast("timestamp")),
              "daily_processing_summary": r["summary"], "ignored_sales": r["ignored_sales"],
              "cleaned_incoming": incoming, "cleaned_sales": sales}
    if snapshot_dates:
        dates = spark.createDataFrame([(d,) for d in snapshot_dates], "Date date")
        tables["inventory_snapshots"] = inv.stock_on_dates(balances, dates, opening=initial)
    write_run(base, run_ts, tables)
    return r
