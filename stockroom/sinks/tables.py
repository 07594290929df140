"""Keyed table writes on plain Parquet.

Parquet has no MERGE, so an upsert is computed as a DataFrame (full outer
join on the business key, one shuffle). Tables of dated rows are partitioned by
month, and Spark's dynamic partition overwrite replaces only the months that a
batch touches. The hashes of the files that a row comes from stand in the row,
so the processed-file guard is an anti-join with the table itself and a batch
that is run again adds nothing.

The upsert functions are pure (``DataFrame -> DataFrame``) and take a
``run_ts`` so that results are reproducible.
"""

from __future__ import annotations

import datetime as dt
import functools
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


CREATED, UPDATED = "created_at", "updated_at"


def _ts(run_ts) -> Column:
    if isinstance(run_ts, Column):
        return run_ts
    return F.lit(run_ts if run_ts is not None else dt.datetime(1970, 1, 1)).cast("timestamp")


def _key_match(keys: list[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])


def _one_per_key(incoming: DataFrame, keys: list[str], mode: str, value: str, order_col: str | None) -> DataFrame:
    rest = [c for c in incoming.columns if c not in keys]
    if not rest:
        return incoming.distinct()
    row = F.struct(*([F.col(order_col)] if order_col else []), *[F.col(c).alias(f"_{c}") for c in rest])
    pick = F.min(row) if mode == "insert_only" else F.max(row)
    added = [F.sum(value).cast(incoming.schema[value].dataType).alias("_v")] if mode == "inc" else []
    one = incoming.groupBy(*keys).agg(pick.alias("_r"), *added)
    get = lambda c: F.col("_v") if mode == "inc" and c == value else F.col(f"_r._{c}")
    return one.select(*[F.col(c) if c in keys else get(c).alias(c) for c in incoming.columns])


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], mode: str = "set", run_ts=None,
           value: str = "Qty", price_col: str = "Mrp", old_price_col: str = "Mrp_OLD",
           order_col: str | None = None, stamps: bool = True) -> DataFrame:
    """Apply ``incoming`` rows to ``existing`` on ``keys`` (null-safe).

    Modes (D8):
    - ``set`` (K1/K5/K7): new values replace old ones; ``created_at`` kept
      from the old row, stamped ``run_ts`` on insert; ``updated_at`` = run_ts;
    - ``inc`` (K2): ``value = old + new``, insert when absent;
    - ``insert_only`` (K3): only keys not present are added (first row per
      key by ``order_col`` when the batch repeats a key);
    - ``set_shift`` (K4): like ``set`` but when the price changes the old
      price moves to ``old_price_col``.

    A batch that repeats a key is reduced to one row per key first: ``inc``
    adds the values; the other modes keep the last row by ``order_col``
    (``insert_only``: the first), or by all columns where none is given, so
    the choice never depends on the order of arrival. Untouched rows pass
    through unchanged.
    """
    ts = _ts(run_ts)
    incoming = _one_per_key(incoming, keys, mode, value, order_col)
    cols = [c for c in existing.columns if c not in (CREATED, UPDATED)]
    new_cols = [c for c in incoming.columns if c not in (CREATED, UPDATED)]
    all_cols = cols + [c for c in new_cols if c not in cols]
    if mode == "insert_only":
        cond = _key_match(keys)
        fresh = incoming.alias("n").join(existing.alias("o"), cond, "left_anti")
        if stamps:
            fresh = fresh.withColumn(CREATED, ts).withColumn(UPDATED, ts)
        return existing.unionByName(fresh, allowMissingColumns=True)

    # A key column can itself be NULL; a marker column tells the sides apart.
    j = existing.withColumn("_o", F.lit(True)).alias("o").join(
        incoming.withColumn("_n", F.lit(True)).alias("n"), _key_match(keys), "full_outer")
    has_old, has_new = F.col("o._o").isNotNull(), F.col("n._n").isNotNull()
    out = []
    for c in all_cols:
        oc = F.col(f"o.{c}") if c in cols else F.lit(None)
        nc = F.col(f"n.{c}") if c in new_cols else F.lit(None)
        if c in keys:
            expr = F.when(has_old, oc).otherwise(nc)
        elif mode == "inc" and c == value:
            expr = F.coalesce(oc, F.lit(0)) + F.coalesce(nc, F.lit(0))
        elif mode == "set_shift" and c == old_price_col:
            changed = has_old & has_new & ~F.col(f"o.{price_col}").eqNullSafe(F.col(f"n.{price_col}"))
            expr = F.when(changed, F.col(f"o.{price_col}")).otherwise(
                F.coalesce(nc, oc) if c in new_cols else oc)
        elif mode in ("set", "set_shift", "inc"):
            expr = F.when(has_new, nc).otherwise(oc) if c in new_cols else oc
        else:
            raise ValueError(f"unknown mode {mode!r}")
        out.append(expr.alias(c))
    if stamps:
        created = F.col(f"o.{CREATED}") if CREATED in existing.columns else F.lit(None).cast("timestamp")
        updated = F.col(f"o.{UPDATED}") if UPDATED in existing.columns else F.lit(None).cast("timestamp")
        out.append(F.when(has_old, F.coalesce(created, ts)).otherwise(ts).alias(CREATED))
        out.append(F.when(has_new, ts).otherwise(updated).alias(UPDATED))
    return j.select(*out)


def upsert_counts(existing: DataFrame, incoming: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """K6: matched / modified / upserted counts in one aggregation over the
    tagged join (no driver loop)."""
    o = existing.withColumn("_o", F.lit(True)).alias("o")
    n = incoming.withColumn("_n", F.lit(True)).alias("n")
    j = o.join(n, _key_match(keys), "full_outer")
    has_old, has_new = F.col("o._o").isNotNull(), F.col("n._n").isNotNull()
    differs = functools.reduce(lambda a, b: a | b,
                               [~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in compare])
    return j.agg(F.count_if(has_old & has_new).alias("matched_count"),
                 F.count_if(has_old & has_new & differs).alias("modified_count"),
                 F.count_if(~has_old & has_new).alias("upserted_count"))


MONTH, FILES = "month", "files"


def dynamic_overwrite(df: DataFrame, path: str, by: str) -> None:
    """Write ``df`` as Parquet partitioned by ``by``; only the partitions that it has rows of are replaced.

    Spark stages all files and moves them on commit, so ``df`` may read the table it is written to. Rows are
    rebalanced by partition: small ones become one file, AQE splits large ones over tasks."""
    df.hint("rebalance", F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing was written yet. Any other failure to read is raised."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def month_of(date_col: str) -> Column:
    return F.date_format(F.col(date_col), "yyyy-MM")


def processed(table: DataFrame | None, rows: DataFrame) -> DataFrame:
    """``rows`` (with file_hash and month) whose file is not in the table's month yet.

    The files of a row stand in the row itself, so data and processed-file guard cannot part: a month
    either has a file's rows and its hash, or neither."""
    if table is None:
        return rows
    done = table.select(MONTH, F.explode(FILES).alias("file_hash")).distinct()
    return rows.join(done, [MONTH, "file_hash"], "left_anti")


def upsert_months(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], date_col: str = "Date",
                  mode: str = "set", run_ts=None, **kw) -> list[str]:
    """K1-K5 on a table partitioned by month; returns the months that were rewritten.

    ``incoming`` has ``keys``, the values and ``files`` (the hashes of the files that each row comes from). Only the
    months it has rows of are read and replaced. A crash between two months is mended by running the batch
    again: ``processed`` leaves out what the finished ones have. The month list is bounded by the calendar."""
    batch = incoming.withColumn(MONTH, month_of(date_col))
    months = sorted(r[0] for r in batch.select(MONTH).distinct().collect())
    if not months:
        return []
    table = read_table(spark, path)
    if table is None:
        table = batch.limit(0)
    old = table.where(F.col(MONTH).isin(months))
    rows = upsert(old.drop(FILES), batch.drop(FILES), [*keys, MONTH], mode, run_ts, **kw)
    both = old.select(*keys, MONTH, FILES).unionByName(batch.select(*keys, MONTH, FILES))
    files = both.groupBy(*keys, MONTH).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(FILES)))).alias(FILES))
    match = functools.reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in [*keys, MONTH]])
    found = rows.alias("r").join(files.alias("f"), match).select("r.*", f"f.{FILES}")
    dynamic_overwrite(found, path, MONTH)
    return months


def append_batch(df: DataFrame, path: str, batch) -> None:
    """Add ``df`` as one batch. Written again under the same name, a batch replaces itself: no row comes twice."""
    dynamic_overwrite(df.withColumn("batch", F.lit(str(batch))), path, "batch")


def write_run(base: str, run, tables: dict[str, DataFrame]) -> None:
    """Write all tables of a run, each partitioned by run, then list the run.

    Readers take the latest listed run, so the tables of a run become visible together or not at all."""
    for name, df in tables.items():
        dynamic_overwrite(df.withColumn("run", F.lit(str(run))), f"{base}/{name}", "run")
    spark = next(iter(tables.values())).sparkSession
    listed = [(str(run), name, df.schema.json()) for name, df in tables.items()]
    dynamic_overwrite(spark.createDataFrame(listed, "run string, name string, columns string").coalesce(1), f"{base}/runs", "run")


def read_run(spark: SparkSession, base: str, name: str, run=None) -> DataFrame | None:
    """A table as the latest listed run (or the given one) wrote it; None where no such run is listed."""
    listed = read_table(spark, f"{base}/runs")
    if listed is None:
        return None
    listed = listed.select(F.col("run").cast("string").alias("run"), "name", "columns").where(F.col("name") == name)
    found = (listed if run is None else listed.where(F.col("run") == str(run))).orderBy(F.desc("run")).first()
    if found is None:
        return None
    columns = T.StructType.fromJson(json.loads(found["columns"]))
    rows = spark.read.schema(T.StructType([*columns.fields, T.StructField("run", T.StringType())])).parquet(f"{base}/{name}")
    return rows.where(F.col("run") == found["run"]).drop("run")


def snapshot_all(tables: dict[str, DataFrame], target: str, snapshot_date: str) -> DataFrame:
    """K8: copy the rows of every table to ``{target}/{table}/snapshot_date=...``, replacing that date's copy only,
    and return the row count per table, counted by Spark from the written copies."""
    counts = []
    for name, df in tables.items():
        path = f"{target.rstrip('/')}/{name}"
        dynamic_overwrite(df.withColumn("snapshot_date", F.lit(snapshot_date)), path, "snapshot_date")
        counts.append(df.sparkSession.read.parquet(f"{path}/snapshot_date={snapshot_date}").agg(
            F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("table_name"), "records"))
    return functools.reduce(lambda a, b: a.unionByName(b), counts)
