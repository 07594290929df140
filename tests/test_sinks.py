import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from stockroom.operators.clean import merge_duplicates, validate, standardize
from stockroom.sinks import tables
from stockroom.sinks.tables import upsert, upsert_counts

KEYS = ["k"]
TS = dt.datetime(2026, 4, 7)


def rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_upsert_modes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, Qty int")
    new = spark.createDataFrame([("b", 5), ("c", 7)], "k string, Qty int")
    assert rows(upsert(old, new, KEYS, "set", TS), ["k", "Qty"]) == [("a", 1), ("b", 5), ("c", 7)]
    assert rows(upsert(old, new, KEYS, "inc", TS), ["k", "Qty"]) == [("a", 1), ("b", 7), ("c", 7)]
    assert rows(upsert(old, new, KEYS, "insert_only", TS, stamps=False), ["k", "Qty"]) == \
        [("a", 1), ("b", 2), ("c", 7)]
    once = upsert(old, new, KEYS, "set", TS)
    twice = upsert(once, new, KEYS, "set", TS)
    assert rows(once, ["k", "Qty", "created_at", "updated_at"]) == rows(twice, ["k", "Qty", "created_at", "updated_at"])
    c = upsert_counts(old, new, KEYS, ["Qty"]).first()
    assert (c["matched_count"], c["modified_count"], c["upserted_count"]) == (1, 1, 1)


def test_repeated_keys_are_one_row(spark):
    old = spark.createDataFrame([("a", 1)], "k string, Qty int")
    new = spark.createDataFrame([("a", 3), ("a", 4), ("b", 5), ("b", 2)], "k string, Qty int")
    got = {m: rows(upsert(old, new, KEYS, m, stamps=False), ["k", "Qty"]) for m in ("set", "inc", "insert_only")}
    assert got == {"set": [("a", 4), ("b", 5)], "inc": [("a", 8), ("b", 7)], "insert_only": [("a", 1), ("b", 2)]}
    timed = new.withColumn("at", -F.col("Qty"))
    assert rows(upsert(old, timed, KEYS, "set", order_col="at", stamps=False), ["k", "Qty"]) == [("a", 3), ("b", 2)]


def test_a_read_failure_is_not_an_empty_table(spark):
    with pytest.raises(Exception, match="(?i)filesystem|scheme|nosuch"):
        tables.read_table(spark, "nosuch://store/base/t")


def test_null_keys_are_equal(spark):
    old = spark.createDataFrame([(None, 1)], "k string, Qty int")
    new = spark.createDataFrame([(None, 4)], "k string, Qty int")
    assert rows(upsert(old, new, KEYS, "inc", stamps=False), ["k", "Qty"]) == [(None, 5)]


def test_price_shift(spark):
    old = spark.createDataFrame([("a", 10.0, None), ("b", 5.0, 4.0)], "k string, Mrp double, Mrp_OLD double")
    new = spark.createDataFrame([("a", 12.0), ("b", 5.0)], "k string, Mrp double")
    got = rows(upsert(old, new, KEYS, "set_shift", stamps=False), ["k", "Mrp", "Mrp_OLD"])
    assert got == [("a", 12.0, 10.0), ("b", 5.0, 4.0)]


def files_of(path):
    """Data files with their times, by partition folder."""
    out = {}
    for f in glob.glob(f"{path}/*/part-*"):
        out.setdefault(os.path.basename(os.path.dirname(f)), set()).add((os.path.basename(f), os.stat(f).st_mtime_ns))
    return out


DATED = "Date date, k string, Qty long, files array<string>"


def test_a_batch_rewrites_only_its_months(spark, tmp):
    path = tmp + "/t"
    first = [(dt.date(2026, m, d), k, m, ["f1"]) for m in (1, 2, 3) for d in (1, 9) for k in "ab"]
    assert tables.upsert_months(spark, path, spark.createDataFrame(first, DATED), ["Date", "k"], run_ts=TS) == [
        "2026-01", "2026-02", "2026-03"]
    before = files_of(path)
    day = [(dt.date(2026, 2, 9), "a", 50, ["f2"]), (dt.date(2026, 2, 10), None, 7, ["f2"])]
    assert tables.upsert_months(spark, path, spark.createDataFrame(day, DATED), ["Date", "k"], run_ts=TS) == ["2026-02"]
    after = files_of(path)
    assert {m for m in before if before[m] != after[m]} == {"month=2026-02"} and before.keys() == after.keys()
    got = {(r.Date, r.k): (r.Qty, r.files) for r in tables.read_table(spark, path).collect()}
    want = {(d, k): (q, f) for d, k, q, f in first} | {(dt.date(2026, 2, 9), "a"): (50, ["f1", "f2"]), (dt.date(2026, 2, 10), None): (7, ["f2"])}
    assert got == want
    assert tables.upsert_months(spark, path, spark.createDataFrame([], DATED), ["Date", "k"]) == [] and files_of(path) == after


@pytest.mark.parametrize("mode", ["set", "inc", "insert_only"])
def test_months_equal_the_plain_upsert(spark, tmp, mode):
    r, have = random.Random(mode), None
    for batch in range(4):
        rows_ = [(dt.date(2026, r.randint(1, 5), 1 + r.randint(0, 2)), r.choice("abc"), r.randint(0, 9), [f"f{batch}"]) for _ in range(12)]
        new = spark.createDataFrame(rows_, DATED)
        plain = new.drop("files")
        have = upsert(plain.limit(0) if have is None else spark.createDataFrame(have, "Date date, k string, Qty long"), plain, ["Date", "k"],
                      mode, stamps=False)
        have = [tuple(x) for x in have.select("Date", "k", "Qty").collect()]
        tables.upsert_months(spark, tmp + "/t", new, ["Date", "k"], mode=mode, run_ts=TS)
    assert rows(tables.read_table(spark, tmp + "/t"), ["Date", "k", "Qty"]) == sorted(have)


def test_batches_runs_and_snapshots(spark, tmp):
    a, b = (spark.createDataFrame([x], "k string, Qty int") for x in (("a", 1), ("b", 2)))
    for _ in range(2):  # a replayed batch replaces itself
        tables.append_batch(a, tmp + "/log", 0)
    tables.append_batch(b, tmp + "/log", 1)
    log = spark.read.parquet(tmp + "/log")
    assert rows(log, ["k", "Qty"]) == [("a", 1), ("b", 2)]
    assert tables.read_run(spark, tmp + "/runs", "t") is None
    tables.write_run(tmp + "/runs", TS, {"t": a, "u": a})
    # a run that is not listed, as after a crash, is not seen
    tables.dynamic_overwrite(b.withColumn("run", F.lit("2026-04-08 00:00:00")), tmp + "/runs/t", "run")
    assert rows(tables.read_run(spark, tmp + "/runs", "t"), ["k"]) == [("a",)]
    tables.write_run(tmp + "/runs", dt.datetime(2026, 4, 8), {"t": b, "u": b})
    assert [rows(tables.read_run(spark, tmp + "/runs", t), ["k"]) for t in "tu"] == [[("b",)], [("b",)]]
    assert rows(tables.read_run(spark, tmp + "/runs", "t", TS), ["k"]) == [("a",)]
    for day, df in (("2026-04-07", a), ("2026-04-08", log), ("2026-04-08", log)):
        snap = tables.snapshot_all({"t": df.select("k"), "log": log}, tmp + "/backup", day)
    assert rows(snap, ["table_name", "records"]) == [("log", 2), ("t", 2)]
    assert rows(spark.read.parquet(tmp + "/backup/t").groupBy("snapshot_date").count(), ["count"]) == [(1,), (2,)]


def test_validate_and_duplicate_policies(spark):
    raw = spark.createDataFrame([(" 09/04/2026 ", " WHISKY ", "A", "750", "2"),
                                 ("09/04/2026", "WHISKY", "A", "750", "2"),
                                 ("10/04/2026", "", "B", "x", "1.5"),
                                 ("bad", "RUM", "C", "180", "-1")],
                                "Date string, Brand_Category string, Brand string, Size_ML string, Qty string")
    good, bad = validate(standardize(raw), min_qty=0)
    assert good.count() == 2
    reasons = sorted(tuple(sorted(r["reasons"])) for r in bad.collect())
    assert reasons == [("Qty below 0", "bad Date"), ("bad Qty", "bad Size_ML", "blank Brand_Category")]
    keys = ["Date", "Brand_Category", "Brand", "Size_ML"]
    assert rows(merge_duplicates(good, keys, "sum"), ["Qty"]) == [(4,)]
    assert rows(merge_duplicates(good, keys, "exact_then_sum"), ["Qty"]) == [(2,)]
    try:
        validate(standardize(raw), on_invalid="fail")
    except ValueError as e:
        assert e.bad.count() == 2
    else:
        raise AssertionError("expected failure")
