import datetime as dt
import glob
import os

import pytest

from stockroom.operators.inventory import NegativeStockError
from stockroom.plans import jobs
from stockroom.sinks import export
from stockroom.sinks import tables
from stockroom.operators import reports

TS = dt.datetime(2026, 4, 9)


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_sales_folder_job_is_idempotent(spark, tmp):
    d = os.path.join(tmp, "in")
    os.makedirs(d)
    write(os.path.join(d, "Daily_sales_09042026.csv"),
          "Date,Brand_Category,Brand,Size_ML,Qty\n09/04/2026,WHISKY,A,750,2\n09/04/2026,WHISKY,A,750,3\n"
          "09/04/2026,RUM,B,abc,1")
    write(os.path.join(d, "bad.csv"), "Date,Brand,Qty\n09/04/2026,A,1\n")
    store = os.path.join(tmp, "store")
    sales = lambda: spark.read.parquet(store + "/daily_sales")
    r = jobs.load_sales_folder(spark, d, store, TS)
    assert {os.path.basename(x["file_path"]): x["status"] for x in r["files"].collect()} == \
        {"Daily_sales_09042026.csv": "ok", "bad.csv": "failed"}
    assert r["bad_rows"].count() == 1
    c = r["counts"].first()
    assert (c["matched_count"], c["upserted_count"]) == (0, 1)
    got = [(x["Brand"], x["Qty"]) for x in sales().collect()]
    assert got == [("A", 5)]
    # the same file again: skipped, table unchanged
    r2 = jobs.load_sales_folder(spark, d, store, TS)
    assert r2["counts"].first()["upserted_count"] == 0
    assert [(x["Brand"], x["Qty"]) for x in sales().collect()] == [("A", 5)]


def test_a_crash_before_the_commit_adds_nothing_twice(spark, tmp, monkeypatch):
    d = os.path.join(tmp, "in")
    os.makedirs(d)
    write(os.path.join(d, "a.csv"), "Date,Brand_Category,Brand,Size_ML,Qty\n09/04/2026,WHISKY,A,750,2\n")
    store = os.path.join(tmp, "store")
    sales = lambda: spark.read.parquet(store + "/daily_sales")
    write(os.path.join(d, "b.csv"), "Date,Brand_Category,Brand,Size_ML,Qty\n09/05/2026,WHISKY,A,750,1\n")
    # the crash comes after April was replaced and before May was
    true = tables.dynamic_overwrite
    monkeypatch.setattr(tables, "dynamic_overwrite", lambda df, path, by: (true(df.where("month = '2026-04'"), path, by), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        jobs.load_sales_folder(spark, d, store, TS, mode="inc")
    assert [(r["month"], r["Qty"]) for r in sales().collect()] == [("2026-04", 2)]
    monkeypatch.setattr(tables, "dynamic_overwrite", true)
    write(os.path.join(d, "c.csv"), "Date,Brand_Category,Brand,Size_ML,Qty\n09/04/2026,WHISKY,A,750,5\n")
    done = [jobs.load_sales_folder(spark, d, store, TS, mode="inc")["months"] for _ in range(2)]
    assert done == [["2026-04", "2026-05"], []]
    assert sorted((r["month"], r["Qty"]) for r in sales().collect()) == [("2026-04", 7), ("2026-05", 1)]


def test_inventory_days_job(spark, tmp):
    init = spark.createDataFrame([("WHISKY", "A", 750, 100)], "Brand_Category string, Brand string, Size_ML int, Qty int")
    d0 = dt.date(2026, 4, 1)
    schema = "Date date, Brand_Category string, Brand string, Size_ML int, Qty int"
    inc = spark.createDataFrame([(d0, "WHISKY", "A", 750, 20)], schema)
    ok = spark.createDataFrame([(d0, "WHISKY", "A", 750, 5)], schema)
    store = os.path.join(tmp, "inv")
    read = lambda name: tables.read_run(spark, store, name)
    jobs.run_inventory_days(store, init, inc, ok, TS, snapshot_dates=[d0 - dt.timedelta(days=1), d0])
    assert sorted((r["Date"], r["Qty"]) for r in read("inventory_snapshots").collect()) == [
        (d0 - dt.timedelta(days=1), 100), (d0, 115)]
    assert read("cleaned_sales").count() == read("cleaned_incoming").count() == 1
    assert read("final_inventory").first()["Qty"] == 115
    too_much = spark.createDataFrame([(d0, "WHISKY", "A", 750, 500)], schema)
    with pytest.raises(NegativeStockError):
        jobs.run_inventory_days(store, init, inc, too_much, TS)
    later = dt.datetime(2026, 4, 10)
    jobs.run_inventory_days(store, init, inc, ok.limit(0), later)
    assert (read("final_inventory").first()["Qty"], read("ignored_sales").count()) == (120, 0)
    assert tables.read_run(spark, store, "final_inventory", TS).first()["Qty"] == 115
    with pytest.raises(NegativeStockError):
        jobs.run_inventory_days(store, init, inc, too_much, dt.datetime(2026, 4, 11))
    assert read("final_inventory").first()["Qty"] == 120  # nothing written by the failed run


def test_exports(spark, tmp):
    df = spark.createDataFrame([(dt.date(2026, 4, 1), "C", "B", 750, 2), (dt.date(2026, 4, 2), "C", "A", 750, 3)],
                               "Date date, Brand_Category string, Brand string, Size_ML int, Qty int")
    priced = df.selectExpr("*", "CAST(Qty * 10 AS DECIMAL(18,2)) AS total")
    export.write_report(reports.sales_summary(priced), os.path.join(tmp, "report"),
                        ["Date", "Brand_Category", "Brand", "Size_ML"])
    lines = []
    for f in sorted(glob.glob(os.path.join(tmp, "report", "part-*.csv"))):
        lines += [x for x in open(f).read().splitlines()[1:] if x]
    kinds = [x.split(",")[-1] for x in lines]
    assert kinds == ["DETAIL", "DETAIL", "SUBTOTAL", "SUBTOTAL", "GRAND_TOTAL"]
    export.write_per_period(df.selectExpr("*", "date_format(Date, 'yyyy-MM') AS YearMonth"),
                            os.path.join(tmp, "monthly"), "YearMonth")
    assert os.path.isdir(os.path.join(tmp, "monthly", "YearMonth=2026-04"))
