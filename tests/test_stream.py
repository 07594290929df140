"""The streaming job survives replays and restarts, and takes keys of several columns and folders of part files."""

import datetime as dt

from pyspark.sql import functions as F

from stockroom.streaming import inventory_stream as stream

SCHEMA = "event_id long, ts timestamp, Brand string, Size_ML int, kind string, qty long"


def events(n, first=0):
    t = dt.datetime(2026, 4, 1)
    return [(first + i, t + dt.timedelta(minutes=first + i), "A" if i % 3 else "B", 750, "receipt" if i % 4 == 0 else "sale", 2 + i % 5)
            for i in range(n)]


def run(spark, src, out, ck):
    q = stream.start(spark, src, src, SCHEMA, ["Brand", "Size_ML"], "qty", out, ck,
                     receipts_filter=F.col("kind") == "receipt", sales_filter=F.col("kind") == "sale")
    q.awaitTermination()


def outcomes(df):
    return sorted((r.event_id, tuple(r.key), r.accepted, r.stock_before, r.stock_after) for r in df.collect())


def test_restart_replay_and_folder_input(spark, tmp):
    src, out, ck = f"{tmp}/in", f"{tmp}/out", f"{tmp}/ck"
    spark.createDataFrame(events(40), SCHEMA).repartition(3).write.parquet(src)
    run(spark, src, out, ck)
    spark.createDataFrame(events(30, 40), SCHEMA).write.mode("append").parquet(src)
    run(spark, src, out, ck)  # a restart goes on where the job stopped
    rows = spark.createDataFrame(events(40) + events(30, 40), SCHEMA)
    want = stream.replay(stream.movement_events(rows.where("kind = 'receipt'"), rows.where("kind = 'sale'"), ["Brand", "Size_ML"], "qty"))
    got = stream.read_events(spark, out)
    assert outcomes(got) == outcomes(want)
    stock = {tuple(r.key): r.Qty for r in stream.read_stock(spark, out).collect()}
    assert stock == {tuple(r.key): r.Qty for r in stream.latest_per_key(want).collect()}
    # a committed epoch that is replayed writes the same rows again
    query = spark.read.parquet(f"{out}/stock_events").select("query").first()[0]
    again = spark.read.parquet(f"{out}/stock_events/query={query}/epoch=0")
    rows = spark.createDataFrame(again.collect(), again.schema)
    stream.write_epoch(rows, 0, out, query)
    assert outcomes(stream.read_events(spark, out)) == outcomes(want)


def test_files_out_of_order_give_the_replay(spark, tmp):
    """One file per trigger; within the delay the order of arrival does not matter, beyond it events are rejects."""
    t0 = dt.datetime(2026, 4, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    row = lambda m, kind, q, brand="A": (m, at(m), brand, None if brand == "C" else 750, kind, q)
    files = [[row(12, "sale", 4), row(5, "sale", 3), row(14, "receipt", 1, "B")], [row(3, "receipt", 5), row(20, "sale", 9), row(15, "sale", 1, "B")],
             [row(1, "receipt", 50), row(18, "receipt", 8), row(40, "sale", 2), row(41, "sale", 0)],
             [row(2, "sale", 1, "B"), row(39, "receipt", 3), row(38, "receipt", 2, "C")]]
    src, ticks, out, ck = (f"{tmp}/{n}" for n in ("in", "ticks", "out", "ck"))
    spark.createDataFrame([], "ts timestamp").write.parquet(ticks)

    def run():
        q = stream.start(spark, src, src, SCHEMA, ["Brand", "Size_ML"], "qty", out, ck, receipts_filter=F.col("kind") == "receipt",
                         sales_filter=F.col("kind") == "sale", delay="15 minutes", ticks_path=ticks, max_files_per_trigger=1)
        q.awaitTermination()

    for rows in files:  # every file is a run of its own: a restart goes on with what still waits
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        run()
    spark.createDataFrame([(at(1000),)], "ts timestamp").write.mode("append").parquet(ticks)
    run()
    got = stream.read_events(spark, out)
    late = {r.event_id for r in got.collect() if r.reason == "late"}
    # after file 2 the watermark is minute 5, after file 3 minute 25
    assert late == {1, 2}
    kept = spark.createDataFrame([r for f in files for r in f if r[0] not in late], SCHEMA)
    want = stream.replay(stream.movement_events(kept.where("kind = 'receipt'"), kept.where("kind = 'sale'"), ["Brand", "Size_ML"], "qty"))
    assert outcomes(got.where("reason is null or reason <> 'late'")) == outcomes(want)
    assert all(r.accepted == (r.reason is None) and (r.accepted or r.stock_before == r.stock_after) for r in got.collect())
    stock = {tuple(r.key): r.Qty for r in stream.read_stock(spark, out).collect()}
    assert stock == {tuple(r.key): r.Qty for r in stream.latest_per_key(want).collect()}
