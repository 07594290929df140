"""Registered model and streaming queries.

Model outputs depend on the learner's randomness,
not on SQL, so forecasts are checked by tests (dates, floors, short series).
Z12's eligibility rule and the event replay (a recursive query) have SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast, series, sets
from ..streaming import inventory_stream as stream
from .registry import register, with_ctes

HORIZON = 14


def _total(d):
    return series.daily_series(d.daily_sales(), "Qty")


def _model(d, table=None):
    t = table if table is not None else series.feature_table(_total(d))
    train = series.time_split(t).filter(F.col("split") == "train")
    return forecast.train_forest(train, **forecast.FOREST)


@register("z08_forest_test_predictions")
def z08(d):
    """Random forest (300 trees, depth 12, min leaf 2) trained on the
    first 80 % of days, predictions for the last 20 %."""
    t = series.time_split(series.feature_table(_total(d)))
    model = forecast.train_forest(t.filter(F.col("split") == "train"), **forecast.FOREST)
    return forecast.predict(model, t.filter(F.col("split") == "test")).select("Date", "y", "prediction")


@register("z08_service_forest_predictions")
def z08s(d):
    """The forecaster service's forest (200 trees, depth 10)."""
    t = series.time_split(series.feature_table(_total(d)))
    model = forecast.train_forest(t.filter(F.col("split") == "train"), **forecast.SERVICE_FOREST)
    return forecast.predict(model, t.filter(F.col("split") == "test")).select("Date", "y", "prediction")


@register("z10_recursive_forecast")
def z10(d):
    """14-day recursive forecast of total daily quantity."""
    return forecast.recursive_forecast(_total(d), _model(d), HORIZON)


def _amount(d):
    from ..operators.pricing import price_sales
    priced = price_sales(d.daily_sales(), d.price_list())
    return series.daily_series(priced.withColumn("total", F.col("total").cast("double")), "total")


@register("z10_quantity_and_amount")
def z10a(d):
    """The forecast of both targets, quantity and sales amount, each
    from its own forest on its own daily series."""
    amount = _amount(d)
    train = series.time_split(series.feature_table(amount)).filter(F.col("split") == "train")
    money = forecast.recursive_forecast(amount, forecast.train_forest(train, **forecast.FOREST), HORIZON).select(
        "Forecast_Date", F.col("Predicted_Qty").alias("Predicted_Amount"))
    qty = forecast.recursive_forecast(_total(d), _model(d), HORIZON).select("Forecast_Date", "Predicted_Qty")
    return qty.join(money, "Forecast_Date")


@register("z11_forecast_summary")
def z11(d):
    """Total and average of the 14-day forecast."""
    return forecast.forecast_summary(forecast.recursive_forecast(_total(d), _model(d), HORIZON))


def _brand_tables(d):
    s = series.daily_series(d.daily_sales(), "Qty", keys=["Brand"])
    return s, series.feature_table(s, keys=["Brand"])


@register("z12_eligible_brands", with_ctes("""
SELECT Brand, sale_days, feature_rows FROM (
  SELECT Brand, COUNT(DISTINCT Date) AS sale_days,
         GREATEST(DATE_DIFF('day', MIN(Date), MAX(Date)) + 1 - 14, 0) AS feature_rows
  FROM daily_sales GROUP BY Brand) t
WHERE sale_days >= 30 AND feature_rows >= 20""", "daily_sales"))
def z12e(d):
    """Brands with >= 30 sale days and >= 20 complete feature rows."""
    _, table = _brand_tables(d)
    return forecast.eligible_series(d.daily_sales(), table, "Brand")


@register("z12_brand_next_day")
def z12(d):
    """Next-day forecast per eligible brand, each from a model of its own, all in one job
    (the reference trained one model per brand in a driver loop)."""
    s, table = _brand_tables(d)
    ok = forecast.eligible_series(d.daily_sales(), table, "Brand").select("Brand")
    table = table.join(ok, "Brand", "left_semi")
    models = forecast.brand_models(table, ["Brand"])
    return forecast.brand_forecast(s.join(ok, "Brand", "left_semi"), models, 1, ["Brand"]).drop("step")


@register("z13_yearly_projection")
def z13(d):
    """365-day projection with trend and weekly / yearly seasonality."""
    return forecast.yearly_projection(_total(d))


@register("u04_history_and_forecast")
def u04(d):
    """U4: the daily history and the 14-day forecast in one frame."""
    hist = _total(d).select("Date", F.col("y").alias("Qty"))
    fc = forecast.recursive_forecast(_total(d), _model(d), HORIZON).select(
        F.col("Forecast_Date").alias("Date"), F.col("Predicted_Qty").alias("Qty"))
    return sets.stack_tagged(hist, fc)


def _events(d):
    ev = d.table("events").withColumn("q", F.floor("value").cast("long"))
    return stream.movement_events(ev.filter(F.col("event_type") == "signup"),
                                  ev.filter(F.col("event_type") == "purchase"), "user_id", "q")


# One step of the recursion applies the n-th event of every key at once.
_REPLAY = """
WITH RECURSIVE ev AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY ts, k, event_id) AS n FROM (
    SELECT user_id AS key, event_id, ts, CASE WHEN event_type = 'signup' THEN 'receipt' ELSE 'sale' END AS kind,
           CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END AS k, CAST(FLOOR(value) AS BIGINT) AS qty
    FROM events WHERE event_type IN ('signup', 'purchase')) u WHERE qty > 0),
run AS (
  SELECT key, event_id, ts, kind, qty, n, kind = 'receipt' AS accepted, CAST(0 AS BIGINT) AS stock_before,
         CASE WHEN kind = 'receipt' THEN qty ELSE 0 END AS stock_after
  FROM ev WHERE n = 1
  UNION ALL
  SELECT e.key, e.event_id, e.ts, e.kind, e.qty, e.n, e.kind = 'receipt' OR r.stock_after >= e.qty, r.stock_after,
         CASE WHEN e.kind = 'receipt' THEN r.stock_after + e.qty
              WHEN r.stock_after >= e.qty THEN r.stock_after - e.qty ELSE r.stock_after END
  FROM run r JOIN ev e ON e.key = r.key AND e.n = r.n + 1)
"""
_OUTCOMES = _REPLAY + "SELECT key, event_id, STRFTIME(ts, '%Y-%m-%d %H:%M:%S') AS ts, kind, qty, accepted, stock_before, stock_after FROM run"


@register("r01_realtime_inventory", _OUTCOMES)
def r01(d):
    """R1 + R2 + R3: the streaming job run to completion over the events
    (signups receive stock, purchases sell it); every event's outcome."""
    return stream.run_on_events(d.spark, d.sf_dir)


@register("r01_event_time_order", _OUTCOMES.replace("stock_after FROM run", """stock_after,
       CASE WHEN NOT accepted THEN 'insufficient stock' END AS reason FROM run"""))
def r01t(d):
    """R1 in event-time order across micro-batches, run to completion: nothing is late, as one run reads all files."""
    return stream.run_on_events(d.spark, d.sf_dir, "10 minutes")


@register("r01_batch_replay", _OUTCOMES)
def r01b(d):
    """R1 replayed as a batch job in the same order (the stream's check)."""
    return stream.replay(_events(d))


@register("r03_stock_levels", _REPLAY + "SELECT key, MAX_BY(stock_after, n) AS Qty FROM run GROUP BY key")
def r03(d):
    """Final stock per key (last event outcome per key)."""
    return stream.latest_per_key(stream.replay(_events(d)))
