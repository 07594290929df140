"""Recursive forecasts: dates go on without gaps, values are floored at zero, short series are forecast too."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockroom.operators import forecast, series

D0 = dt.date(2026, 1, 1)


def dense(spark, lengths):
    rows = [(k, D0 + dt.timedelta(days=i), 5 + i % 7) for k, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, "Brand string, Date date, y long")


def test_forecast_of_long_and_short_series(spark):
    df = dense(spark, {"long": 60, "short": 5})
    table = series.feature_table(df, keys=["Brand"])
    model = forecast.train_forest(table, num_trees=5, max_depth=4)
    got = forecast.recursive_forecast(df, model, 4, keys=["Brand"]).collect()
    for brand, n in (("long", 60), ("short", 5)):
        own = sorted((r["step"], r["Forecast_Date"], r["Predicted_Qty"]) for r in got if r["Brand"] == brand)
        assert [(s, d) for s, d, _ in own] == [(i, D0 + dt.timedelta(days=n - 1 + i)) for i in (1, 2, 3, 4)]
        assert all(q >= 0 for _, _, q in own)
    summary = forecast.forecast_summary(forecast.recursive_forecast(df, model, 2, keys=["Brand"]), ["Brand"])
    assert {r["Brand"] for r in summary.collect()} == {"long", "short"}


def test_history_of_a_short_series_starts_with_zeros(spark):
    row = forecast.history_state(dense(spark, {"a": 3}), ["Brand"]).first()
    assert row["hist"] == [0] * 11 + [5, 6, 7] and row["last_date"] == D0 + dt.timedelta(days=2)


def by_hand(hist, day):
    """The features of ``day`` from the values before it, oldest first."""
    h = [0.0] * 14 + [float(x) for x in hist]
    last7, mean = h[-7:], sum(h[-7:]) / 7
    return {"lag_1": h[-1], "lag_2": h[-2], "lag_3": h[-3], "lag_7": h[-7], "rolling_mean_7": mean, "rolling_mean_14": sum(h[-14:]) / 14,
            "rolling_std_7": math.sqrt(sum((x - mean) ** 2 for x in last7) / 6), "day": day.day, "month": day.month, "year": day.year,
            "weekday": day.weekday(), "week": day.isocalendar()[1], "is_weekend": int(day.weekday() >= 5)}


def noisy(spark, names="abcde", days=90):
    r = random.Random(4)
    rows = [(k, D0 + dt.timedelta(days=i), max(0, int(20 + 5 * n + 9 * math.sin(i * 6.28 / 7) + r.gauss(0, 4))))
            for n, k in enumerate(names) for i in range(days - 7 * n)]
    return rows, spark.createDataFrame(rows, "Brand string, Date date, y long")


def test_feature_table_by_hand(spark):
    rows, df = noisy(spark, "ab", 40)
    for r in series.feature_table(df, keys=["Brand"]).collect():
        past = [y for k, d, y in sorted(rows) if k == r["Brand"] and d < r["Date"]]
        want = by_hand(past, r["Date"])
        assert all(abs(float(r[c]) - want[c]) < 1e-9 for c in forecast.FEATURES), r


def test_fold_equals_the_model_step_by_step(spark):
    rows, df = noisy(spark)
    model = forecast.train_forest(series.feature_table(df, keys=["Brand"]), num_trees=20, max_depth=6)
    hist = {k: [y for b, _, y in sorted(rows) if b == k] for k in "abcde"}
    start = {k: len(h) for k, h in hist.items()}
    for _ in range(14):
        x = [(k, *[float(by_hand(h, D0 + dt.timedelta(days=len(h)))[c]) for c in forecast.FEATURES]) for k, h in hist.items()]
        frame = spark.createDataFrame(x, ["Brand", *forecast.FEATURES])
        for r in forecast.predict(model, frame).collect():
            hist[r["Brand"]].append(int(math.floor(max(0.0, r["prediction"]) + 0.5)))
    got = forecast.recursive_forecast(df, model, 14, keys=["Brand"])
    plan = got._jdf.queryExecution().toString()
    assert "Checkpoint" not in plan and plan.count("MapInArrow") <= 4  # one map per printed plan, not one per step
    got = {(r["Brand"], r["step"]): (r["Forecast_Date"], r["Predicted_Qty"]) for r in got.collect()}
    assert got == {(k, i + 1): (D0 + dt.timedelta(days=start[k] + i), hist[k][start[k] + i]) for k in hist for i in range(14)}


def test_every_brand_has_its_own_model(spark):
    rows, df = noisy(spark)
    table = series.feature_table(df, keys=["Brand"]).cache()
    models = {r["Brand"]: (r["n"], r["coef"]) for r in forecast.brand_models(table, ["Brand"]).collect()}
    got = {r["Brand"]: r["Predicted_Qty"] for r in forecast.brand_forecast(df, forecast.brand_models(table, ["Brand"]), 1, ["Brand"]).collect()}
    assert models.keys() == set("abcde")
    for k in "abcde":
        own = [r for r in table.where(F.col("Brand") == k).collect()]
        x = np.array([[1.0, *[float(r[c]) for c in forecast.FEATURES]] for r in own])
        y = np.array([float(r["y"]) for r in own])
        scale = np.sqrt((x * x).mean(axis=0).clip(1e-12))
        z = x / scale
        want = np.linalg.solve(z.T @ z / len(y) + forecast.RIDGE * np.eye(x.shape[1]), z.T @ y / len(y)) / scale
        n, coef = models[k]
        assert n == len(own) and np.allclose(x @ coef, x @ want, atol=1e-4)
        past = [v for b, _, v in sorted(rows) if b == k]
        f = by_hand(past, D0 + dt.timedelta(days=len(past)))
        assert got[k] == math.floor(max(0.0, np.array([1.0, *[f[c] for c in forecast.FEATURES]]) @ np.array(coef)) + 0.5)
    # a model per brand beats the brand's mean on the days it has seen
        assert ((y - x @ coef) ** 2).mean() < ((y - y.mean()) ** 2).mean()


def test_history_and_forecast_in_one_frame(spark):
    from stockroom.operators import sets
    _, df = noisy(spark, "a", 60)
    model = forecast.train_forest(series.feature_table(df, keys=["Brand"]), num_trees=5, max_depth=4)
    hist = df.select("Date", F.col("y").alias("Qty"))
    ahead = forecast.recursive_forecast(df.drop("Brand"), model, 3).select(F.col("Forecast_Date").alias("Date"), F.col("Predicted_Qty").alias("Qty"))
    both = sets.stack_tagged(hist, ahead).collect()
    assert len(both) == 63 and len({r["Date"] for r in both}) == 63


@pytest.mark.parametrize("slope", [0.0, 0.002])
def test_yearly_projection_follows_trend_and_week(spark, slope):
    rows = [(D0 + dt.timedelta(days=i), math.expm1(3 + slope * i + 0.3 * math.sin(2 * math.pi * i / 7))) for i in range(400)]
    got = forecast.yearly_projection(spark.createDataFrame(rows, "Date date, y double"), days=30).orderBy("Date").collect()
    assert [r["Date"] for r in got] == [D0 + dt.timedelta(days=400 + i) for i in range(30)]
    want = [math.expm1(3 + slope * i + 0.3 * math.sin(2 * math.pi * i / 7)) for i in range(400, 430)]
    assert all(abs(r["Predicted_Qty"] - w) < 0.15 * w for r, w in zip(got, want))
