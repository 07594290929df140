"""Sales forecasting (Z8, Z10, Z11, Z12, Z13) with ``pyspark.ml``.

Models are trained on the feature table from ``series`` (one row per
series and day; its size is bounded by days x series, never by raw sales
rows). The recursive forecast runs **all series at once** in one job: the state is one
row per series holding its last 14 values in an array, and the horizon is a
fold over Arrow batches of such rows. The fitted trees are flat arrays there,
walked for all series and trees together. Models per brand (Z12) are
linear, from normal equations that one aggregation sums up for every brand.

Numbers differ from the reference's scikit-learn forests (different
implementation and randomness); shapes, features and policies are the same.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import calendar_parts
from ..session import scratch_path

FEATURES = ["lag_1", "lag_2", "lag_3", "lag_7", "rolling_mean_7", "rolling_mean_14", "rolling_std_7",
            "day", "month", "year", "weekday", "week", "is_weekend"]
HISTORY = 14

# Fixed model settings of the reference's forests: the notebook model
# (300 trees, depth 12, min leaf 2) and the forecaster service's model
# (200 trees, depth 10).
# depth on one brand each. The pooled model over all brands uses the service's
# settings: Spark keeps a forest's nodes on the driver, and without a depth
# limit they grow with trees x rows (see README, deviations).
FOREST = {"num_trees": 300, "max_depth": 12, "min_instances": 2}
SERVICE_FOREST = {"num_trees": 200, "max_depth": 10, "min_instances": 1}


def train_forest(table: DataFrame, label: str = "y", features: list[str] | None = None, num_trees: int = 300,
                 max_depth: int = 12, min_instances: int = 2, seed: int = 42) -> PipelineModel:
    """Random-forest regressor on the feature columns (Spark ML has no
    min-samples-split knob; ``minInstancesPerNode`` is the min-leaf one).
    Callers hand the fitted model on; nothing is remembered between calls."""
    feats = features or FEATURES
    # More node statistics per pass and cached node ids: fewer passes over
    # the data for deep trees (the model itself is unchanged).
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=num_trees,
                               maxDepth=min(max_depth, 30), minInstancesPerNode=min_instances, seed=seed,
                               maxMemoryInMB=2048, cacheNodeIds=True, checkpointInterval=10)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep"), rf])
    return pipe.fit(table.select(*feats, F.col(label).cast("double").alias(label)))


def predict(model: PipelineModel, df: DataFrame, name: str = "prediction") -> DataFrame:
    out = model.transform(df).drop("features")
    return out.withColumnRenamed("prediction", name) if name != "prediction" else out


def history_state(series: DataFrame, keys: list[str] | None = None, date_col: str = "Date",
                  name: str = "y") -> DataFrame:
    """One row per series: keys, last date, last 14 values (oldest first).
    Only the last 14 days of each series are gathered. Days before a series
    began count as zero, as days without sales do in a dense series."""
    keys = keys or []
    last = series.groupBy(*keys).agg(F.max(date_col).alias("_last"))
    tail = (series.join(last, keys) if keys else series.withColumn("_last", series.select(F.max(date_col))
                                                                    .scalar()))
    tail = tail.filter(F.col(date_col) > F.date_sub("_last", HISTORY))
    grp = tail.groupBy(*keys, "_last") if keys else tail.groupBy("_last")
    got = F.transform(F.array_sort(F.collect_list(F.struct(date_col, name))), lambda s: s[name])
    zero = F.lit(0).cast(series.schema[name].dataType)
    return grp.agg(got.alias("hist")).withColumn(
        "hist", F.concat(F.array_repeat(zero, HISTORY - F.size("hist")), "hist")).withColumnRenamed("_last", "last_date")


class Trees:
    """A fitted forest as flat arrays (feature, threshold, left, right, value), one row per tree.

    Read from the files Spark ML saves a model to. The forest's settings bound its size, and it lives on the
    driver already, so it may travel with the tasks."""

    def __init__(self, model: PipelineModel):
        spark = SparkSession.getActiveSession()
        path = scratch_path(spark, f"forest-{uuid.uuid4().hex}")
        model.stages[-1].write().save(path)
        nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
            "treeID", "id", "leftChild", "rightChild", "prediction", F.col("split.featureIndex").alias("feature"),
            F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("split.numCategories").alias("kinds"))
        rows = nodes.orderBy("treeID", "id").toPandas()
        if (rows["kinds"] > 0).any():
            raise ValueError("only numeric features are known")
        trees, most = rows["treeID"].max() + 1, rows["id"].max() + 1
        place = rows["treeID"].to_numpy(), rows["id"].to_numpy()
        leaf = rows["leftChild"].to_numpy() < 0
        self.feature, self.left, self.right = (np.zeros((trees, most), np.int32) for _ in range(3))
        self.threshold, self.value = np.full((trees, most), np.inf), np.zeros((trees, most))
        self.feature[place] = np.where(leaf, 0, rows["feature"])
        # a leaf leads to itself, so every walk may take as many steps as the deepest one
        self.left[place] = np.where(leaf, rows["id"], rows["leftChild"])
        self.right[place] = np.where(leaf, rows["id"], rows["rightChild"])
        self.threshold[place] = np.where(leaf, np.inf, rows["threshold"].fillna(np.inf))
        self.value[place] = rows["prediction"]
        self.depth = model.stages[-1].getMaxDepth()

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean over the trees for each row of features, added in the order of the trees."""
        out = np.zeros(len(x))
        for at in range(0, len(x), 4096):
            some = x[at:at + 4096]
            row, tree = np.arange(len(some))[:, None], np.arange(len(self.value))[None]
            node = np.zeros((len(some), len(self.value)), np.int32)
            for _ in range(self.depth):
                low = some[row, self.feature[tree, node]] <= self.threshold[tree, node]
                node = np.where(low, self.left[tree, node], self.right[tree, node])
            out[at:at + 4096] = np.add.accumulate(self.value[tree, node], axis=1)[:, -1] / len(self.value)
        return out


def _history_features(hist: np.ndarray, calendar: np.ndarray) -> np.ndarray:
    """``FEATURES`` of the next day for many series at once: the last 14 values of each, and the day's calendar parts."""
    last7 = hist[:, -7:]
    s7, s14 = (np.add.accumulate(h, axis=1)[:, -1] for h in (last7, hist))
    sq = np.add.accumulate(last7 * last7, axis=1)[:, -1]
    std = np.sqrt(np.maximum(0.0, (7.0 * sq - s7 * s7) / 42.0))
    return np.column_stack([hist[:, -1], hist[:, -2], hist[:, -3], hist[:, -7], s7 / 7.0, s14 / 14.0, std, calendar])


def _stepwise(series: DataFrame, predict, horizon: int, keys: list[str], date_col: str, name: str, extra: list[str] = ()) -> DataFrame:
    """The forecast as a fold over the horizon inside one map over the series' histories: one plan, however many steps.

    ``predict(features, extra columns)`` gives the next value of every series of a batch."""
    state = history_state(series, keys, date_col, name)
    return _fold(state, predict, horizon, keys, extra)


def _fold(state: DataFrame, predict, horizon: int, keys: list[str], extra: list[str] = ()) -> DataFrame:
    days = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.date_add("last_date", i))
    parts = lambda d: F.array(*[c.cast("double") for c in calendar_parts(d).values()])
    given = state.select(*keys, "last_date", F.transform("hist", lambda x: x.cast("double")).alias("hist"),
                         F.transform(days, parts).alias("calendar"), *extra)
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hist = b.column(at + 1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), HISTORY)
            calendar = b.column(at + 2).flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(b), horizon, -1)
            values = []
            for step in range(horizon):
                y = predict(_history_features(hist, calendar[:, step]), b.columns[at + 3:])
                # half away from zero, as Spark rounds
                y = np.floor(np.maximum(0.0, y) + 0.5)
                values.append(y)
                hist = np.column_stack([hist[:, 1:], y])
            flat = np.column_stack(values).astype(np.int64).ravel() if len(b) else np.empty(0, np.int64)
            ends = np.arange(len(b) + 1, dtype=np.int32) * horizon
            yield pa.record_batch([*b.columns[:at + 1], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                  names=[*b.schema.names[:at + 1], "values"])

    schema = given.select(*keys, "last_date", F.array(F.lit(0).cast("long")).alias("values")).schema
    steps = given.mapInArrow(run, schema).select(*keys, "last_date", F.posexplode("values").alias("i", "Predicted_Qty"))
    return steps.select(*keys, F.date_add("last_date", F.col("i") + 1).alias("Forecast_Date"), "Predicted_Qty",
                        (F.col("i") + 1).alias("step"))


def recursive_forecast(series: DataFrame, model: PipelineModel, horizon: int = 14, keys: list[str] | None = None,
                       date_col: str = "Date", name: str = "y") -> DataFrame:
    """Predict the next day, append it to the history, repeat.
    Predictions are floored at 0 and rounded. Output: keys, Forecast_Date,
    Predicted_Qty, step."""
    trees = Trees(model)
    return _stepwise(series, lambda x, _: trees.predict(x), horizon, keys or [], date_col, name)


RIDGE = 1e-6


def brand_models(table: DataFrame, keys: list[str], label: str = "y", features: list[str] | None = None,
                 ridge: float = RIDGE) -> DataFrame:
    """One linear model per key: (keys, n, coef), the coefficients of an intercept and ``features``.

    Every key's normal equations come from one partial aggregation over the feature rows (sums of products), so a key's
    rows never meet in a task; the equations are then solved row by row. Columns are scaled by their root mean square and
    ``ridge`` is added to the diagonal, which settles features that are constant or depend on each other."""
    feats = features or FEATURES
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in feats]]
    y = F.col(label).cast("double")
    d = len(x)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(x[i] * x[j]) for i, j in pairs] + [F.sum(v * y) for v in x]
    # rows without all features do not count
    full = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*feats, label]])
    gram = table.where(full).groupBy(*keys).agg(F.count("*").alias("n"), F.array(*sums).alias("sums"))
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(at + 1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            g = np.zeros((len(b), d, d))
            for k, (i, j) in enumerate(pairs):
                g[:, i, j] = g[:, j, i] = flat[:, k]
            n = b.column(at).to_numpy(zero_copy_only=False)[:, None]
            scale = np.sqrt(np.maximum(np.einsum("kii->ki", g) / n, 1e-12))
            a = g / (n[:, :, None] * scale[:, :, None] * scale[:, None]) + ridge * np.eye(d)
            c = np.linalg.solve(a, (flat[:, len(pairs):] / (n * scale))[:, :, None])[:, :, 0] / scale
            ends = np.arange(len(b) + 1, dtype=np.int32) * d
            yield pa.record_batch([*b.columns[:at + 1], pa.ListArray.from_arrays(pa.array(ends), pa.array(c.ravel()))],
                                  names=[*b.schema.names[:at + 1], "coef"])

    return gram.mapInArrow(run, gram.select(*keys, "n", F.col("sums").alias("coef")).schema)


def brand_forecast(series: DataFrame, models: DataFrame, horizon: int, keys: list[str], date_col: str = "Date",
                   name: str = "y") -> DataFrame:
    """The recursive forecast of every key from its own model, all keys in one job."""
    state = history_state(series, keys, date_col, name).join(models.select(*keys, "coef"), keys)

    def predict(x: np.ndarray, extra: list[pa.Array]) -> np.ndarray:
        coef = extra[0].flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        return coef[:, 0] + (coef[:, 1:] * x).sum(axis=1)

    return _fold(state, predict, horizon, keys, ["coef"])


def forecast_summary(forecast: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Total and average predicted quantity (per key)."""
    keys = keys or []
    aggs = [F.sum("Predicted_Qty").alias("total_predicted"), F.avg("Predicted_Qty").alias("avg_predicted"),
            F.min("Forecast_Date").alias("first_date"), F.max("Forecast_Date").alias("last_date")]
    return forecast.groupBy(*keys).agg(*aggs) if keys else forecast.agg(*aggs)


def eligible_series(raw: DataFrame, table: DataFrame, key: str, date_col: str = "Date", min_days: int = 30,
                    min_rows: int = 20) -> DataFrame:
    """Keys with >= ``min_days`` distinct sale days and >= ``min_rows``
    complete feature rows."""
    days = raw.groupBy(key).agg(F.countDistinct(date_col).alias("sale_days"))
    rows = table.groupBy(key).agg(F.count(F.lit(1)).alias("feature_rows"))
    return (days.join(rows, key).filter((F.col("sale_days") >= min_days) & (F.col("feature_rows") >= min_rows)))


def yearly_projection(series: DataFrame, days: int = 365, date_col: str = "Date", name: str = "y",
                      weekly_terms: int = 3, yearly_terms: int = 6) -> DataFrame:
    """Trend + weekly + yearly seasonality, multiplicative: a linear
    model on ``log1p(y)`` with Fourier terms, projected ``days`` ahead from
    the last date (negative projections floored at 0)."""
    start = series.select(F.min(date_col)).scalar()

    def design(df: DataFrame) -> DataFrame:
        t = F.datediff(F.col(date_col), start).cast("double")
        cols = {"t": t}
        for k in range(1, weekly_terms + 1):
            cols[f"ws{k}"] = F.sin(2 * math.pi * k * t / 7.0)
            cols[f"wc{k}"] = F.cos(2 * math.pi * k * t / 7.0)
        for k in range(1, yearly_terms + 1):
            cols[f"ys{k}"] = F.sin(2 * math.pi * k * t / 365.25)
            cols[f"yc{k}"] = F.cos(2 * math.pi * k * t / 365.25)
        return df.select("*", *[c.alias(n) for n, c in cols.items()])

    feats = ["t"] + [f"{a}{k}" for k in range(1, weekly_terms + 1) for a in ("ws", "wc")] + \
        [f"{a}{k}" for k in range(1, yearly_terms + 1) for a in ("ys", "yc")]
    train = design(series.withColumn("_ly", F.log1p(F.greatest(F.col(name).cast("double"), F.lit(0.0)))))
    model = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features"),
                             LinearRegression(featuresCol="features", labelCol="_ly", regParam=0.01)]).fit(train)
    last = series.select(F.max(date_col)).scalar()
    future = series.sparkSession.range(1, days + 1).select(F.date_add(last, F.col("id").cast("int")).alias(date_col))
    pred = model.transform(design(future))
    return pred.select(date_col, F.greatest(F.lit(0.0), F.expm1("prediction")).alias("Predicted_Qty"))
