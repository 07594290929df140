"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; all documents are the
unlabelled web text. With the class prior p, the unbiased risk of a score z is

    p mean_P[l(z)] + max(0, mean_U[l(-z)] - p mean_P[l(-z)])

with the logistic loss l, the maximum being the non-negative correction. The
model is linear in ``FEATURES`` of the text and their squares, standardised
over the unlabelled text. Training is Newton's method on sums that Spark takes
over all rows; only these sums (at most a few thousand numbers) reach the
driver. Where the correction binds, the step descends the positive part alone.

The class prior is estimated as the share of quality 1 among the labelled
training rows whose document is in the input, smoothed by one row of each kind. The score is the logistic of
z: the chance of label 1.

Defined cases: a null or empty text has all features zero and is scored like
any other; labels of a null doc_id or quality are ignored, repeated labels of
one document count once (the smaller quality); without positive labels every
score is the prior; rows with a null doc_id are left out; columns ``score`` and
``predicted`` of the input are replaced. Only the text enters a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, save

THRESHOLD = 0.3
ROUNDS = 12
RIDGE = 1e-3

FEATURES = ["log_words", "mean_word", "word_spread", "symbols", "symbol_words", "pipe_words", "punctuation", "digits",
            "capitals", "distinct_words", "top_word", "adjacent_repeats", "repeated_windows", "repeated_lines",
            "line_length", "stop_ends", "short_words", "long_words", "word_entropy", "other_marks"]

_SYMBOLS, _PUNCTUATION, _DIGITS = b"#*$%&|<>", b".,;:!?'\"()-", b"0123456789"
_CAPITALS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"@/\\=_+~^`{}[]"


def features(text: bytes | None) -> list[float]:
    """Shares and logarithms, so that they mean the same for short and long texts."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    low = text.lower().split()
    count = Counter(low)
    windows = Counter(zip(low, low[1:], low[2:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda marks: (len(text) - len(text.translate(None, marks))) / chars
    lengths = [len(w) for w in words]
    mean = chars / n
    return [
        math.log1p(n), math.log(mean), math.sqrt(sum(x * x for x in lengths) / n - mean * mean + 1e-9) / mean,
        share(_SYMBOLS), sum(w[-1] in _SYMBOLS for w in words) / n, count.get(b"|", 0) / n, share(_PUNCTUATION), share(_DIGITS),
        share(_CAPITALS), math.log(len(count)) / math.log(n + 1), max(count.values()) / n,
        sum(map(bytes.__eq__, low, low[1:])) / n, (n - 2 - len(windows)) / n if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), sum(w[-1] in b".!?" for w in words) / n,
        sum(x <= 3 for x in lengths) / n, sum(x > 12 for x in lengths) / n,
        -sum(c / n * math.log(c / n) for c in count.values()) / math.log(n + 1), share(_MARKS)]


def featurize(docs: DataFrame) -> DataFrame:
    """(doc_id, f): one row per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py()) for t in b.column(1).cast(pa.large_binary())]
            yield pa.record_batch([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "f"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, f array<double>")


def design(f: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Intercept, standardised features (cut at six deviations) and their squares."""
    z = np.clip((f - centre) / scale, -6, 6)
    return np.hstack([np.ones((len(f), 1)), z, z * z / 6])


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(FEATURES))


def sums(rows: DataFrame, parts) -> np.ndarray:
    """Elementwise sum over all rows of ``parts(features, is_positive)``, an array of fixed length.

    Each task adds up its rows; Spark adds up the tasks by place in the array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                new = parts(matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False))
                total = new if total is None else total + new
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

    got = rows.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    return np.array([r["x"] for r in got])


def training_labels(labels: DataFrame, train: Column) -> DataFrame:
    return (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(train)
            .groupBy("doc_id").agg(F.min("quality").alias("quality")))


def fit(rows: DataFrame, prior: float, rounds: int = ROUNDS, ridge: float = RIDGE) -> dict | None:
    """``rows``: (f, positive). None where there is no positive."""
    k = len(FEATURES)

    def moments(f, y):
        return np.concatenate([[len(f), y.sum()], f.sum(axis=0), (f * f).sum(axis=0)])

    m = sums(rows, moments)
    if not len(m) or not m[1]:
        return None
    n_u, n_p = m[0], m[1]
    centre = m[2:2 + k] / n_u
    scale = np.sqrt(np.maximum(m[2 + k:] / n_u - centre ** 2, 0)) + 1e-6
    d = 2 * k + 1
    w = np.zeros(d)
    w[0] = math.log(prior / (1 - prior))
    for _ in range(rounds):
        now = w.copy()

        def risk(f, y):
            x = design(f, centre, scale)
            z = x @ now
            s = 1 / (1 + np.exp(-z))
            xp, sp, zp = x[y], s[y], z[y]
            grad_u, hess_u = s @ x, (x * (s * (1 - s))[:, None]).T @ x
            grad_p, hess_p = (1 - sp) @ xp, (xp * (sp * (1 - sp))[:, None]).T @ xp
            return np.concatenate([[np.logaddexp(0, z).sum(), np.logaddexp(0, zp).sum()], xp.sum(axis=0), grad_u, grad_p,
                                   hess_u.ravel(), hess_p.ravel()])

        t = sums(rows, risk)
        mean_x, grad_u, grad_p = t[2:2 + d] / n_p, t[2 + d:2 + 2 * d] / n_u, t[2 + 2 * d:2 + 3 * d] / n_p
        hess_u, hess_p = (h.reshape(d, d) for h in (t[2 + 3 * d:2 + 3 * d + d * d] / n_u, t[2 + 3 * d + d * d:] / n_p))
        if t[0] / n_u - prior * t[1] / n_p >= 0:
            grad, hess = grad_u - prior * mean_x, hess_u
        else:  # the negative part of the risk is below zero: only the positive part counts
            grad, hess = -prior * grad_p, prior * hess_p
        penal = np.full(d, ridge)
        penal[0] = 0
        step = np.linalg.solve(hess + np.diag(penal + 1e-9), grad + penal * w)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return {"w": w, "centre": centre, "scale": scale}


def scorer(model: dict | None, prior: float):
    """A function of record batches whose last column is the features: replaces it by score and predicted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None:
                score = np.full(len(b), prior)
            else:
                z = design(matrix(b.column(b.num_columns - 1)), model["centre"], model["scale"]) @ model["w"]
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.record_batch([*b.columns[:-1], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                                  names=[*b.schema.names[:-1], "score", "predicted"])

    return run


def learn(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> tuple[DataFrame, dict | None, float]:
    """The features of ``docs``, saved, and the model and class prior learnt from the labels that ``train`` (a condition
    on doc_id) admits; by default those whose crc32 of the id is not a multiple of five."""
    train = fold(F.col("doc_id")) != 0 if train is None else train
    made = save(featurize(docs))
    # labels of documents that are not in ``docs`` say nothing of the share in it
    known = save(training_labels(labels, train).join(made.select("doc_id"), "doc_id", "left_semi"))
    n = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good")).first()
    prior = (n["good"] + 1) / (n["n"] + 2)
    good = known.where("quality = 1").select("doc_id", F.lit(True).alias("positive"))
    rows = save(made.join(good, "doc_id", "left").select("f", F.coalesce("positive", F.lit(False)).alias("positive")))
    return made, fit(rows, prior), prior


def classify(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``, learnt as in ``learn``."""
    made, model, prior = learn(docs, labels, train)
    return made.mapInArrow(scorer(model, prior), "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with all their columns.

    Rows are scored again as they are read, so no text is shuffled or saved to meet its score."""
    _, model, prior = learn(docs, labels, train)
    rows, score = docs.where("doc_id is not null"), scorer(model, prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.large_string()).cast(pa.large_binary())
            f = pa.array([features(t.as_py()) for t in texts], pa.list_(pa.float64()))
            for scored in score(iter([pa.record_batch([f], names=["f"])])):
                yield b.filter(pa.compute.equal(scored.column(1), 1))

    at = rows.columns.index("text")
    return rows.mapInArrow(run, rows.schema)
