"""Toxicity: the lexicon by brute force, the label model on votes drawn from a known one, held-out labels."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockroom.llm import toxicity
from stockroom.llm.common import fold, table

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def brute_entries(rows):
    out = {}
    for text, toxic in rows:
        words = toxicity._WORD.findall(text.lower())
        seen = {}
        for word in dict.fromkeys(words):
            before = ["", *words][words.index(word)]
            for e in toxicity.entries(word):
                seen.setdefault(e, set()).add(before)
        for e, before in seen.items():
            own = out.setdefault(e, [0, 0])
            own[not toxic] += 1
    return {e: tuple(n) for e, n in out.items()}


def test_entries_are_counted_by_document(spark, monkeypatch):
    r = random.Random(1)
    words = ["vequir", "vequai", "lowen", "a", "Straße", "straßen", "x1y", "ÉTÉ"]
    rows = [(" ".join(r.choice(words) for _ in range(r.randint(0, 9))), r.random() < 0.4) for _ in range(200)]
    got = toxicity.count_entries(spark.createDataFrame(rows, "text string, toxic boolean").repartition(5)).collect()
    assert {x.entry: (x.toxic, x.clean) for x in got} == brute_entries(rows)


def test_copies_do_not_make_an_entry(spark):
    copies = [("some cluster of copied words zork", True)] * 50
    met = [(f"{w} grumble {w}", True) for w in ("one", "two", "three", "four", "five", "six", "seven", "eight")] * 3
    clean = [(f"plain {w} words", False) for w in ("one", "two", "three", "four", "five", "six", "seven", "eight")] * 20
    got = toxicity.learn_lexicon(spark.createDataFrame(copies + met + clean, "text string, toxic boolean"))
    assert set(got) == {"grum"}
    words = {zlib.crc32(w.encode()) & 63 for w in ("one", "two", "three", "four", "five", "six", "seven", "eight")}
    assert len(words) >= toxicity.CONTEXTS


def drawn(n, seed):
    """Votes of five voters, the third a copy of the second with noise, and the hidden labels."""
    r = np.random.default_rng(seed)
    y = r.random(n) < 0.2
    rate = np.array([[0.05, 0.9], [0.1, 0.7], [0, 0], [0.02, 0.5], [0.3, 0.35]])
    x = r.random((n, 5)) < rate[:, y.astype(int)].T
    x[:, 2] = np.where(r.random(n) < 0.95, x[:, 1], r.random(n) < 0.5)
    return x, y


@pytest.mark.parametrize("share", [0.02, 0.3])
def test_label_model_finds_accuracies_and_correlations(share):
    x, y = drawn(60_000, 1)
    known = np.random.default_rng(2).random(len(y)) < share
    codes = x @ (1 << np.arange(5))
    patterns = np.unique(codes)
    count = [np.array([(m & (codes == p)).sum() for p in patterns]) for m in (~known, known & ~y, known & y)]
    model = toxicity.LabelModel(patterns, *count, voters=5)
    for label in (0, 1):
        assert np.abs(model.accuracy[label] - x[y == bool(label)].mean(axis=0)).max() < 0.03
    assert model.parent[2] == 1 or model.parent[1] == 2
    q = model.posterior(model.x)
    off = [abs(own - y[codes == p].mean()) for p, own in zip(patterns, q)]
    assert np.average(off, weights=sum(count)) < 0.03  # 2 % of labels leave rare patterns uncertain
    assert abs((q * sum(count)).sum() / len(y) - 0.2) < 0.02


def test_posterior_is_bayes_over_the_tree():
    x, y = drawn(5000, 3)
    codes = x @ (1 << np.arange(5))
    patterns = np.arange(32)
    count = [np.array([(m & (codes == p)).sum() for p in patterns]) for m in (np.zeros(len(y), bool), ~y, y)]
    model = toxicity.LabelModel(patterns, *count, voters=5, rounds=1)
    total = sum(np.exp(np.log(p) + model.first[k][model.x[:, 0].astype(int)] + sum(
        model.tables[k][model.x[:, model.parent[i]].astype(int), model.x[:, i].astype(int), i] for i in model.order[1:])).sum()
        for k, p in ((0, 1 - model.prior), (1, model.prior)))
    assert abs(total - 1) < 1e-9  # a distribution over all votes and labels
    assert sorted(model.order) == [0, 1, 2, 3, 4] and (model.parent[model.order[1:]] >= 0).all()


def test_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = toxicity.classify(docs, labels, fold(F.col("doc_id")) != 0).join(labels, "doc_id").where(fold(F.col("doc_id")) == 0).collect()
    hit = [r.predicted == r.toxic for r in got]
    assert len(got) > 60 and sum(hit) / len(hit) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    toxic = [r.predicted for r in got if r.toxic]
    assert sum(toxic) / len(toxic) > 0.6


def test_labels_of_the_fold_are_not_learnt(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = fold(F.col("doc_id")) == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [dict(toxicity.classify(docs, x, ~held).select("doc_id", "score").collect()) for x in (labels, turned)]
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-6 for i in scores[0])


def test_odd_rows_and_columns(spark, odd):
    none = spark.createDataFrame([(None, 1), (1, None), (4, 0), (4, 1)], "doc_id long, toxic int")
    extra = odd.withColumn("score", F.lit("mine")).withColumn("votes", F.lit(1)).withColumn("toxic", F.lit("x"))
    got = toxicity.classify(extra, none).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in ODD if i is not None)
    assert all(0 <= r.score <= 1 for r in got) and got[0].asDict().keys() == {"doc_id", "score", "predicted"}
    assert toxicity.classify(odd.limit(0), none).count() == 0
    bad = spark.createDataFrame([(20, "You are a stupid idiot, you pathetic clown"), (21, "A quiet day by the sea")], "doc_id long, text string")
    found = {r.doc_id: r.predicted for r in toxicity.classify(odd.select("doc_id", "text").unionByName(bad), none.limit(0)).collect()}
    assert found[20] == 1 and found[21] == 0
