"""Exact top-k search by MaxScore over integer vectors.

A vector's components are its terms: component x counts floor(256 x), and a
term's posting list holds the vectors with their values. The score is the
inner product of integers. Queries go in blocks and vectors in shards, both of
bounded size, and each block meets each shard in one task. There, for each
query:

- a term's bound is the largest share it can add to a score in this shard;
- terms in order of falling bound are split where the rest cannot lift a
  score to the query's current k-th best: those before are essential, and
  their postings are traversed for all vectors;
- the other terms are probed in the same order only for vectors whose partial
  score plus the bounds of the terms left still reaches the k-th best.

The k-th best starts from scores of a few vectors that are scored in full.
Ties count for the smaller id throughout, so nothing that could be returned is
pruned. Shard results of at most k rows per query are merged by one window.

Defined cases: vectors that are null, or hold a null or a non-finite
component, take no part; missing components of a shorter vector are zero; a
vec_id that comes more than once counts once, with its smallest vector; a null
vec_id takes no part; with fewer than k other vectors all are returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save

SHARD = 16384  # vectors in a shard, about
BLOCK = 8192  # queries in a block, about
SEEDS = 64
PROBE = 8  # terms probed between two prunings


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v an array of long, one row per vec_id."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.col("embedding").isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & whole).select(
        F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e * 256)).alias("v")).groupBy("vec_id").agg(
        F.min("v").alias("v"))


def to_matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def max_score(query: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, own: int,
              k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows for one query; ``postings`` holds one row of values per term.

    The values are of a type in which every partial sum is exact."""
    bound = np.maximum(query * low, query * high)
    order = np.argsort(-bound, kind="stable")
    order = order[query[order] != 0]
    # what the terms from a place on can add at most; a term can also lower a score, and its bound says so
    rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
    sample = np.arange(min(SEEDS, len(ids)))
    seeds = query @ postings[:, sample]
    seeds = seeds[ids[sample] != own]
    threshold = np.partition(seeds, len(seeds) - k)[len(seeds) - k] if len(seeds) >= k else None
    if threshold is None:
        split = len(order)
    else:
        split = int(np.searchsorted(-rest, -threshold, side="right"))  # the first place from which the rest stays below it
        split = min(max(split, len(order) // 4), len(order))
    essential = order[:split]
    partial = query[essential] @ postings[essential]
    alive = np.flatnonzero(ids != own)
    partial = partial[alive]
    at = split
    while True:
        # Vectors that others beat for certain go. The k-th best of the lower bounds is no help for
        # terms of either sign, so the seeds' scores and, at the end, the full scores decide.
        if threshold is not None:
            keep = partial + rest[at] >= threshold
            alive, partial = alive[keep], partial[keep]
        if at == len(order):
            break
        probe = order[at:at + PROBE]
        partial = partial + query[probe] @ postings[np.ix_(probe, alive)]
        at += len(probe)
    best = np.lexsort((ids[alive], -partial))[:k]
    return ids[alive[best]], partial[best]


def search_tile(queries: pd.DataFrame, shard: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(queries) or not len(shard):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    width = max(queries["v"].map(len).max(), shard["v"].map(len).max(), 1)
    q, v = to_matrix(queries["v"], width), to_matrix(shard["v"], width)
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * width < 2 ** 52
    kind = np.float64 if exact else np.int64
    postings, q = np.ascontiguousarray(v.T.astype(kind)), q.astype(kind)
    low, high, ids = postings.min(axis=1), postings.max(axis=1), shard["vec_id"].to_numpy()
    own, got, score = [], [], []
    for query_id, row in zip(queries["vec_id"].to_numpy(), q):
        a, b = max_score(row, postings, low, high, ids, query_id, k)
        own.append(np.full(len(a), query_id))
        got.append(a)
        score.append(b)
    return pd.DataFrame({"query_id": np.concatenate(own), "vec_id": np.concatenate(got),
                         "score": np.concatenate(score).astype(np.int64)})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) that meets ``is_query``,
    the k best of all other rows."""
    rows = save(usable(vectors))
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_queries // BLOCK))
    spread = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = rows.where(is_query).select("vec_id", "v", spread(1, blocks).alias("block"), every(shards).alias("shard"))
    parts = rows.select("vec_id", "v", spread(2, shards).alias("shard"), every(blocks).alias("block"))

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search_tile(left, right, k)

    found = queries.groupBy("block", "shard").cogroup(parts.groupBy("block", "shard")).applyInPandas(
        tile, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
