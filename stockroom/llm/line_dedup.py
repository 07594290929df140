"""Line dedup: drop lines that many documents share (DataFrame functions only).

Lines are exploded with their position and hashed by their key (the line
stripped of white space at both ends, A-Z lower-cased). Distinct documents are
counted per hash; a key of at least ``min_chars`` code points in at least
``min_docs`` documents loses all its lines except in the largest doc_id that
holds it. What stays is reassembled by position.

Defined cases: a null or empty text is one empty line; rows with a null doc_id
are left out; rows that repeat a doc_id count as one document when documents
are counted, and each of them is cleaned and returned; other columns pass
through, except that ``n_lines`` and ``n_dropped`` are replaced. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import folded_key, row_key, strip_white

# A key's rows go to this many groups when the few shared keys are joined back
# to all lines, so a line that a third of all documents hold is no single task.
SALTS = 8


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_index(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of every line whose key is long enough; the
    key's 128-bit hash is two 64-bit hashes of different seeds."""
    rows = docs.where("doc_id is not null").select("doc_id", "text", row_key(F.col("text")).alias("row"))
    lines = rows.select("doc_id", "row", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.where(F.char_length("line") >= min_chars).select(
        "doc_id", "row", "pos", strip_white(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    key = folded_key(F.col("key"))
    return keyed.select("doc_id", "row", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def shared_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, keeper): keys in at least ``min_docs`` documents and the document that keeps them."""
    return (lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
            .where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the cleaned ``text`` and with ``n_lines`` and ``n_dropped`` (long)."""
    lines = line_index(docs, min_chars)
    shared = shared_keys(lines, min_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dropped = (lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
               .join(shared, ["h1", "h2", "salt"]).where(F.col("doc_id") != F.col("keeper"))
               .groupBy("doc_id", "row").agg(F.collect_set("pos").alias("drop")))
    d = dropped.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("drop").alias("__drop"))
    base = docs.where("doc_id is not null").drop("n_lines", "n_dropped")
    # The drop lists are the small side of each partition; hashing them spares a sort of the texts.
    joined = base.join(d.hint("shuffle_hash"), (base["doc_id"] == d["__id"]) & (row_key(base["text"]) == d["__row"]), "left")
    joined = joined.withColumn("__parts", split_lines(F.col("text")))
    parts = F.col("__parts")
    kept_pos = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__drop"))
    kept = F.array_join(F.transform(kept_pos, lambda i: F.get(parts, i)), "\n")
    text = F.when(F.col("__drop").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(kept)
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in base.columns],
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"))
