"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All but the
last return the columns of documents:

1. quality rules: rejected documents go
2. quality classifier: rejected documents go
3. line dedup: lines that many documents share go (``n_chars`` follows)
4. SimHash near-dedup: the smallest doc_id of each group stays
5. best-fit packing: the pieces of each document, their places and token ids

Rows with a null doc_id go in the first stage. Rows that repeat a doc_id are
judged apart by the first two stages and reduced to one by near-dedup. Columns
of documents may have any name, those of the operators included: they are
passed on in a struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockroom.llm import line_dedup, packing, pu_classifier, quality_rules, simhash
from stockroom.llm.common import row_key, save, table
from stockroom.llm.queries import BYTE_BPE


def _apart(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with the columns that an operator uses, and all columns in a struct that it passes on.

    So the operator's own columns never meet those of documents."""
    return docs.where("doc_id is not null").select(*used, F.struct(*docs.columns).alias("__document"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Texts are measured twice, once for the cutoffs and once to apply them: that is cheaper than to save them.
    used = docs.where("doc_id is not null").select("doc_id", "lang", "text")
    measured = save(quality_rules.measure(used).drop("text"))
    # A row number keeps the planner from moving the filter before the measures, which would spell each out many times.
    rows = quality_rules.measure(_apart(docs, "doc_id", "lang", "text")).withColumn("__at", F.monotonically_increasing_id())
    judged = quality_rules.judge(measured, table(spark, sf_dir, "labels"), rows=rows)
    return judged.where(F.col("kept") & (F.col("__at") >= 0)).select("__document.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pu_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    used = docs.select("doc_id", "text", F.struct(F.lit(0).alias("__"), *others).alias("__others"))
    cleaned = line_dedup.dedup_lines(used).select("doc_id", "text", "__others.*")
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    first = simhash.near_duplicates(docs, shingle=3).where("doc_id = component_id").select("doc_id")
    # The ids are the small side of each partition; hashing them spares a sort of the texts.
    kept = _apart(docs, "doc_id", "text").join(first.hint("shuffle_hash"), "doc_id", "left_semi")
    once = Window.partitionBy("doc_id").orderBy(row_key(F.col("text")))
    return kept.withColumn("__n", F.row_number().over(once)).where("__n = 1").select("__document.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, BYTE_BPE)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("line_dedup", lines),
          ("simhash_near_dedup", near_dedup), ("best_fit_packing", pack)]

# Tokenisation, SimHash and the fitted classifier have no SQL form; tests/llm
# check the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
