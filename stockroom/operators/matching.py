"""Item lookup by words and question routing, as batch jobs.

Z5 matches a table of requests against the item table. The reference ran
one database query per request with case-insensitive regular expressions
per word ("every word occurs in the brand or the item name"). Here the
substring test becomes an equi-join: a word occurs in a text exactly when
it equals a same-length substring of one of the text's whitespace-separated
tokens (words never contain spaces). Item tokens are cut into their
substrings of the lengths the request words actually have, so the join key
table grows with the item vocabulary, not with requests x items, and no
cross join is needed. Requests are de-duplicated by text before matching
and joined back on the raw text at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_sales_question, question_date, search_words, spoken_item_name, spoken_size
from ..session import cut_lineage


def item_substrings(items: DataFrame, lengths: DataFrame, text_cols: list[str], id_col: str) -> DataFrame:
    """(id, sub): every substring of every lower-cased token of the item's
    text columns, for each length in ``lengths`` (one column ``len``)."""
    toks = items.select(id_col, F.explode(F.array_distinct(F.flatten(F.array(
        *[F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+") for c in text_cols])))).alias("tok"))
    toks = toks.filter(F.col("tok") != "").distinct()
    # the distinct word lengths (a few dozen at most) as one array value
    all_lengths = lengths.select(F.array_sort(F.collect_set("len"))).scalar()
    toks = (toks.select(id_col, "tok", F.explode(all_lengths).alias("len"))
            .filter(F.length("tok") >= F.col("len")))
    starts = F.sequence(F.lit(1), F.length("tok") - F.col("len") + 1)
    subs = toks.select(id_col, "tok", "len", F.explode(starts).alias("pos"))
    return subs.select(id_col, F.substring("tok", F.col("pos"), F.col("len")).alias("sub")).distinct()


def match_items(requests: DataFrame, items: DataFrame, request_id: str = "request_id", text_col: str = "text",
                item_name: str = "stock_item_name", brand_col: str = "brand", size_col: str = "size_ml") -> DataFrame:
    """Best item per request.

    Tier 1: every request word occurs in the brand or the item name and the
    size equals the spoken size (when one is given); tier 4: every word,
    size ignored. (The reference's tiers 2 and 3, phrase inside brand or
    inside item name, imply tier 1 or 4 whenever the request has a word, so
    they can never win.) Ties: smallest item name. A request whose words are
    all ignored matches the smallest item name (of its size when given).
    """
    # Normalise each distinct request text once and each distinct item once.
    # Both tables are used by several branches of the plan below, so they
    # are materialised with a reliable checkpoint (bounded by distinct texts
    # and distinct items, not by requests) instead of being recomputed per
    # branch.
    norm = requests.select(text_col).distinct() \
        .withColumn("_words", search_words(spoken_item_name(text_col))).withColumn("_size", spoken_size(text_col))
    # exact text key: words never contain spaces and the size part is digits
    tid = F.concat(F.array_join("_words", " "), F.lit("|"), F.coalesce(F.col("_size").cast("string"), F.lit("")))
    norm = cut_lineage(norm.withColumn("_tid", tid))
    texts = norm.select("_tid", "_words", "_size").dropDuplicates(["_tid"])
    words = texts.select("_tid", F.explode("_words").alias("w")).distinct()
    n_words = texts.select("_tid", F.size("_words").alias("_n"), "_size")
    item_ids = cut_lineage(items.select(item_name, brand_col, size_col).distinct().withColumn(
        "_iid", F.concat_ws("|", item_name, brand_col, F.coalesce(F.col(size_col).cast("string"), F.lit("")))))
    lengths = words.select(F.length("w").alias("len")).distinct()
    subs = item_substrings(item_ids, lengths, [brand_col, item_name], "_iid")
    # (word, item) for every distinct request word: computed once per word,
    # not once per request
    vocab = words.select("w").distinct()
    word_items = vocab.join(subs, vocab.w == subs.sub).select("w", "_iid").distinct()
    # Candidates come from each request's rarest word (fewest items); the
    # other words are then checked with a semi join on (word, item).
    freq = word_items.groupBy("w").agg(F.count(F.lit(1)).alias("_df"))
    rarest = (words.join(freq, "w", "left").groupBy("_tid")
              .agg(F.min_by("w", F.struct(F.coalesce("_df", F.lit(0)), "w")).alias("_rw")))
    cand = rarest.join(word_items, rarest._rw == word_items.w).select("_tid", "_iid")
    checked = (cand.join(words, "_tid").join(word_items, ["w", "_iid"], "left_semi")
               .groupBy("_tid", "_iid").agg(F.count(F.lit(1)).alias("_m")))
    full = checked.join(n_words, "_tid").filter(F.col("_m") == F.col("_n")).join(item_ids, "_iid")
    cand = full.select("_tid", "_size", item_name, brand_col, size_col)
    tier = F.when(F.col("_size").isNull() | (F.col(size_col) == F.col("_size")), F.lit(1)).otherwise(F.lit(4))
    best = (cand.withColumn("tier", tier).groupBy("_tid")
            .agg(F.min(F.struct("tier", item_name, brand_col, size_col)).alias("_b")))
    # Requests whose words are all ignored match every item: the smallest
    # name of the spoken size (tier 1), else the smallest name overall.
    per_size = item_ids.groupBy(F.col(size_col).alias("_ps")).agg(
        F.min(F.struct(F.lit(1).alias("tier"), item_name, brand_col, size_col)).alias("_bs"))
    overall = item_ids.select(F.min(F.struct(item_name, brand_col, size_col))).scalar()
    no_words = n_words.filter(F.col("_n") == 0).join(per_size, F.col("_size") == F.col("_ps"), "left")
    any_tier = F.when(F.col("_size").isNull(), F.lit(1)).otherwise(F.lit(4))
    fallback = F.struct(any_tier.alias("tier"), overall[item_name].alias(item_name),
                        overall[brand_col].alias(brand_col), overall[size_col].alias(size_col))
    best = best.unionByName(no_words.select("_tid", F.coalesce("_bs", fallback).alias("_b")))
    out = texts.join(best, "_tid", "left").select(
        "_tid", F.col(f"_b.{item_name}").alias("matched_item"), F.col(f"_b.{brand_col}")
        .alias("matched_brand"), F.col(f"_b.{size_col}").alias("matched_size"), F.col("_b.tier").alias("tier"))
    by_text = norm.select(F.col(text_col).alias("_text"), "_tid", "_size").join(out, "_tid", "left")
    joined = requests.select(request_id, text_col).join(
        by_text, requests[text_col].eqNullSafe(by_text["_text"]), "left")
    return joined.select(request_id, text_col, F.col("_size").alias("spoken_size"), "matched_item",
                         "matched_brand", "matched_size", "tier")


def route_questions(df: DataFrame, text_col: str = "text", as_of="2026-04-07") -> DataFrame:
    """Per question, whether it asks about sales and which date it means
    (ISO date, else dd/mm/yyyy, else ``as_of``)."""
    return (df.withColumn("is_sales_query", is_sales_question(text_col))
            .withColumn("query_date", question_date(text_col, as_of)))
