"""URL filter: given host and path rules, then association rules mined from labels.

Fixed rules come first: a rule fits its host and all subdomains if the url's
path starts with the rule's; the longest wins. For the other urls, Spark's
FP-growth mines combinations of URL tokens from the urls labelled bad; an
inverted index then counts the good urls that hold them. Rules "tokens -> bad"
of enough bad urls and confidence over all labelled urls are kept unless a
rule on part of their tokens is at least as confident. They
are matched by an inverted index: each rule is filed under its rarest token,
the urls' tokens meet the index in an equality join, and the other tokens of
the rule are verified there. A url that some rule matches is blocked, any
other is allowed.

Support is a number of bad urls, ``min_count``, at every size: a confidence
measured on fewer means nothing, and a share would let a bad host through
because the table is large. Tokens that no good url has are rules by
themselves and are not combined, as no wider rule is more confident; nor are
tokens that all labelled urls have, as they change no count.

Defined cases: a null url, or one without ``://``, has empty host and path and
no tokens but is judged like any other; rows with a null page_id are left out;
rows that repeat a page_id are judged each by their own url; a page with
several labels is bad if any label is; without labels, or with no rule that
passes, urls that no fixed rule fits are allowed. Columns that bear a result's
name are replaced.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save


def lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, query)."""
    part = lambda i: F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$", i)
    return pages.where("page_id is not null").select(
        F.col("page_id").cast("long"), F.col("url").cast("string")).select(
        "page_id", "url", lower(part(1)).alias("host"), part(2).alias("path"), part(3).alias("query"))


def fixed_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for way, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        own = F.col("host")
        fits = ((own == host) | own.endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, way).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """Distinct tokens of host (``h:``), path (``p:``) and query names (``q:``); numbers in a path are one token."""
    named = lambda mark, words: F.transform(
        F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(mark), w))
    host = F.split("host", r"[.:@]")
    path = F.transform(F.split(lower(F.col("path")), r"[/._+~-]+"), lambda w: F.when(w.rlike(r"^\d+$"), "0").otherwise(w))
    query = F.transform(F.split(F.regexp_replace("query", r"#.*$", ""), r"[?&]"), lambda w: F.split_part(w, F.lit("="), F.lit(1)))
    return F.array_distinct(F.concat(named("h:", host), named("h:", F.flatten(F.transform(
        F.filter(host, lambda w: w.contains("-")), lambda w: F.split(w, "-")))), named("p:", path), named("q:", query)))


def mine(labelled: DataFrame, min_count: int = 20, min_confidence: float = 0.8, min_support: float = 0.0) -> DataFrame:
    """(rule_id, words, anchor, confidence) from ``labelled`` (page_id, tokens, bad).

    A rule needs ``min_count`` bad urls, and ``min_support`` of all labelled urls if that is more."""
    spark = labelled.sparkSession
    labelled = save(labelled.select("tokens", "bad"))
    n = labelled.count()
    least = max(min_count, math.ceil(min_support * n), 1)
    # urls of equal tokens are counted as one row
    baskets = save(labelled.groupBy(F.sort_array("tokens").alias("tokens")).agg(
        F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")))
    words = save(baskets.select(F.explode("tokens").alias("word"), "bad", "good").groupBy("word").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= least))
    # no wider rule betters a word that no good url has, or differs without a word that all urls have
    mixed = words.where((F.col("good") > 0) & (F.col("bad") + F.col("good") < n)).select("word")
    numbered = labelled.where("bad").withColumn("row", F.monotonically_increasing_id())
    bad_urls = save(numbered.select("row", F.explode("tokens").alias("word")).join(mixed, "word").groupBy("row").agg(
        F.collect_list("word").alias("items")).where("size(items) > 1").select("items"))
    n_bad = bad_urls.count()
    if n_bad >= least:
        # half a url less, so that rounding does not ask for one more
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n_bad).fit(bad_urls)
        sets = model.freqItemsets.where("size(items) > 1").select(F.sort_array("items").alias("words"), F.col("freq").alias("bad"))
    else:
        sets = spark.createDataFrame([], "words array<string>, bad long")
    sets = save(sets.withColumn("rule_id", F.concat_ws("\x00", "words")))
    filed = sets.select("rule_id", F.explode("words").alias("word")).join(words, "word").groupBy("rule_id").agg(
        F.min_by("word", F.struct("good", "word")).alias("anchor"))
    met = baskets.where("good > 0").select("tokens", "good", F.explode("tokens").alias("anchor")).join(
        sets.join(filed, "rule_id").select("rule_id", "words", "anchor"), "anchor")
    good = met.where(F.size(F.array_except("words", "tokens")) == 0).groupBy("rule_id").agg(F.sum("good").alias("good"))
    counted = sets.join(good, "rule_id", "left").select("rule_id", "words", "bad", F.coalesce("good", F.lit(0)).alias("good"))
    counted = counted.union(words.select("word", F.array("word"), "bad", "good"))
    rules = save(counted.withColumn("confidence", F.col("bad") / (F.col("bad") + F.col("good"))).where(
        F.col("confidence") >= min_confidence).drop("bad", "good"))
    by_word = rules.select("rule_id", "words", "confidence", F.explode("words").alias("word")).join(
        words.select("word", (F.col("bad") + F.col("good")).alias("freq")), "word")
    # part rules: a rule filed under one of its words meets every rule that has the word
    part = by_word.groupBy("rule_id", "words", "confidence").agg(F.min_by("word", "freq").alias("anchor"))
    wider = by_word.select(F.col("word").alias("anchor"), F.col("rule_id").alias("o_id"), F.col("words").alias("o_words"),
                           F.col("confidence").alias("o_confidence"))
    redundant = wider.join(part, "anchor").where(
        (F.size("words") < F.size("o_words")) & (F.col("confidence") >= F.col("o_confidence"))
        & (F.size(F.array_except("words", "o_words")) == 0)).select(F.col("o_id").alias("rule_id")).distinct()
    return part.join(redundant, "rule_id", "left_anti").select("rule_id", "words", "anchor", "confidence")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (page_id, url) of ``urls`` (page_id, url, tokens) that hold all words of some rule."""
    met = urls.select("page_id", "url", "tokens", F.explode("tokens").alias("anchor")).join(
        rules.select("anchor", "words"), "anchor")
    return met.where(F.size(F.array_except("words", "tokens")) == 0).select("page_id", "url").distinct()


def filter_urls(pages: DataFrame, bad_pages: DataFrame, rules: list[tuple[str, str, str]], **mining) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url).

    ``bad_pages``: (page_id, bad), the labels. Only urls without a fixed rule are mined and matched."""
    rule, verdict = fixed_rule(rules)
    urls = parse(pages).withColumns({"rule": rule, "fixed": verdict})
    open_urls = urls.where("rule is null").select("page_id", "url", tokens().alias("tokens"))
    marks = bad_pages.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(
        F.max("bad").alias("bad"))
    labelled = open_urls.join(marks, "page_id").select("page_id", "tokens", "bad")
    hits = matched(open_urls, mine(labelled, **mining)).select(
        F.col("page_id").alias("__p"), F.col("url").alias("__u"), F.lit("block").alias("hit"))
    joined = urls.join(hits, (F.col("page_id") == F.col("__p")) & F.col("url").eqNullSafe(F.col("__u")), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("rule").isNull(), F.col("hit")),
                                                                       F.lit("allow")).alias("verdict"))
