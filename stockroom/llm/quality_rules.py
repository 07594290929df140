"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Base rules reject a text of fewer than ``MIN_WORDS`` words, or one of which
over half the words lie in repeated 3-word windows. Beyond them, each rule
compares one ratio with a cutoff chosen from labelled holdout documents, for
each stratum (language) apart: the most severe cutoff of a fixed grid for
which an exact binomial test still shows, at level ``delta`` over all tests,
that at most ``alpha`` of the stratum's good documents are rejected.

Multiple testing: ``alpha`` is shared among the rules, so that all rules of a
stratum together reject at most ``alpha`` of its good documents, and ``delta``
among rules and strata (Bonferroni). Along a grid the test is a fixed sequence
from lenient to severe that stops at the first failure; as rejections grow
with severity, that is the most severe cutoff that passes.

A stratum with too few labelled good documents passes no test and has no
cutoffs: only the base rules apply there. That is the guarantee at work, not
a switch on size.

Defined cases: a null text has no words; a null stratum is a stratum of its
own; rows with a null doc_id are left out; repeated rows are judged alike;
columns of the input that bear a result's name are replaced. Without labels
no cutoff is chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]

# rule -> (ratio of the measures, cutoffs from lenient to severe); a document
# is rejected where the ratio exceeds the cutoff.
RULES = {
    "symbols": ("n_symbols / n_words", [2.0, 1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05]),
    "repeats": ("n_repeat_words / n_words", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]),
    "dup_lines": ("n_dup_lines / n_words", [0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.015]),
    "long_words": ("word_chars / n_words", [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0]),
}


FEW = 32


def repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """``df`` with ``out``: how many of the array ``words`` lie in a 3-word window found twice or more.

    The windows' hashes are sorted; equal neighbours are the repeated hashes.
    Few of them are looked up place by place; for many, hashes are sorted with
    their places and equal neighbours give the places (n log n, same result).
    Every array is a column of its own: written inside a lambda it would be
    made anew for each element.
    """
    n, w = F.size(words), F.col(words)
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("__h", F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    df = df.withColumn("__o", F.sort_array("__h"))
    o = F.col("__o")
    df = df.withColumn("__d", F.array_distinct(F.filter(o, lambda x, k: x == F.get(o, k - 1))))
    h, d = F.col("__h"), F.col("__d")
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("__p", F.when(F.size(d) > FEW, placed))
    p = F.col("__p")
    same = lambda x, other: F.coalesce(other.getField("h") == x.getField("h"), F.lit(False))
    by_sort = F.sort_array(F.transform(
        F.filter(p, lambda x, k: same(x, F.get(p, k - 1)) | same(x, F.get(p, k + 1))), lambda x: x.getField("i")))
    by_place = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda x: x.isNotNull())
    df = df.withColumn("__s", F.when(F.size(d) == 0, F.array().cast("array<int>"))
                       .when(F.size(d) > FEW, by_sort).otherwise(by_place))
    s = F.col("__s")
    gaps = F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn(out, F.when(F.size(s) > 0, covered).otherwise(F.lit(0).cast("long"))).drop(
        "__h", "__o", "__d", "__p", "__s")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the base measures and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.where("doc_id is not null").drop(*BASE)
    df = base.withColumn("__w", F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    n = F.size("__w")
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    })
    df = repeat_words(df, "__w", "n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.drop("__w").withColumn("base_failed", failed)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact, summed in log space.

    log C(n, i) p^i (1-p)^(n-i) follows from its predecessor; the running sum
    is kept as (log term, log sum)."""
    first = n * F.log1p(-p)
    start = F.struct(first.alias("t"), first.alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a.getField("t") + F.log((n - i + 1) / i) + F.log(p) - F.log1p(-p)
        hi, lo = F.greatest(t, a.getField("s")), F.least(t, a.getField("s"))
        return F.struct(t.alias("t"), (hi + F.log1p(F.exp(lo - hi))).alias("s"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.exp(F.aggregate(steps, start, step, lambda a: a.getField("s"))), F.lit(1.0))


def ratio(rule: str) -> Column:
    return F.expr(f"CASE WHEN n_words > 0 THEN {RULES[rule][0]} ELSE 0 END").cast("double")


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02,
            delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff, rejected, good): the chosen cutoffs.

    The holdout is every labelled good document that passes the base rules.
    One row comes out per stratum and rule whose test passes.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    held = measured.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    strata = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    counts = held.groupBy(strata.alias("stratum")).agg(
        F.count("*").alias("good"),
        *[F.count_if(ratio(r) > c).alias(f"{r}_{i}") for r, (_, grid) in RULES.items() for i, c in enumerate(grid)])
    tests = counts.withColumn("n_strata", F.count("*").over(Window.partitionBy())).select(
        "stratum", "good", "n_strata", F.explode(F.array(*[
            F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"{r}_{i}").alias("rejected"))
            for r, (_, grid) in RULES.items() for i, c in enumerate(grid)])).alias("t")).select(
        "stratum", "good", "n_strata", "t.*")
    p_value = binomial_tail(F.col("rejected"), F.col("good"), F.lit(alpha / len(RULES)))
    # Beyond the mean the test cannot pass; the sum is not spelled out there.
    passing = tests.where(F.col("rejected") < F.col("good") * (alpha / len(RULES))).where(
        p_value <= delta / (len(RULES) * F.col("n_strata")))
    return passing.groupBy("stratum", "rule").agg(
        F.min("cutoff").alias("cutoff"), F.max("rejected").alias("rejected"), F.max("good").alias("good"))


def judge(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02,
          delta: float = 0.05, rows: DataFrame | None = None) -> DataFrame:
    """``measured`` with ``kept``. Measured rows are read twice: save them first.

    ``rows`` are judged in their place where given: the same rows measured again, with columns
    that are dearer to save than to measure. The cutoffs travel as one map in a scalar subquery. Its size is bounded: a
    stratum has entries only if it holds some hundreds of labelled good documents.
    """
    chosen = cutoffs(measured, labels, stratum, alpha, delta)
    key = F.concat_ws("\x00", F.col("rule"), F.col("stratum"))
    book = chosen.agg(F.map_from_entries(F.collect_list(F.struct(key, F.col("cutoff")))).alias("m")).scalar()
    own = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    base = (measured if rows is None else rows).drop("kept").withColumn("__cut", book)
    rejected = F.lit(False)
    for rule in RULES:
        cut = F.try_element_at(F.col("__cut"), F.concat_ws("\x00", F.lit(rule), own))
        rejected = rejected | F.coalesce(ratio(rule) > cut, F.lit(False))
    return base.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("__cut")
