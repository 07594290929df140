"""Toxicity by weak supervision: many voters, a label model, and a linear classifier on its posteriors.

1. Voters look at a text (lexicons, patterns, and word starts that the training
   labels bring out) and fire or not: ``VOTERS``. A word or word start enters the learnt
   lexicon if it is met in toxic training documents after enough different
   words (so that copies of one document count once) and the lower confidence
   bound of its share of toxic documents is high.
2. The label model is generative: a document has a hidden label, and given the
   label the voters depend on each other by a tree, the one of greatest mutual
   information given the label (so correlated voters do not count twice). Its
   tables, which hold the voters' accuracies and correlations, are estimated by
   expectation and maximisation on counts of vote patterns over all documents;
   patterns are at most 2 to the number of voters, whatever the corpus size. Training
   labels, where known, stand for the hidden label.
3. A logistic regression on the found words, their number and the votes is
   trained on the posteriors of all documents, counted together by equal features.

The lexicon is learnt from a sample of at most ``SAMPLE`` labelled documents of each
kind and has at most ``LEXICON`` entries, which go to every task; everything else
covers all documents.

Defined cases: a null or empty text fires no voter but the one for texts without
findings, and is scored like any other; labels of a null doc_id or value are
ignored, repeated labels of one document count once (the smaller); without
toxic labels the fixed lexicons stand in for them; rows with a null doc_id are
left out; repeated rows are scored each; an empty table gives no rows; other columns do
not matter. Only the text enters a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, save

THRESHOLD = 0.5
SAMPLE = 200_000  # labelled documents of each kind that the lexicon is learnt from
LEXICON = 4000  # learnt words and word starts
CONTEXTS = 5  # different words that an entry must follow in toxic documents, by 64 classes
WEAK, STRONG = 0.5, 0.85  # lower bounds of an entry's share of toxic documents
STARTS = (4, 5, 6)  # lengths of word starts
ROUNDS = 25
FLUSH = 200_000  # entries that a task counts before it hands them on

# Lower-case words of insult, contempt and profanity in four languages.
INSULTS = ["idiot", "idiots", "moron", "morons", "imbecile", "loser", "losers", "scum", "trash", "clown", "fool", "jerk", "creep",
           "bastard", "pig", "vermin", "parasite", "freak", "coward", "liar"]
CONTEMPT = ["stupid", "pathetic", "worthless", "disgusting", "dumb", "ugly", "useless", "filthy", "brainless", "repulsive",
            "despicable", "vile", "hateful", "braindead"]
PROFANITY = ["damn", "crap", "shit", "bullshit", "fuck", "fucking", "bitch", "asshole", "dickhead", "wanker"]
FOREIGN = ["arschloch", "dummkopf", "trottel", "abschaum", "schwachkopf", "versager", "dreckskerl", "widerlich", "erbärmlich",
           "connard", "connasse", "abruti", "imbécile", "crétin", "ordure", "minable", "dégueulasse", "salaud",
           "idiota", "imbécil", "estúpido", "estúpida", "basura", "payaso", "escoria", "asqueroso", "patético", "inútil"]
THREATS = ["shut up", "drop dead", "go to hell", "kill yourself", "i hate you", "halt die klappe", "halt's maul",
           "ferme ta gueule", "va te faire", "cállate", "vete al infierno"]
ADDRESS = ["you", "your", "youre", "du", "dich", "ihr", "tu", "toi", "vous", "eres", "usted"]

VOTERS = ["insult", "contempt", "profanity", "foreign", "threat", "address", "masked", "shouting", "exclaiming",
          "learnt_strong", "learnt_weak", "found_two", "found_three", "dense", "nothing"]

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][*@#$]+[^\W\d_]")


def entries(word: str) -> list[str]:
    """The lexicon entries that a lower-case word may have: itself (marked by a final blank) and its starts."""
    return [word + " ", *(word[:k] for k in STARTS if len(word) >= k)]


def count_entries(docs: DataFrame) -> DataFrame:
    """(entry, toxic, clean, contexts) over ``docs`` (text, toxic boolean): documents, and classes of preceding words as bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            signed = [[n - (1 << 64) if n >> 63 else n for n in c] for c in zip(*counts.values())]
            return pa.record_batch([pa.array(list(counts)), *[pa.array(c, pa.int64()) for c in signed]],
                                   names=["entry", "toxic", "clean", "contexts"])

        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                words = _WORD.findall((text.as_py() or "").lower())
                before = dict(zip(reversed(words), reversed(["", *words[:-1]])))
                seen: dict[str, str] = {}
                for word, previous in before.items():
                    for e in entries(word):
                        seen[e] = previous
                for e, previous in seen.items():
                    own = counts.setdefault(e, [0, 0, 0])
                    if toxic:
                        own[0] += 1
                        own[2] |= 1 << (zlib.crc32(previous.encode()) & 63)
                    else:
                        own[1] += 1
                if len(counts) > FLUSH:
                    yield flush()
                    counts = {}
        if counts:
            yield flush()

    made = docs.select(F.col("text").cast("string"), "toxic").mapInArrow(run, "entry string, toxic long, clean long, contexts long")
    return made.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"),
                                     F.expr("bit_or(contexts)").alias("contexts"))


def lower_bound(hits: Column, n: Column, z: float = 1.64) -> Column:
    """Wilson's lower confidence bound of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def learn_lexicon(docs: DataFrame) -> dict[str, bool]:
    """Entry: whether it is a strong one. Starts make the longer entries that they cover superfluous."""
    bound = lower_bound(F.col("toxic"), F.col("toxic") + F.col("clean"))
    got = count_entries(docs).where(F.expr(f"bit_count(contexts) >= {CONTEXTS}")).withColumn("bound", bound).where(
        F.col("bound") >= WEAK).orderBy(F.desc("bound"), "entry").limit(LEXICON).collect()
    bounds = {r["entry"]: r["bound"] for r in got}
    return {e: x >= STRONG for e, x in bounds.items()
            if not any(bounds.get(s, 0) >= min(x, STRONG) for s in entries(e.strip())[1:] if s != e and len(s) < len(e))}


def find(texts: Iterator[str | None], lexicon: dict[str, bool]) -> Iterator[tuple[int, list[int]]]:
    """(votes as bits, features) of each text. Features: places in the lexicon, counts of findings, votes."""
    place = {e: i for i, e in enumerate(lexicon)}
    kinds = {w: k for k, words in enumerate((INSULTS, CONTEMPT, PROFANITY, FOREIGN)) for w in words}
    fixed = {w: len(place) + i for i, w in enumerate(kinds)}
    counts_at = len(place) + len(fixed)
    votes_at = counts_at + 4
    address, strong = set(ADDRESS), [*lexicon.values()]
    known: dict[str, tuple | None] = {}

    def look_up(word: str) -> tuple | None:
        low = word.lower()
        learnt = next((place[e] for e in entries(low) if e in place), None)
        if learnt is None and low not in fixed:
            return None
        return learnt, fixed.get(low), kinds.get(low)

    for text in texts:
        text = text or ""
        words = _WORD.findall(text)
        if len(known) > 1_000_000:
            known = {}
        for w in set(words).difference(known):
            known[w] = look_up(w)
        hits = [i for i, w in enumerate(map(known.__getitem__, words)) if w is not None]
        found = {known[words[i]] for i in hits}
        low = text.lower()
        learnt = {x for x, _, _ in found if x is not None}
        fire = {kind for _, _, kind in found if kind is not None}
        fire |= {4} if any(t in low for t in THREATS) else set()
        fire |= {5} if any(w.lower() in address for i in hits for w in words[max(0, i - 3):i]) else set()
        fire |= {6} if any(c in text for c in "*@#$") and _MASKED.search(text) else set()
        fire |= {7} if 2 * sum(len(w) > 1 and w.isupper() for w in words) > len(words) > 0 else set()
        fire |= {8} if "!!" in text else set()
        fire |= {9} if any(strong[x] for x in learnt) else set()
        fire |= {10} if any(not strong[x] for x in learnt) else set()
        fire |= {11} if len(hits) >= 2 else set()
        fire |= {12} if len(hits) >= 3 else set()
        fire |= {13} if 100 * len(hits) > len(words) else set()
        fire |= {14} if not hits else set()
        features = learnt | {x for _, x, _ in found if x is not None} | {votes_at + v for v in fire}
        features |= {counts_at + i for i, n in enumerate((1, 2, 3, 5)) if len(hits) >= n}
        yield sum(1 << v for v in fire), sorted(features)


def width(lexicon: dict[str, bool]) -> int:
    return len(lexicon) + len({*INSULTS, *CONTEMPT, *PROFANITY, *FOREIGN}) + 4 + len(VOTERS)


def featurize(docs: DataFrame, lexicon: dict[str, bool]) -> DataFrame:
    """(doc_id, votes, features) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes, features = zip(*find((t.as_py() for t in b.column(1)), lexicon)) if len(b) else ((), ())
            yield pa.record_batch([b.column(0), pa.array(votes, pa.int32()), pa.array(features, pa.list_(pa.int32()))],
                                  names=["doc_id", "votes", "features"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, votes int, features array<int>")


class LabelModel:
    """P(votes, label): given the label, each voter depends on its parent in a tree of voters."""

    def __init__(self, patterns: np.ndarray, unknown: np.ndarray, clean: np.ndarray, toxic: np.ndarray, voters: int = len(VOTERS),
                 rounds: int = ROUNDS):
        """``patterns``: votes as bits, with the documents of each that have no training label, and that have one."""
        self.x = (patterns[:, None] >> np.arange(voters) & 1).astype(float)
        known = clean.sum() + toxic.sum()
        self.prior = (toxic.sum() + 1) / (known + 2) if known else 0.1
        if toxic.sum():
            q = np.zeros(len(patterns))
            start = [clean + 0.0, toxic + 0.0]
        else:  # nothing to go by but the fixed voters, whose word is taken for the labels'
            rounds = 0
            q = np.where(self.x[:, :6].any(axis=1), 0.9, 0.02)
            start = [(1 - q) * (clean + unknown), q * unknown]
        self._fit(start)
        for _ in range(rounds):
            q = self.posterior(self.x)
            before, after = q, [clean + (1 - q) * unknown, toxic + q * unknown]
            self._fit(after)
            if np.abs(self.posterior(self.x) - before).max() < 1e-6:
                break

    def _fit(self, mass: list[np.ndarray], smooth: float = 0.5) -> None:
        """Tables and tree from the mass of both labels on each pattern."""
        m = self.x.shape[1]
        both = [(self.x * w[:, None]).T @ self.x for w in mass]  # both voters fire
        total = [w.sum() for w in mass]
        information = np.zeros((m, m))
        joint = []
        for pair, n in zip(both, total):
            one = np.diag(pair)
            cells = np.stack([np.stack([n - one[:, None] - one[None] + pair, one[None] - pair]),
                              np.stack([one[:, None] - pair, pair])])  # [vote of j, vote of k, j, k]
            p = (np.maximum(cells, 0) + smooth) / (n + 4 * smooth)
            joint.append(p)
            mutual = (p * np.log(p / (p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)))).sum(axis=(0, 1))
            information += n / max(sum(total), 1e-9) * mutual
        # the maximum spanning tree, grown from the first voter
        self.parent = np.full(m, -1)
        near = information[0].copy()
        link, left = np.zeros(m, int), set(range(1, m))
        self.order = [0]
        while left:
            k = max(left, key=lambda i: (near[i], -i))
            left.remove(k)
            self.parent[k] = link[k]
            self.order.append(k)
            closer = information[k] > near
            near[closer], link[closer] = information[k][closer], k
        self.accuracy = np.stack([(np.diag(pair) + smooth) / (n + 2 * smooth) for pair, n in zip(both, total)])
        # log P(vote of k | vote of its parent, label): [label, parent's vote, vote, k]
        self.tables = np.stack([np.stack([
            np.stack([np.log(p[a, b, self.parent, np.arange(m)] / p[a, :, self.parent, np.arange(m)].sum(axis=1)) for b in (0, 1)])
            for a in (0, 1)]) for p in joint])
        self.first = np.log(np.stack([1 - self.accuracy[:, 0], self.accuracy[:, 0]], axis=1))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        votes = x.astype(int)
        log = []
        for label, p in ((0, 1 - self.prior), (1, self.prior)):
            own = math.log(p) + self.first[label][votes[:, 0]]
            for k in self.order[1:]:
                own = own + self.tables[label][votes[:, self.parent[k]], votes[:, k], k]
            log.append(own)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def training_labels(labels: DataFrame, train: Column) -> DataFrame:
    return (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(train)
            .groupBy("doc_id").agg((F.min("toxic") == 1).alias("toxic")))


def sample(labelled: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most about ``most`` rows of each kind, by a hash of the id."""
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {t: min(1.0, most / n.get(t, 1)) for t in (True, False)}
    if min(share.values()) == 1:
        return labelled
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return labelled.where(place < F.when(F.col("toxic"), share[True]).otherwise(share[False]))


def classify(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``, learnt from the labels that ``train`` (a condition on
    doc_id) admits; by default those whose crc32 of the id is not a multiple of five."""
    train = fold(F.col("doc_id")) != 0 if train is None else train
    known = save(training_labels(labels, train))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # the sample's size is bounded, so its ids may go to every task and no text is shuffled
    lexicon = learn_lexicon(texts.join(F.broadcast(sample(known)), "doc_id"))
    made = save(featurize(docs, lexicon))
    counted = made.select("doc_id", "votes").join(known, "doc_id", "left").groupBy("votes").agg(
        F.count_if(F.col("toxic").isNull()).alias("unknown"), F.count_if(F.col("toxic") == F.lit(False)).alias("clean"),
        F.count_if("toxic").alias("toxic")).orderBy("votes").collect()
    if not counted:
        return made.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    columns = [np.array([r[c] for r in counted], np.int64) for c in ("votes", "unknown", "clean", "toxic")]
    model = LabelModel(*columns)
    posterior = docs.sparkSession.createDataFrame(
        [(int(v), float(q)) for v, q in zip(columns[0], model.posterior(model.x))], "votes int, posterior double")
    names = CountVectorizerModel.from_vocabulary([str(i) for i in range(width(lexicon))], "names", "vector")
    names.setBinary(True)

    def vectors(df: DataFrame) -> DataFrame:
        return names.transform(df.withColumn("names", F.transform("features", lambda x: x.cast("string")))).drop("names")

    sets = made.groupBy("votes", "features").agg(F.count("*").alias("n")).join(posterior, "votes")
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("posterior")).alias("weight")),
                             F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("posterior"))).alias("weight"))))
    rows = save(sets.select("features", both.alias("x")).select("features", "x.*").where("weight > 0"))
    fitted = LogisticRegression(featuresCol="vector", weightCol="weight", regParam=1e-4, standardization=False, maxIter=60).fit(
        vectors(rows))
    score = vector_to_array("probability")[1].alias("score")
    return fitted.transform(vectors(made)).select("doc_id", score).select(
        "doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
