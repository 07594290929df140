"""Language-model scoring by the likelihood of the subword lattice.

An existing piece vocabulary and its scores give each piece a probability,
which expectation and maximisation over the distinct training words adapts to
the corpus (the vocabulary itself is not trained). A word, with the
marker before it, is a lattice of all its segmentations into pieces; the
forward recursion in log space sums them to the word's marginal probability
(pieces never cross words, so a document's marginal is the product of its
words'). Unknown characters are spelt in byte pieces. The lattice is the base
distribution of a model learnt from the training documents: counts of words
and of document ends, absolutely discounted (discount n1 / (n1 + 2 n2) from
the numbers of words seen once and twice), give the freed mass to the lattice:

    P(w) = (max(c - d, 0) + d V B(w)) / N

which sums to one over all words and the end. A document's score is the log10
of the product over its words and one end; its lattice score is the log10 of
the product of its words' marginals under the existing scores alone, with
nothing learnt from the corpus.

Work on Spark: documents are folded into blocks of bounded size, each with its
own word list and the documents as places in it. The lists are sorted by word
and each word becomes one row: its training count and where it stands in which
blocks (one place per block, so even the most frequent word has no more than
one for a million tokens of the corpus). The lattice runs once per such row,
and the numbers go straight back to the places, packed by block; there
documents are added up. So a word moves once per block that has it, not once
per token, and its numbers once more.

Defined cases: a null or empty text is one end and has the lattice score 0;
rows with a null doc_id are left out; repeated rows are counted and scored each; without training
documents all counts are zero and the lattice alone scores; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save
from .piece_model import MARK, NORMAL, UNIGRAM, USER_DEFINED, parse_model

BLOCK_TOKENS = 1 << 20
HELD_PLACES = 1 << 20  # places whose numbers a task gathers before it packs them by block
END_SHARE = 1e-3  # the base distribution's probability of an end
BYTE_SHARE = 1e-4  # mass of the byte pieces, which no vocabulary scores usefully
ROUNDS = 2
PRIOR_USES = 100.0  # the existing scores count as so many uses of pieces
SHORT = 64  # characters of a word whose sums are first tried in plain doubles
NEVER = float("-inf")


class Lattice:
    """Pieces with their probabilities, the arcs of a word and the recursions over them.

    The last place of ``logs`` is a byte piece's; the others follow ``pieces``.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            m = parse_model(f.read())
        usable = {p: s for p, s, t in zip(m.pieces, m.scores, m.types)
                  if t in (NORMAL, USER_DEFINED) and MARK not in p[1:]}
        self.pieces = {p: i for i, p in enumerate(usable)}
        # A unigram score is a log probability. A BPE score is the negative rank; frequencies fall as its inverse.
        raw = np.array(list(usable.values()))
        self.weigh(np.exp(raw) if m.kind == UNIGRAM else 1 / (2.7 - raw))
        self.given = self.logs
        self.prefixes = prefix_table(self.pieces)
        self.spelt: dict[str, float] = {}
        self.spelt_shares: dict[str, float] = {}

    def weigh(self, weights: np.ndarray) -> None:
        """Set the pieces' probabilities in proportion to ``weights``; byte pieces keep their share."""
        self.share = (1 - BYTE_SHARE) * weights / weights.sum()
        with np.errstate(divide="ignore"):
            self.logs = [*np.log(self.share).tolist(), math.log(BYTE_SHARE / 256)]
        self.shares = self.share.tolist()

    def spell(self, c: str) -> float:
        """Log probability of a character's byte pieces."""
        if c not in self.spelt:
            self.spelt[c] = len(c.encode()) * self.logs[-1]
        return self.spelt[c]

    def forward(self, text: str, logs: list[float]) -> list[float]:
        """For each place of ``text``, the log of the summed probability of all segmentations up to it.

        Any character is also an arc of its byte pieces."""
        n, find, spell, exp, log1p = len(text), self.prefixes.get, self.spell, math.exp, math.log1p
        alpha = [NEVER] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            a, j = alpha[i], i + 1
            x = a + spell(text[i])
            old = alpha[j]
            alpha[j] = x if old == NEVER else max(x, old) + log1p(exp(-abs(x - old)))
            while j <= n:
                k = find(text[i:j])
                if k is None:
                    break
                if k >= 0:
                    x = a + logs[k]
                    old = alpha[j]
                    if old == NEVER:
                        alpha[j] = x
                    elif old >= x:
                        alpha[j] = old + log1p(exp(x - old))
                    else:
                        alpha[j] = x + log1p(exp(old - x))
                j += 1
        return alpha

    def word(self, word: str) -> float:
        """Log of the marginal probability of the marker and ``word``: the forward recursion's last value."""
        return self.forward(MARK + word, self.logs)[-1]

    def under_both(self, word: str) -> tuple[float, float]:
        """``word`` under the weights as set and under the existing scores, in one walk over the arcs."""
        text, find, spelt, logs, given = MARK + word, self.prefixes.get, self.spelt, self.logs, self.given
        exp, log1p, n = math.exp, math.log1p, len(text)
        alpha, other = [NEVER] * (n + 1), [NEVER] * (n + 1)
        alpha[0] = other[0] = 0.0
        for i, c in enumerate(text):
            a, o, at = alpha[i], other[i], i + 1
            x = spelt[c] if c in spelt else self.spell(c)
            y, x = o + x, a + x
            for j in range(i, n + 1):
                if j > i:
                    k = find(text[i:j])
                    if k is None:
                        break
                    if k < 0:
                        continue
                    at, x, y = j, a + logs[k], o + given[k]
                old, before = alpha[at], other[at]
                if old == NEVER:
                    alpha[at], other[at] = x, y
                    continue
                alpha[at] = old + log1p(exp(x - old)) if old >= x else x + log1p(exp(old - x))
                other[at] = before + log1p(exp(y - before)) if before >= y else y + log1p(exp(before - y))
        return alpha[n], other[n]

    def expect(self, word: str, into: list[float] | np.ndarray) -> None:
        """Add each piece's expected number of uses in ``word`` to ``into``.

        Sums of most words fit a double; others are taken in logs."""
        text, shares, find, spelt = MARK + word, self.shares, self.prefixes.get, self.spelt_shares
        n, arcs = len(text), []
        if n <= SHORT:
            alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
            alpha[0] = beta[n] = 1.0
            for i, c in enumerate(text):
                a = alpha[i]
                if c not in spelt:
                    spelt[c] = math.exp(self.spell(c))
                p = spelt[c]
                alpha[i + 1] += a * p
                arcs.append((i, i + 1, -1, p))
                for j in range(i + 1, n + 1):
                    k = find(text[i:j])
                    if k is None:
                        break
                    if k >= 0:
                        p = shares[k]
                        alpha[j] += a * p
                        arcs.append((i, j, k, p))
            if alpha[n] > 1e-250:
                alpha = [a / alpha[n] for a in alpha]
                for i, j, k, p in reversed(arcs):
                    p *= beta[j]
                    beta[i] += p
                    if k >= 0:
                        into[k] += alpha[i] * p
                return
        self.expect_in_logs(text, into)

    def expect_in_logs(self, text: str, into: list[float] | np.ndarray) -> None:
        """From the end backwards, a place passes the share of segmentations that go through it on to the arcs that
        end there, in proportion to their part of its sum."""
        logs, find, spell, exp = self.logs, self.prefixes.get, self.spell, math.exp
        n, alpha = len(text), self.forward(text, logs)
        through = [0.0] * n + [1.0]
        for i in range(n - 1, -1, -1):
            a = alpha[i]
            share = through[i + 1] and through[i + 1] * exp(a + spell(text[i]) - alpha[i + 1])
            for j in range(i + 1, n + 1):
                k = find(text[i:j])
                if k is None:
                    break
                if k >= 0 and through[j]:
                    p = through[j] * exp(a + logs[k] - alpha[j])
                    share += p
                    into[k] += p
            through[i] = share


def prefix_table(pieces: dict[str, int]) -> dict[str, int]:
    """Every beginning of a piece, with the piece's number, or -1 where it is not a piece itself."""
    return {p[:i]: -1 for p in pieces for i in range(1, len(p))} | pieces


@lru_cache(maxsize=2)
def load(path: str) -> Lattice:
    return Lattice(path)


BLOCK_SCHEMA = ("block long, doc_ids array<long>, train array<boolean>, n_tokens array<long>, sizes array<int>, "
                "uses binary, words array<string>, counts array<long>")
USES = np.dtype([("place", "<u4"), ("times", "<u4")])
NUMBERS = np.dtype([("place", "<u4"), ("c", "<i8"), ("marginal", "<f8"), ("given", "<f8")])


def pack(rows: np.ndarray) -> bytes:
    """Rows of numbers as compressed bytes: first all rows' first bytes, then all second ones, as high bytes are alike."""
    return pa.compress(rows.view("u1").reshape(len(rows), -1).T.tobytes(), "zstd", asbytes=True) if len(rows) else b""


def unpack(packed: bytes, size: int, kind: np.dtype) -> np.ndarray:
    """The ``size`` rows that were packed."""
    if not size:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(packed, size * kind.itemsize, "zstd", asbytes=True), "u1")
    return planes.reshape(kind.itemsize, size).T.copy().view(kind)[:, 0]


def blocks(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, train) folded into blocks. Block numbers are random: save the result before use."""
    def flush(rows: list, words: dict, counts: list) -> pa.RecordBatch:
        ids, train, n, places, times = zip(*rows)
        cell = lambda x, t: pa.array([x], t)
        uses = np.empty(sum(map(len, places)), USES)
        uses["place"], uses["times"] = np.concatenate(places), np.concatenate(times)
        return pa.record_batch([
            cell(uuid.uuid4().int >> 65, pa.int64()), cell(list(ids), pa.list_(pa.int64())),
            cell(list(train), pa.list_(pa.bool_())), cell(list(n), pa.list_(pa.int64())),
            cell([len(p) for p in places], pa.list_(pa.int32())),
            cell(pack(uses), pa.binary()),
            cell([w.decode() for w in words], pa.list_(pa.string())), cell(counts, pa.list_(pa.int64()))],
            names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words, counts, held = [], {}, [], 0
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            for doc, text, train in zip(b.column(0).to_pylist(), texts, b.column(2).to_pylist()):
                tokens = (text.as_py() or b"").lower().split()
                count = Counter(tokens)
                places = np.fromiter((words.setdefault(w, len(words)) for w in count), np.int64, len(count))
                times = np.fromiter(count.values(), np.int64, len(count))
                counts.extend([0] * (len(words) - len(counts)))
                if train:
                    for p, t in zip(places.tolist(), count.values()):
                        counts[p] += t
                rows.append((doc, train, len(tokens) + 1, places, times))
                held += len(tokens) + 1
                if held >= BLOCK_TOKENS:
                    yield flush(rows, words, counts)
                    rows, words, counts, held = [], {}, [], 0
        if rows:
            yield flush(rows, words, counts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "train").mapInArrow(run, BLOCK_SCHEMA)


def word_places(folded: DataFrame) -> DataFrame:
    """(word, c, blocks, places): each distinct word of all blocks, its training count and its places in the blocks.

    A stream of rows sorted by word, of which a task holds one batch and one word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            at = pa.array(np.append(starts, len(t)).astype(np.int32))
            whole = lambda k: t[k].combine_chunks()
            c = np.add.reduceat(t["count"].to_numpy(), starts)
            return pa.record_batch([whole("word").take(pa.array(starts)), pa.array(c), pa.ListArray.from_arrays(at, whole("block")),
                                    pa.ListArray.from_arrays(at, whole("place"))], names=["word", "c", "blocks", "places"])

        # the last word may go on: its rows wait, together only once it has ended
        waiting, last = [], None
        for b in batches:
            if not len(b):
                continue
            words = b.column("word")
            new = np.flatnonzero(pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)) + 1
            if last is None or words[0].as_py() == last:
                if not len(new):
                    waiting, last = [*waiting, b], words[0].as_py()
                    continue
                waiting.append(b.slice(0, new[0]))
                b, new = b.slice(new[0]), new - new[0]
            else:
                new = np.insert(new, 0, 0)
            yield rows(pa.Table.from_batches(waiting), np.array([0]))
            if new[-1]:
                yield rows(pa.Table.from_batches([b.slice(0, new[-1])]), new[:-1])
            waiting, last = [b.slice(new[-1])], words[len(words) - 1].as_py()
        if waiting:
            yield rows(pa.Table.from_batches(waiting), np.array([0]))

    listed = folded.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select(
        F.col("w.words").alias("word"), "block", "place", F.col("w.counts").alias("count"))
    # A set number of partitions, as few bytes of words are many seconds of lattices.
    parts = int(folded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(
        run, "word string, c long, blocks array<long>, places array<int>")


def fit_pieces(words: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece weights after ``rounds`` of expectation and maximisation over the distinct training words.

    A word counts once however often it comes, as the lattice stands for words not seen. Each task adds up its words,
    Spark adds up the tasks by piece, and only the vocabulary's numbers reach the driver."""
    start = load(vocabulary).share
    weights = start
    for _ in range(rounds):
        now = weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = load(vocabulary)
            lattice.weigh(now)
            total = [0.0] * len(now)
            for b in batches:
                for word in b.column(0).to_pylist():
                    lattice.expect(word, total)
            total = np.array(total)
            used = np.flatnonzero(total)
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "uses"])

        uses = words.mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        weights = PRIOR_USES * start
        for r in uses:
            weights[r["piece"]] += r["uses"]
    return weights


def marginals(words: DataFrame, vocabulary: str, weights: np.ndarray) -> DataFrame:
    """(of_block, n, numbers): packed, for ``n`` places of a block, the training count of the word there and its log
    marginals under ``weights`` and under the existing scores."""
    def by_block(held: list) -> pa.RecordBatch:
        blocks, places, c, marginal, given = (np.concatenate(x) for x in zip(*held))
        ids, of = np.unique(blocks, return_inverse=True)
        order = np.argsort(of << 32 | places)
        ends = np.cumsum(np.bincount(of, minlength=len(ids)))
        told = np.empty(len(order), NUMBERS)
        for k, x in (("place", places), ("c", c), ("marginal", marginal), ("given", given)):
            told[k] = x[order]
        parts = np.split(told, ends[:-1])
        return pa.record_batch([pa.array(ids), pa.array([len(x) for x in parts], pa.int32()),
                                pa.array([pack(steps(x)) for x in parts], pa.binary())], names=["of_block", "n", "numbers"])

    def steps(told: np.ndarray) -> np.ndarray:
        told["place"][1:] = np.diff(told["place"])
        return told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = load(vocabulary)
        lattice.weigh(weights)
        held, n = [], 0
        for b in batches:
            if not len(b):
                continue
            both = np.array([lattice.under_both(w) for w in b.column(0).to_pylist()]).reshape(-1, 2)
            times = pc.list_value_length(b.column(2)).to_numpy()
            held.append((b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy().astype(np.int64),
                         *(np.repeat(x, times) for x in (b.column(1).to_numpy(), both[:, 0], both[:, 1]))))
            n += len(held[-1][0])
            if n >= HELD_PLACES:
                yield by_block(held)
                held, n = [], 0
        if held:
            yield by_block(held)

    return words.select("word", "c", "blocks", "places").mapInArrow(run, "of_block long, n int, numbers binary")


def score_documents(docs: DataFrame, vocabulary: str, train: Column) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score, lattice_score) for each row of ``docs``.

    ``train`` is a condition on doc_id; ``vocabulary`` the path of a SentencePiece model."""
    folded = save(blocks(docs.where("doc_id is not null").select("doc_id", "text", train.alias("train"))), "zstd")
    words = save(word_places(folded), "zstd")
    ends, in_docs = folded.select(F.explode(F.arrays_zip("train", "n_tokens")).alias("d")).agg(
        F.count_if(F.col("d.train")), F.coalesce(F.sum(F.when(F.col("d.train"), F.col("d.n_tokens"))), F.lit(0))).first()
    types, once, twice = words.agg(*[F.count_if(x) for x in (F.col("c") > 0, F.col("c") == 1, F.col("c") == 2)]).first()
    n, v = in_docs, types + (ends > 0)
    weights = fit_pieces(words.where("c > 0").select("word"), vocabulary)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5

    def logs(c: np.ndarray, base: np.ndarray) -> np.ndarray:
        if not n:
            return np.log10(np.maximum(base, 1e-300))
        return np.log10((np.maximum(c - discount, 0) + discount * v * base) / n)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {k: [] for k in ("doc_id", "train", "n_tokens", "n_known", "base_score", "score", "lattice_score")}
        held = sum(right["n"].to_pylist())
        c, log_marginal, given = np.zeros(held), np.zeros(held), np.zeros(held)
        for packed, size in zip(right["numbers"].to_pylist(), right["n"].to_pylist()):
            told = unpack(packed, size, NUMBERS)
            place = np.cumsum(told["place"], dtype=np.int64)
            c[place], log_marginal[place], given[place] = (told[k] for k in ("c", "marginal", "given"))
        plain = np.log10(c + 0.5)
        # a marginal too small for a double still counts in full where the word has no count
        with np.errstate(divide="ignore"):
            full = logs(c, (1 - END_SHARE) * np.exp(log_marginal))
        tail = log_marginal / math.log(10) + math.log10(1 - END_SHARE) + (math.log10(discount * v / n) if n else 0)
        full = np.where((c < 1) & (log_marginal < -600), tail, full)
        end_plain, end_full = math.log10(ends + 0.5), float(logs(np.array([float(ends)]), np.array([END_SHARE]))[0])
        norm = math.log10(n + 0.5 * (v + 1))
        for row in left.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            uses = unpack(row["uses"], int(sizes.sum()), USES)
            at, times = uses["place"], uses["times"]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            add = lambda x: np.bincount(owner, x[at] * times, len(sizes))
            tokens = np.array(row["n_tokens"], np.int64)
            got["doc_id"] += row["doc_ids"]
            got["train"] += row["train"]
            got["n_tokens"] += tokens.tolist()
            got["n_known"] += (add((c > 0).astype(float)).astype(np.int64) + (ends > 0)).tolist()
            got["base_score"] += (add(plain) + end_plain - tokens * norm).tolist()
            got["score"] += (add(full) + end_full).tolist()
            got["lattice_score"] += (add(given) / math.log(10)).tolist()
        return pa.table({**got, "train_tokens": [n] * len(got["doc_id"])}, schema=pa.schema([
            ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
            ("base_score", pa.float64()), ("score", pa.float64()), ("lattice_score", pa.float64()), ("train_tokens", pa.int64())]))

    told = marginals(words, vocabulary, weights)
    return folded.drop("words", "counts").groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(
        run, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, "
             "lattice_score double, train_tokens long")
