"""Alignment of two tokenizers' tokens over the same bytes.

Every text is encoded by a byte-level BPE (A, given blank + text) and by a
sentencepiece model (B, which puts the blank itself). Where tokens of both end
at the same byte there is a cut and the two tokens are linked; between cuts lie
groups of tokens.

Merging is in lockstep. The tokens of a batch of documents lie one after
another, with their ends counted over the whole batch. One NumPy vector of A
pointers and one of B pointers, with an entry for each document, advance
together: in each step every pointer at the smaller end moves on, where both
ends are equal a link and a cut are emitted and both move; documents that are
through are compacted away. A long document takes an entry for every ``LANE``
tokens, each with its own part of the bytes, so no batch waits for its longest
document. Cuts are the common ends, so they do not depend on the lanes.

Links are counted by pairs of ids over the whole corpus: documents are put
into blocks of about a million links, a block brings one row per distinct pair, and
the totals come back to the blocks by a join on the pair. No row per link is
shuffled, no pair's rows outnumber the blocks, and no table of pairs is sent
to the driver or to all tasks. One Python process per task encodes, aligns and
fills the blocks, in which the links are compressed, so that rows stay small.

Defined cases: texts that are null or empty, or that a tokenizer does not give
back byte for byte (B's normaliser may change them) have no tokens: empty
lists, counts of zero and an empty string for the groups. Rows with a null
doc_id are left out; repeated rows are aligned each; an empty table gives no
rows; other columns do not matter. Long texts are encoded by B in parts cut at
blanks, which no piece spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import byte_tokenizer, piece_model
from .common import save

LANE = 256
BATCH_CHARS = 1 << 19
PART = 1 << 20  # characters that B encodes at once
BLOCK = 1 << 20  # links of a block, unless one document has more
ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, link_a array<int>, link_b array<int>, cuts array<long>"

_ZSTD = pa.Codec("zstd", compression_level=1)
_BLANK = re.compile("(?<=[!-~À-ɏ])(?= .)", re.DOTALL)  # a lone blank at the end would be an empty part


class PieceBytes:
    """Encoder of a sentencepiece model and the bytes of its pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            m = piece_model.parse_model(f.read())
        inner = re.compile(f"[^{piece_model.MARK}]{piece_model.MARK}")
        if not m.dummy_prefix or any(inner.search(p) for p, t in zip(m.pieces, m.types) if t == piece_model.NORMAL):
            raise ValueError("B must put a blank before a text and have no piece with a marker after another character")
        self.library = piece_model.library(path)
        self.tokens = [bytes([int(p[3:5], 16)]) if t == piece_model.BYTE else p.replace(piece_model.MARK, " ").encode()
                       for p, t in zip(m.pieces, m.types)]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if max(map(len, texts), default=0) <= PART:
            return self.library.encode(texts, num_threads=1)
        return [[*chain.from_iterable(self.library.encode(p, num_threads=1) for p in self._parts(t))] for t in texts]

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """Parts cut before a blank, which the model puts back."""
        at = 0
        while len(text) - at > PART and (m := _BLANK.search(text, at + PART)):
            yield text[at:m.start()]
            at = m.start() + 1
        yield text[at:]


@lru_cache(maxsize=4)
def pieces(path: str) -> PieceBytes:
    return PieceBytes(path)


def lockstep(end_a: np.ndarray, end_b: np.ndarray, docs_a: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked A and B tokens, in order.

    ``end_a`` and ``end_b`` are the tokens' ends over the whole batch, ``docs_a`` the places in ``end_a`` where
    documents begin, and the number of tokens. Tokens are not empty, and every document ends at a common byte."""
    sizes = np.diff(docs_a)
    lanes = -(-sizes // lane)
    first = np.repeat(docs_a[:-1], lanes) + lane * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop_a = np.minimum(first + lane, np.repeat(docs_a[1:], lanes))
    before = np.concatenate([[0], end_a])
    a, b = first, np.searchsorted(end_b, before[first], side="right")
    stop_b = np.searchsorted(end_b, before[stop_a], side="right")
    links_a, links_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while True:
        open_ = (a < stop_a) & (b < stop_b)
        if not open_.all():
            a, b, stop_a, stop_b = a[open_], b[open_], stop_a[open_], stop_b[open_]
        if not len(a):
            break
        ends_a, ends_b = end_a[a], end_b[b]
        linked = ends_a == ends_b
        links_a.append(a[linked])
        links_b.append(b[linked])
        a, b = a + (ends_a <= ends_b), b + (ends_b <= ends_a)
    a, b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(a)
    return a[order], b[order]


def _joined(tokens: list[bytes], ids) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def align_texts(texts: list[str | None], a: byte_tokenizer.ByteTokenizer, b: PieceBytes) -> list[pa.Array]:
    """The columns of ``ALIGNED`` after doc_id."""
    ids_b = b.encode([t or "" for t in texts])
    all_a, all_b = [], []
    for t, own_b in zip(texts, ids_b):
        raw = (" " + t).encode() if t else b""
        own_a = a.encode(" " + t) if t else ()
        good = bool(t) and _joined(b.tokens, own_b) == raw and _joined(a.tokens, own_a.tolist()) == raw
        all_a.append(own_a if good else np.empty(0, np.uint32))
        all_b.append(np.array(own_b if good else [], np.int64))
    docs_a, docs_b = (np.cumsum([0, *map(len, x)]) for x in (all_a, all_b))
    flat_a, flat_b = np.concatenate(all_a).astype(np.int64), np.concatenate(all_b)
    end_a, end_b = np.cumsum(a.lengths[flat_a]), np.cumsum(b.lengths[flat_b])
    link_a, link_b = lockstep(end_a, end_b, docs_a)
    docs_l = np.searchsorted(link_a, docs_a)
    of = np.repeat(np.arange(len(texts)), np.diff(docs_l))
    begins = np.concatenate([[0], end_a])[docs_a]

    def lists(offsets, values, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    return [lists(docs_a, flat_a, pa.int32()), lists(docs_b, flat_b, pa.int32()),
            lists(docs_l, link_a - docs_a[of], pa.int32()), lists(docs_l, link_b - docs_b[of], pa.int32()),
            lists(docs_l, end_a[link_a] - begins[of], pa.int64())]


def _batches(texts: Iterator[str | None], chars: int) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size > chars or len(held) >= 5000:
            yield held
            held, size = [], 0
    if held:
        yield held


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _aligned(batches: Iterator[pa.RecordBatch], a: byte_tokenizer.ByteTokenizer, b: PieceBytes) -> Iterator[pa.RecordBatch]:
    """``ALIGNED`` of batches of (doc_id, text)."""
    for batch in batches:
        at = 0
        for texts in _batches((v.as_py() for v in batch.column(1)), BATCH_CHARS):
            yield pa.record_batch([batch.column(0).slice(at, len(texts)), *align_texts(texts, a, b)],
                                  names=["doc_id", "a_ids", "b_ids", "link_a", "link_b", "cuts"])
            at += len(texts)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, link_a, link_b, cuts) of every document.

    ``link_a`` and ``link_b`` are the places of linked tokens in ``a_ids`` and ``b_ids``, ``cuts`` the bytes of
    blank + text at which they end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _aligned(batches, byte_tokenizer.load(a_path), pieces(b_path))

    return _texts(docs).mapInArrow(run, ALIGNED)


def _decimals(size: int, signs: str) -> np.ndarray:
    """Row 2 * id + k: the id in decimal digits and the k-th sign, filled up with zero bytes."""
    width = len(str(size)) + 1
    table = np.zeros((2 * size, width), np.uint8)
    for k, sign in enumerate(signs):
        rows = np.array([f"{i}{sign}" for i in range(size)], f"S{width}")
        table[k::2] = rows.view(np.uint8).reshape(size, width)
    return table


def group_texts(a_ids, b_ids, link_a, link_b, tables) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` of all tokens, and where each link's group ends in it. All places are the batch's."""
    n_a, n_b, n = len(a_ids), len(b_ids), len(link_a)
    last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    last_a[link_a], last_b[link_b] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    # before an A token lie the B tokens of earlier groups, before a B token the A tokens up to its own group
    ends_b, ends_a = np.concatenate([[0], link_b + 1]), link_a + 1
    code = np.empty((n_a + n_b, tables[0].shape[1]), np.uint8)
    code[np.arange(n_a) + ends_b[group_a]] = tables[0][2 * a_ids + last_a]
    code[np.arange(n_b) + ends_a[group_b]] = tables[1][2 * b_ids + last_b]
    used = code != 0
    sizes = np.cumsum(used.sum(axis=1))
    return code[used].tobytes(), sizes[link_a + link_b + 1] if n else np.empty(0, np.int64)


def _packed(places: np.ndarray, n_pairs: int) -> bytes:
    """Places among ``n_pairs`` pairs, in as few bytes each as hold them, compressed."""
    return _ZSTD.compress(places.astype(_place(n_pairs)).tobytes(), asbytes=True)


def _unpacked(packed: bytes, n: int, n_pairs: int) -> np.ndarray:
    kind = np.dtype(_place(n_pairs))
    return np.frombuffer(_ZSTD.decompress(packed, n * kind.itemsize, asbytes=True), kind) if n else np.empty(0, kind)


def _place(n_pairs: int) -> str:
    return "<u2" if n_pairs <= 1 << 16 else "<u4"


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of about ``BLOCK`` links of ``align``: the documents' digests, the distinct pairs with their counts, and for
    each link, document by document, the place of its pair (``_packed``).

    The aligned lists are read in the process that made them: a second one for each task, and their way there through
    the executor, would take as much memory again."""
    schema = ("block long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, "
              "pairs array<long>, counts array<long>, places binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_tokenizer.load(a_path), pieces(b_path)
        a_size, b_size = len(a.tokens), len(b.tokens)
        width = max(len(str(a_size)), len(str(b_size))) + 1
        tables = [np.pad(t, ((0, 0), (0, width - t.shape[1])))
                  for t in (_decimals(a_size, ",|"), _decimals(b_size, ",;"))]
        part, number = TaskContext.get().partitionId(), 0
        docs: list[dict] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            pairs, places, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            kind = pa.struct([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                              ("groups_sha256", pa.string())])
            return pa.record_batch(
                [pa.array([part << 32 | number], pa.int64()), pa.array([docs], pa.list_(kind)),
                 pa.array([pairs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([_packed(places, len(pairs))], pa.binary())],
                names=["block", "docs", "pairs", "counts", "places"])

        for whole in _aligned(batches, a, b):
            for batch in _sliced(whole):
                ids, offsets = batch.column(0).to_pylist(), []
                values = []
                for c in range(1, 5):
                    column = batch.column(c)
                    values.append(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                    offsets.append(column.offsets.to_numpy().astype(np.int64))
                    offsets[-1] -= offsets[-1][0]
                at_a, at_b, at_l = offsets[:3]
                of = np.diff(at_l)
                link_a, link_b = values[2] + np.repeat(at_a[:-1], of), values[3] + np.repeat(at_b[:-1], of)
                text, ends = group_texts(values[0], values[1], link_a, link_b, tables)
                codes = values[0][link_a] << 32 | values[1][link_b]
                start = 0
                for i, doc in enumerate(ids):
                    n = int(of[i])
                    stop = int(ends[at_l[i + 1] - 1]) if n else start
                    docs.append({"doc_id": doc, "n_a": int(at_a[i + 1] - at_a[i]), "n_b": int(at_b[i + 1] - at_b[i]),
                                 "n_groups": n, "n_links": n,
                                 "groups_sha256": hashlib.sha256(text[start:stop - 1]).hexdigest() if n else ""})
                    held.append(codes[at_l[i]:at_l[i + 1]])
                    start, size = stop, size + n
                    if size > BLOCK or len(docs) > 50_000:
                        yield flush()
                        docs, held, size, number = [], [], 0, number + 1
        if docs:
            yield flush()

    return _texts(docs).mapInArrow(run, schema)


def _sliced(batch: pa.RecordBatch, tokens: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of about so many A tokens."""
    ends = batch.column(1).offsets.to_numpy().astype(np.int64)
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + tokens)) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def pair_totals(pairs: DataFrame) -> DataFrame:
    """(pair, total, best): a pair's links in the corpus, and whether no A id has more with its B id.

    ``pairs``: (pair, n). A window holds one B id's pairs, no more than A has ids."""
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return totals.withColumn("best", F.col("total") == F.max("total").over(of_b))


def digest(made: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document of saved ``blocks``."""
    listed = made.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p")).select(
        "block", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    totals = save(pair_totals(listed.select("pair", "n")))
    back = listed.select("block", "place", "pair").join(totals, "pair").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("place", "total", "best"))).alias("found"))
    both = made.select("block", "docs", "places").join(back.hint("shuffle_hash"), "block", "left").select(
        "docs", "places", F.col("found.total").alias("total"), F.col("found.best").alias("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                docs = pa.Table.from_struct_array(batch.column(0).slice(i, 1).flatten())
                total, best = (batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
                ends = np.cumsum([0, *docs["n_links"].to_pylist()])
                places = _unpacked(batch.column(1)[i].as_py(), int(ends[-1]), len(total))
                sums = np.concatenate([[0], np.cumsum(total.astype(np.int64)[places])])
                bests = np.concatenate([[0], np.cumsum(best.astype(np.int64)[places])])
                columns = {c: docs[c].combine_chunks() for c in docs.column_names}
                columns |= {"n_best": pa.array(np.diff(bests[ends])), "count_sum": pa.array(np.diff(sums[ends]))}
                yield pa.record_batch([columns[c] for c in names], names=names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return both.mapInArrow(run, ", ".join(f"{c} long" for c in names[:-1]) + ", groups_sha256 string")


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The digests of ``align``, with the corpus-wide counts of the links' id pairs."""
    return digest(save(blocks(docs, a_path, b_path), "zstd"))
