"""SentencePiece encoding and decoding on a tokenizers-library backend.

The model file is a protobuf message; its pieces, scores, types, normaliser
and trainer settings are read from the wire format directly and a tokenizer is
rebuilt from them: the normaliser (its character map, white-space rules, and
the metaspace marker for blanks and the dummy prefix), the model (unigram
scores, or merges in order of score for a BPE model) with byte fallback.
Decoding joins the bytes that the pieces stand for. Batches are encoded by several threads.

A piece never has the marker after another character (this is checked), so
no piece spans two words (each a run of markers and what follows), and a text's ids are its
words' ids. Words are encoded once and remembered, up to a bound in characters. Parity
is verified for every word of every text against the sentencepiece library; ids
are the rebuilt tokenizer's. Where the two ever differ the row is marked and has the
library's ids, so ids are always the model's own.

Defined cases: a null text is empty; an empty text has no ids; rows with a
null doc_id are left out; repeated rows are encoded each; an empty table gives
no rows; the ids of unknown characters are their UTF-8 bytes' pieces, or the
unknown piece in a model without byte pieces.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
# Fixed values of the format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

BATCH = 1 << 19
CACHED_CHARS = 1 << 22  # characters of words that a task remembers
LONG = 64  # words above so many characters are not remembered
JOINED = 500  # new words encoded as one text
THREADS = 2


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at:at + size]
        at += size


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse_blanks: bool = True
    mark_blanks: bool = True

    @property
    def unknown(self) -> int:
        return self.types.index(UNKNOWN)


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in fields(data):
        if number == 1:
            got = dict(fields(value))
            m.pieces.append(got[1].decode())
            m.scores.append(struct.unpack("<f", got.get(2, bytes(4)))[0])
            m.types.append(got.get(3, NORMAL))
        elif number == 2:
            got = dict(fields(value))
            m.kind, m.byte_fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
        elif number == 3:
            got = dict(fields(value))
            m.charsmap = got.get(2, b"")
            m.dummy_prefix, m.collapse_blanks, m.mark_blanks = (bool(got.get(i, 1)) for i in (3, 4, 5))
    return m


def bpe_merges(m: Model) -> list[tuple[str, str]]:
    """Pairs whose union is a piece, best score first. Of pieces of one score (runs of blanks), the library joins the
    leftmost pair first, so a run grows from the left: longer unions come before shorter ones."""
    known = {p: s for p, s, t in zip(m.pieces, m.scores, m.types) if t in (NORMAL, USER_DEFINED)}
    by_score: dict[float, list[str]] = {}
    for p, s in known.items():
        if len(p) > 1:
            by_score.setdefault(s, []).append(p)
    out = []
    for score in sorted(by_score, reverse=True):
        for p in sorted(by_score[score], key=lambda x: -len(x)):
            out += [(p[:i], p[i:]) for i in range(len(p) - 1, 0, -1) if p[:i] in known and p[i:] in known]
    return out


class Pieces:
    """Encoder and decoder rebuilt from a model file."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
        from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

        with open(path, "rb") as f:
            m = self.model = parse_model(f.read())
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, t in zip(m.pieces, m.types) if t == NORMAL):
            raise ValueError("a piece has the marker after another character: texts cannot be cut there")
        unknown = m.unknown
        if m.kind == UNIGRAM:
            core = models.Unigram(list(zip(m.pieces, m.scores)), unknown, m.byte_fallback)
        elif m.kind == BPE:
            core = models.BPE({p: i for i, p in enumerate(m.pieces)}, bpe_merges(m), unk_token=m.pieces[unknown],
                              fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are known")
        self.tokenizer = Tokenizer(core)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.collapse_blanks:
            steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Replace(Regex("^ | $"), "")]
        self.normaliser = normalizers.Sequence(steps)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall  # as the tokenizer cuts
        self._steps = bool(steps)
        self._bytes = [self._of(p, t) for p, t in zip(m.pieces, m.types)]

    def normalise(self, text: str) -> str:
        if self._steps:
            text = self.normaliser.normalize_str(text)
        if not text:
            return ""
        if self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.mark_blanks else text

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.encode_words([self.normalise(t) for t in texts])

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    @staticmethod
    def _of(piece: str, kind: int) -> bytes:
        """The bytes that a piece stands for in a text."""
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def decode(self, ids) -> str:
        m = self.model
        first = next((i for i in ids if m.types[i] != CONTROL), None)
        # the dummy prefix's blank, which only a piece's own marker stands for
        skip = int(m.dummy_prefix and first is not None and m.types[first] != UNKNOWN and m.pieces[first].startswith(MARK))
        return b"".join(map(self._bytes.__getitem__, ids)).decode(errors="one-byte")[skip:]


class WordCache:
    """Encodes texts word by word; words that come again are not encoded again.

    A word that was not met yet is encoded by the rebuilt tokenizer and by the library, and its ids
    are compared. No piece spans two words, so texts whose words agree agree as a whole."""

    def __init__(self, pieces: Pieces, library, threads: int = THREADS):
        self.pieces, self.library, self.threads = pieces, library, threads
        self.known: dict[str, bytes] = {}  # a word's ids as 32-bit numbers
        self.size = 0
        self.differ: set[str] = set()
        self.unknown = pieces.model.unknown
        self.lengths = np.array([len(b) for b in pieces._bytes], np.int64)
        self.simple = re.compile(f"{MARK}[^{MARK}]+").fullmatch

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """(ids, parity) of each text: the rebuilt tokenizer's ids, but the library's where the two differ."""
        cut = [self.pieces.words(self.pieces.normalise(t)) for t in texts]
        if self.size > CACHED_CHARS:
            self.known, self.size, self.differ = {}, 0, set()
        seen = set(chain.from_iterable(cut))
        new = list(seen.difference(self.known))
        self._learn([w for w in new if len(w) <= LONG and self.simple(w)], [w for w in new if len(w) > LONG or not self.simple(w)])
        find = self.known.__getitem__
        out = []
        for text, words in zip(texts, cut):
            good = not self.differ or self.differ.isdisjoint(words)
            ids = b"".join(map(find, words)) if good else np.array(self.library.encode(text), "<i4").tobytes()
            out.append((ids, good))
        for w in new:
            if len(w) > LONG:  # hardly comes again
                del self.known[w]
                self.differ.discard(w)
            else:
                self.size += len(w)
        return out

    def _library(self, words: list[str]) -> list[list[int]]:
        """The library's ids; it puts the first marker itself, but none before nothing: runs of markers follow an x."""
        drop = 1 if self.pieces.model.dummy_prefix else 0
        bare = [not w.strip(MARK) for w in words]
        texts = ["x" * b + w.replace(MARK, " ")[0 if b else drop:] for w, b in zip(words, bare)]
        before = len(self.library.encode("x")) if any(bare) else 0
        return [ids[before * b:] for ids, b in zip(self.library.encode(texts, num_threads=self.threads), bare)]

    def _learn(self, simple: list[str], others: list[str]) -> None:
        # words of one marker and text may stand next to each other in any order: many are encoded as one text
        groups = [simple[i:i + JOINED] for i in range(0, len(simple), JOINED)]
        for at in range(0, len(groups), 16):
            some = groups[at:at + 16]
            joined = ["".join(g) for g in some]
            for group, own, want in zip(some, self.pieces.encode_words(joined), self._library(joined)):
                ids = np.array(own, "<i4")
                ends = np.cumsum([len(w.encode()) - 2 for w in group])  # a marker stands for one byte
                total = np.cumsum(self.lengths[ids])
                if own != want or self.unknown in own or total[-1] != ends[-1]:  # one by one
                    others = others + group
                    continue
                stops = (4 * np.searchsorted(total, ends) + 4).tolist()
                raw = ids.tobytes()
                self.known.update(zip(group, [raw[a:b] for a, b in zip([0, *stops], stops)]))
        if others:
            for w, own, want in zip(others, self.pieces.encode_words(others), self._library(others)):
                self.known[w] = np.array(own, "<i4").tobytes()
                if own != want:
                    self.differ.add(w)


# As the library does, each byte that is no text becomes one replacement character.
codecs.register_error("one-byte", lambda e: ("\ufffd", e.start + 1))


@lru_cache(maxsize=4)
def load(path: str, threads: int = THREADS) -> Pieces:
    return Pieces(path, threads)


@lru_cache(maxsize=4)
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _groups(texts: Iterator[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size > BATCH:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, model_path: str, threads: int = THREADS) -> DataFrame:
    """(doc_id, ids, ids_crc32, parity); crc32 is over little-endian 32-bit ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(load(model_path, threads), library(model_path), threads)
        for b in batches:
            at = 0
            for group in _groups((v.as_py() or "") for v in b.column(1)):
                raw, parity = zip(*cache.encode(group))
                offsets = np.cumsum([0, *map(len, raw)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.record_batch([b.column(0).slice(at, len(group)), ids, pa.array([*map(zlib.crc32, raw)], pa.int64()),
                                       pa.array(parity)], names=["doc_id", "ids", "ids_crc32", "parity"])
                at += len(group)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids array<int>, ids_crc32 long, parity boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with ``text`` in place of any such column, from ``ids``."""
    base = encoded.drop("text")
    names, at = base.columns, base.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for b in batches:
            flat = b.column(at)
            texts = [pieces.decode(i.values.to_numpy(zero_copy_only=False).tolist() if i.is_valid else []) for i in flat]
            yield pa.record_batch([*b.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return base.mapInArrow(run, base.select("*", F.lit("").alias("text")).schema)
