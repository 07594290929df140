"""Best-fit packing of tokenised documents into sequences of a fixed length.

A document's ids are the tokenizer's, then one end id. Only documents longer
than a sequence are cut, from the end, so that the first piece may be shorter.
Pieces are placed by best-fit decreasing: longest first, each into the open
sequence with the least room that still takes it, else into a new one.

Pieces of one length are interchangeable, so the packing is planned on the
counts by length: at most ``capacity`` numbers whatever the corpus size. The
plan finds the tightest open room with a segment tree over rooms, in
logarithmic time, and fills all sequences of that room at once. It equals
best-fit decreasing on the single pieces. Sequences are kept as ranges of
equal room; a length splits at most one range per step, so the plan is a
short table whose size does not depend on the number of documents, and it may
go to every task. Pieces then only need their rank within their length, which
comes from counts by (length, salt) and a window inside each such group, so a
length that a third of all pieces share is spread over ``SALTS`` tasks.

Defined cases: a null text is empty, and an empty text is the end id alone;
rows with a null doc_id are left out; rows that repeat a doc_id are packed
each; an empty table gives no pieces. The strings of special tokens in a text
are ordinary text. Texts are encoded whole, whatever their script; between the
steps ids take two bytes where the vocabulary allows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import byte_tokenizer
from .common import save

SALTS = 256

@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def id_type(tokenizer_path: str, end_id: int) -> str:
    """The smallest type for the ids: two bytes do for most vocabularies."""
    return "<u2" if max(len(byte_tokenizer.load(tokenizer_path).tokens), end_id + 1) <= 1 << 16 else "<u4"


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
                    with_ids: bool = True, kind: str = "<u4") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece, ids being little-endian numbers of ``kind``.

    ids_crc32 is that of 32-bit numbers, whatever ``kind`` is."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:None if with_ids else -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_tokenizer.load(tokenizer_path)
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(tokenizer.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    got = ids[start:first if not start else start + capacity]
                    raw = got.tobytes()
                    rows.append((doc, piece, start, len(got), zlib.crc32(raw), raw if kind == "<u4" else got.astype(kind).tobytes()))
                    held += len(got)
                    if held > 1 << 20 or len(rows) > 20_000:
                        yield _pieces(rows, names)
                        rows, held = [], 0
            if rows:
                yield _pieces(rows, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, schema)


def _pieces(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(list(c), t) for c, t, _ in zip(zip(*rows), types, names)], names=names)


class RoomTree:
    """Segment tree over rooms 0..capacity; a node tells whether any room below it has an open sequence."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.size)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest open room of at least ``need``."""
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces per sequence, offset) in order of length and rank.

    From its first rank on, a row's pieces fill consecutive sequences, so many each, from the offset on.
    """
    tree, rooms, rows, sequences = RoomTree(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                at, n = sequences, -(-left // each)
                sequences += n
            else:
                each = room // length
                at, have = rooms[room].pop()
                n = min(have, -(-left // each))
                if n < have:
                    rooms[room].append((at + n, have - n))
                elif not rooms[room]:
                    tree.set(room, False)
            placed = min(left, n * each)
            rows.append((length, rank, at, each, capacity - room))
            full, rest = divmod(placed, each)
            for start, number, used in ((at, full, each), (at + full, 1 if rest else 0, rest)):
                if number and (now := room - used * length) > 0:
                    rooms.setdefault(now, []).append((start, number))
                    tree.set(now, True)
            rank, left = rank + placed, left - placed
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any other columns) with sequence_id and offset.

    ``pieces`` is read twice: save it first if it is costly.
    """
    salted = pieces.drop("sequence_id", "offset").withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    groups = save(salted.groupBy("length", "__salt").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(n > capacity or n < 1 for n in counts):
        raise ValueError(f"piece lengths must lie in 1..{capacity}")
    table = plan(counts, capacity)
    before = groups.withColumn("__before", F.sum("n").over(
        Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))).select(
        "length", "__salt", F.coalesce("__before", F.lit(0)).alias("__before"))
    ranked = salted.withColumn("__in", F.row_number().over(
        Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")) - 1).join(before, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__in") + F.col("__before")).drop("__in", "__before", "__salt")
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    schema = ranked.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.int64(1) << 44
        keys = table[:, 0] * span + table[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            row = table[np.searchsorted(keys, length * span + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.record_batch([*[b.column(c) for c in names], pa.array(row[:, 2] + nth // row[:, 3]),
                                   pa.array(row[:, 4] + nth % row[:, 3] * length)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def _placed(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> tuple[DataFrame, str]:
    """Every piece with its place and, last, its ids as bytes, and their type.

    Ids are not sorted: pieces are placed without them, and the places meet the saved ids by the number of the
    piece's row, as a doc_id may come more than once."""
    kind = id_type(tokenizer_path, end_id)
    pieces = save(tokenize_pieces(docs, tokenizer_path, capacity, end_id, kind=kind).withColumn(
        "__row", F.monotonically_increasing_id()), "zstd")
    placed = place(pieces.drop("ids"), capacity)
    # The places are the small side of each partition; hashing them spares a sort of the ids.
    return pieces.select("__row", "ids").join(placed.hint("shuffle_hash"), "__row").select(
        *[c for c in placed.columns if c != "__row"], "ids"), kind


def _with_ids(packed: DataFrame, example, convert) -> DataFrame:
    """``packed`` with its last column, ids as bytes, converted: ``convert`` takes a list of bytes and gives an array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 1000) for b in batches for i in range(0, len(b), 1000)):
            raw = [v.as_py() for v in b.column(b.num_columns - 1)]
            yield pa.record_batch([*b.columns[:-1], convert(raw)], names=b.schema.names)

    return packed.mapInArrow(run, packed.drop("ids").select("*", example.alias("ids")).schema)


def pack_bytes(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids.

    ``ids`` are bytes, little-endian 32-bit numbers."""
    packed, kind = _placed(docs, tokenizer_path, capacity, end_id)
    return _with_ids(packed, F.lit(b""), lambda raw: pa.array([np.frombuffer(r, kind).astype("<u4").tobytes() for r in raw], pa.binary()))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
                   with_ids: bool = True) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    ``ids`` is array<int>."""
    if with_ids:
        packed, kind = _placed(docs, tokenizer_path, capacity, end_id)

        def lists(raw: list[bytes]) -> pa.Array:
            ids = np.frombuffer(b"".join(raw), kind).astype(np.int32)
            ends = np.cumsum([0, *map(len, raw)]) // np.dtype(kind).itemsize
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))

        return _with_ids(packed, F.array(F.lit(0)), lists)
    return place(save(tokenize_pieces(docs, tokenizer_path, capacity, end_id, with_ids)), capacity)
