"""SimHash near-dedup with deletion-variant signatures.

Each text becomes a 64-bit fingerprint of its word shingles. Fingerprints that
differ in at most two bits are linked. The fingerprint is cut into only two
halves, so that of a linked pair one half differs by at most one bit. Every
distinct fingerprint is indexed by both halves and by each half with one bit
deleted (a wildcard); equal keys meet in a shuffle, and the full distance is
verified there:

- equal halves, the other halves differing in at most two bits;
- halves that differ in exactly the deleted bit, the other halves differing in
  at most one: only rows with the bit set meet rows without it.

A key that many fingerprints share (near copies of one text, boilerplate) is
not compared pair by pair. Its rows go to a second round that cuts the other
half again, into 16-bit quarters with the same deletion variants. What is left
free there is 16 bits, so a bucket of the second round holds at most 2^18
fingerprints by construction, and neighbours are found by table look-up.

Within a bucket links are reduced to a star around the smallest member (same
components, fewer edges). Components are found by alternating large-star and
small-star rounds of joins, each saved in the shared folder.

Exact copies are one fingerprint from the start; their rows never meet pairwise.

Defined cases: a null or empty text, or one of white space only, has
fingerprint zero and is linked like any other; a text of fewer words than a
shingle is one shingle; rows with a null doc_id are left out; rows that repeat
a doc_id are returned as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

SEED = 42
CHUNK = 1 << 15  # shingles whose bits are counted at once
PAIRWISE = 256  # a bucket up to this size is compared pairwise, a larger one in the second round
HALF = 32


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint; repeats of a shingle count."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        ends, starts = [len(joined)], [0]
    else:
        length = np.fromiter((len(w) for w in words), np.int64, len(words)) + 1
        stop = np.cumsum(length)
        ends = (stop[shingle - 1:] - 1).tolist()
        starts = (stop - length)[:len(words) - shingle + 1].tolist()
    digest, total, ones = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fp = np.fromiter((simhash(t.as_py(), shingle) for t in texts), np.uint64, len(b)).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fp long")


# Index rows: tag (which part, which deleted bit), the part's value, the bit, what is left free, the node.

def _variants(value: np.ndarray, bits: int, deletions: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(deleted bit or ``bits`` for none, value without that bit, that bit)."""
    yield bits, value, np.zeros(len(value), np.uint8)
    if deletions:
        for j in range(bits):
            yield j, value & ~np.uint64(1 << j), ((value >> np.uint64(j)) & np.uint64(1)).astype(np.uint8)


def first_index(nodes: DataFrame) -> DataFrame:
    """66 rows of (key, bit, free, node) for each (fp, node)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 2000) for i in range(0, len(big), 2000)):
                fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                node = b.column(1).to_numpy(zero_copy_only=False)
                low, high = fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(HALF)
                key, bit, free = [], [], []
                for part, own, other in ((0, low, high), (1, high, low)):
                    for j, v, one in _variants(own, HALF, True):
                        key.append(v | np.uint64((part * (HALF + 1) + j) << HALF))
                        bit.append(one)
                        free.append(other)
                yield pa.record_batch([
                    pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(bit).view(np.int8)),
                    pa.array(np.concatenate(free).view(np.int64)), pa.array(np.tile(node, len(key)))],
                    names=["key", "bit", "free", "node"])

    return nodes.mapInArrow(run, "key long, bit byte, free long, node long")


def deleted(key: np.ndarray) -> np.ndarray:
    """Whether a first-round key has a deleted bit."""
    return (key >> HALF) % (HALF + 1) != HALF


def star(labels: np.ndarray, near) -> np.ndarray:
    """Smallest label that each member reaches; ``near`` maps labels to the smallest label among neighbours."""
    while True:
        new = np.minimum(labels, near(labels))
        if (new == labels).all():
            return new
        labels = new


def pairwise(bit: np.ndarray, free: np.ndarray, node: np.ndarray, wild: bool) -> np.ndarray:
    d = np.bitwise_count(free[:, None] ^ free[None, :])
    link = (d <= 1) & (bit[:, None] != bit[None, :]) if wild else d <= 2
    big = np.iinfo(np.int64).max
    return star(node, lambda lab: np.where(link, lab[None, :], big).min(axis=1))


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Column arrays of rows sorted by their first ``n_keys`` columns, with the run starts; no run is cut
    unless it exceeds ``PAIRWISE`` rows in its batch, and the caller then treats each part as hot."""
    left: list[np.ndarray] | None = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if left is not None:
            cols = [np.concatenate(x) for x in zip(left, cols)]
        if not len(cols[0]):
            continue
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:n_keys]])) + 1
        cut = int(new[-1]) if len(new) else 0
        left = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols], np.concatenate([[0], new[:-1]])
    if left is not None and len(left[0]):
        yield left, np.array([0])


def _edges(a, b) -> pa.RecordBatch:
    n = len(a)
    return pa.record_batch([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)),
                            pa.nulls(n, pa.int64()), pa.nulls(n, pa.int8()), pa.nulls(n, pa.int64())],
                           names=["u", "v", "key", "bit", "free"])


def _deferred(node, key, bit, free) -> pa.RecordBatch:
    return pa.record_batch([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(key), pa.array(bit), pa.array(free)],
                           names=["u", "v", "key", "bit", "free"])


def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of small buckets; rows (u, null, key, bit, free) of large ones, passed on in bounded pieces."""
    left: list[np.ndarray] | None = None
    hot: int | None = None  # the key whose rows are being passed on
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if left is not None:
            cols = [np.concatenate(x) for x in zip(left, cols)]
        key = cols[0]
        if not len(key):
            continue
        start = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        size = np.diff(np.append(start, len(key)))
        # the last run may go on in the next batch; a hot one is passed on as it comes
        done = len(start) - 1
        if size[-1] > PAIRWISE or key[-1] == hot:
            left = None
            done = len(start)
        else:
            left = [c[start[-1]:] for c in cols]
        last = int(key[-1])
        yield from _linked(cols, start[:done], size[:done], hot)
        hot = last if left is None else None
    if left is not None:
        yield from _linked(left, np.array([0]), np.array([len(left[0])]), None)


def _linked(cols: list[np.ndarray], start: np.ndarray, size: np.ndarray, hot: int | None) -> Iterator[pa.RecordBatch]:
    key, bit, free, node = cols
    large = (size > PAIRWISE) | ((key[start] == hot) if hot is not None and len(start) else False)
    two = start[(size == 2) & ~large]
    if len(two):
        d = np.bitwise_count(free[two] ^ free[two + 1])
        ok = np.where(deleted(key[two]), (d <= 1) & (bit[two] != bit[two + 1]), d <= 2)
        two = two[ok]
        if len(two):
            yield _edges(np.maximum(node[two], node[two + 1]), np.minimum(node[two], node[two + 1]))
    u, v = [], []
    for s, n in zip(start[(size > 2) & ~large], size[(size > 2) & ~large]):
        at = slice(s, s + n)
        lab = pairwise(bit[at], free[at], node[at], bool(deleted(key[s:s + 1])[0]))
        moved = lab != node[at]
        u.append(node[at][moved])
        v.append(lab[moved])
    if u:
        yield _edges(np.concatenate(u), np.concatenate(v))
    for s, n in zip(start[large], size[large]):
        at = slice(s, s + n)
        yield _deferred(node[at], key[at], bit[at], free[at])


QUARTER = 16


def second_index(rows: DataFrame) -> DataFrame:
    """Rows of large first-round buckets, keyed once more by quarters of their free half."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 4000) for i in range(0, len(big), 4000)):
                node, key, bit, free = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                wild, free = deleted(key), free.view(np.uint64)
                low, high = free & np.uint64(0xFFFF), free >> np.uint64(QUARTER)
                for part, own, other in ((0, low, high), (1, high, low)):
                    for j, value, one in _variants(own, QUARTER, True):
                        # where the first half already differs by one bit, one quarter of the other must be equal
                        use = np.ones(len(key), bool) if j == QUARTER else ~wild
                        if use.any():
                            tag = (part * (QUARTER + 1) + j) << QUARTER
                            yield pa.record_batch([
                                pa.array(key[use]), pa.array((value[use] | np.uint64(tag)).view(np.int64)),
                                pa.array((bit[use] + 2 * one[use].view(np.int8)).astype(np.int8)),
                                pa.array(other[use].view(np.int64)), pa.array(node[use])],
                                names=["key", "sub", "bits", "free", "node"])

    return rows.mapInArrow(run, "key long, sub long, bits byte, free long, node long")


def _masks(distance: int) -> list[int]:
    return [m for m in range(1 << QUARTER) if m.bit_count() <= distance]


def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of second-round buckets by table look-up over the 16 free bits."""
    big = np.iinfo(np.int64).max
    one, two = np.array(_masks(1)), np.array(_masks(2))
    for cols, start in runs(batches, 2):
        key, sub, bits, free, node = cols
        stop = np.append(start[1:], len(key))
        for s, e in zip(start, stop):
            if e - s < 2:
                continue
            lab, value, side, n = node[s:e], free[s:e], bits[s:e], node[s:e]
            wild_first, wild_second = bool(deleted(key[s:s + 1])[0]), (int(sub[s]) >> QUARTER) % (QUARTER + 1) != QUARTER
            # a wildcard links opposite sides only and uses up one bit of the distance
            flip = (1 if wild_first else 0) + (2 if wild_second else 0)
            masks = two if flip == 0 else one
            table = np.full((4, 1 << QUARTER), big, np.int64)

            def near(labels):
                table[side, value] = labels
                best = labels
                for m in masks:
                    best = np.minimum(best, table[side ^ flip, value ^ m])
                return best

            lab = star(lab, near)
            moved = lab != n
            if moved.any():
                yield pa.record_batch([pa.array(n[moved]), pa.array(lab[moved])], names=["u", "v"])


def links(nodes: DataFrame) -> DataFrame:
    """Distinct links (u, v), u > v, that connect the same nodes as all links within two bits do."""
    keyed = first_index(nodes).repartition("key").sortWithinPartitions("key")
    found = save(keyed.mapInArrow(first_round, "u long, v long, key long, bit byte, free long"))
    near = found.where("v is not null").select("u", "v")
    far = found.where("v is null").select(F.col("u").alias("node"), "key", "bit", "free")
    far = second_index(far).repartition("key", "sub").sortWithinPartitions("key", "sub")
    return near.union(far.mapInArrow(second_round, "u long, v long")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that reaches a smaller one: root is the smallest reachable.

    Rounds of large-star (every larger neighbour is hung under the smallest)
    and small-star (so is every smaller one) until nothing changes; the edges
    are then (node, root). Each round is saved, so a lost executor costs one round.
    """
    edges = save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = save(small.select("e.u", "e.v").where("u <> v").distinct())
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links of at most two bits."""
    fps = save(fingerprints(docs, shingle))
    nodes = save(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = components(links(nodes))
    member = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(member, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
