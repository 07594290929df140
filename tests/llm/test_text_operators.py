"""Line dedup, SimHash near-dedup, quality rules and packing against brute-force versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from stockroom.llm import line_dedup, packing, quality_rules, simhash
from stockroom.llm.common import folded_key, save

from .conftest import ODD

WHITE = " \t\n\x0b\f\r"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words_of(text):
    return (text or "").encode().split()


def random_docs(n, seed):
    r = random.Random(seed)
    shared = ["  A line that MANY documents share, %d\t" % i for i in range(6)]
    out = []
    for i in range(n):
        lines = [" ".join(r.choice("alpha beta gamma Ä ö delta # | x".split()) for _ in range(r.randint(0, 12)))
                 for _ in range(r.randint(1, 6))]
        lines += r.sample(shared, r.randint(0, 4))
        r.shuffle(lines)
        out.append((i, "\n".join(lines)))
    return out


# ---------------------------------------------------------------- line dedup

def brute_lines(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    key = lambda line: ascii_lower(line.strip(WHITE))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)]) != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(docs_of, seed):
    rows = random_docs(60, seed) + [(1000, "A LINE THAT many documents share, 0\nÄ line with Umlaut Ä number 1"),
                                    (1001, "ä line with Umlaut Ä number 1"), (1002, "Ä LINE with Umlaut Ä number 1"),
                                    (1003, "Ä line with umlaut Ä number 1\r")]
    got = line_dedup.dedup_lines(docs_of(rows)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got)) == brute_lines(rows)


def test_lines_odd_rows_and_columns(docs_of, odd, spark):
    got = line_dedup.dedup_lines(odd.withColumn("n_lines", F.lit("mine")).withColumn("salt", F.lit(1)))
    assert got.columns == [*odd.columns, "salt", "n_lines", "n_dropped"]
    rows = [(i, t) for i, t in ODD if i is not None]
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect())) == brute_lines(rows)
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_repeated_rows_are_one_document(docs_of):
    line = "a line of more than twenty characters"
    assert {r.n_dropped for r in line_dedup.dedup_lines(docs_of([(1, line), (1, line), (2, line)])).collect()} == {0}
    got = line_dedup.dedup_lines(docs_of([(1, line), (1, "x\n" + line), (2, line), (3, line)])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, ""), (1, "x"), (2, ""), (3, line)]


def test_folded_key_is_ascii_lower(spark):
    r = random.Random(3)
    chars = "aAzZÄäÉéßÿŸİıΑαЖж€中\U0001f600×÷µ \x80߿ࠀ"
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 4))) for _ in range(3000)]
    keys = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(folded_key(F.col("t"))).collect()]
    assert len(set(keys)) == len({ascii_lower(t) for t in texts}) == len(set(zip(keys, map(ascii_lower, texts))))


# ---------------------------------------------------------------- SimHash

def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp, ids, distance=2):
    fp, root = np.array(fp, np.uint64), list(range(len(fp)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1:] ^ fp[i]) <= distance):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(fp)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low[find(i)] for i in range(len(fp))]


def test_fingerprints_and_components_of_odd_rows(odd):
    got = simhash.near_duplicates(odd.withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(0)), 3).collect()
    rows = [(i, t) for i, t in ODD if i is not None]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components(fps, [i for i, _ in rows])
    assert sorted((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in got) == sorted(
        (i, f, c) for (i, _), f, c in zip(rows, fps, want))
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_fingerprint_of_a_text_longer_than_a_chunk():
    r = random.Random(5)
    text = " ".join(str(r.random()) for _ in range(simhash.CHUNK + 500))
    assert simhash.simhash(text.encode()) == brute_fingerprint(text)


def clusters(r, sizes, flips):
    out = []
    for n in sizes:
        centre = r.getrandbits(64)
        for _ in range(n):
            x = centre
            for b in r.sample(range(64), r.randint(0, flips)):
                x ^= 1 << b
            out.append(x)
    return out


@pytest.mark.parametrize("sizes,flips", [([2] * 60 + [12] * 10, 3), ([700], 2), ([900], 5), ([400, 400], 9)])
def test_components_equal_brute_force(spark, sizes, flips):
    """Random clusters; the larger ones go through the second round."""
    r = random.Random(sum(sizes) + flips)
    fps = list(dict.fromkeys(clusters(r, sizes, flips) + [0, 2 ** 64 - 1, 1, 3]))
    ids = r.sample(range(10 ** 6), len(fps))
    nodes = spark.createDataFrame([(f - 2 ** 64 if f >= 2 ** 63 else f, i) for f, i in zip(fps, ids)], "fp long, node long")
    roots = {x.node: x.root for x in simhash.components(simhash.links(nodes)).collect()}
    assert [roots.get(i, i) for i in ids] == brute_components(fps, ids)


def test_second_round_alone_loses_no_link(spark, monkeypatch):
    """With every bucket taken as large, all links come from the second round."""
    r = random.Random(11)
    fps = list(dict.fromkeys(clusters(r, [30, 30, 40], 4)))
    ids = list(range(len(fps)))
    monkeypatch.setattr(simhash, "PAIRWISE", 0)
    index = pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64), "node": np.array(ids, np.int64)})
    import pyarrow as pa
    batch = pa.RecordBatch.from_pandas(index, preserve_index=False)
    keyed = simhash.first_index(spark.createDataFrame(index)).toPandas().sort_values("key", kind="stable")
    assert len(keyed) == 66 * len(fps)
    rows = [x for x in simhash.first_round(iter([pa.RecordBatch.from_pandas(keyed[["key", "bit", "free", "node"]].iloc[i:i + 97],
                                                                            preserve_index=False) for i in range(0, len(keyed), 97)]))]
    got = pa.Table.from_batches(rows).to_pandas()
    assert got.v.isna().all() and len(got) == len(keyed) and batch.num_rows == len(fps)
    far = spark.createDataFrame(got[["u", "key", "bit", "free"]].astype("int64"), "node long, key long, bit long, free long")
    second = simhash.second_index(far.select("node", "key", F.col("bit").cast("byte").alias("bit"), "free"))
    edges = second.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(simhash.second_round, "u long, v long")
    roots = {x.node: x.root for x in simhash.components(edges).collect()}
    assert [roots.get(i, i) for i in ids] == brute_components(fps, ids)


def test_long_chain_of_links(spark):
    """Each member differs from the next by two bits: one component."""
    fps, x = [], 0
    for b in range(0, 62, 2):
        fps.append(x)
        x ^= 3 << b
    nodes = spark.createDataFrame(list(zip(fps, range(50, 50 + len(fps)))), "fp long, node long")
    got = simhash.components(simhash.links(nodes)).collect()
    assert {r.root for r in got} == {50} and len(got) == len(fps) - 1


# ---------------------------------------------------------------- quality rules

def brute_measure(text):
    text = text or ""
    w = [x.decode() for x in text.encode().split()]
    seen = Counter(zip(w, w[1:], w[2:]))
    cover = {p for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover),
            n < 50 or 100 * len(cover) > 50 * n)


def test_measures_equal_brute_force(docs_of):
    r = random.Random(4)
    rows = [*ODD, *random_docs(40, 9)]
    for i, size in enumerate([3, 4, 60, 300, 2000]):
        rows.append((5000 + i, " ".join(r.choice("a b c d e f g h".split()) for _ in range(size))))
        rows.append((6000 + i, " ".join(str(r.randint(0, 40 * size)) for _ in range(size)) + " 1 2 3 4 1 2 3 4"))
    df = docs_of([x[:2] for x in rows]).withColumn("n_words", F.lit("mine"))
    got = quality_rules.measure(df).select("doc_id", *quality_rules.BASE).collect()
    assert sorted(map(tuple, got)) == sorted((i, *brute_measure(t)) for i, t in rows if i is not None)


def test_binomial_tail_is_exact(spark):
    cases = [(0, 1, 0.5), (0, 1500, 0.005), (3, 20, 0.3), (20, 20, 0.3), (7, 4000, 0.005), (400, 100_000, 0.005)]
    got = spark.createDataFrame(cases, "k long, n long, p double").select(
        "k", "n", "p", quality_rules.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("x")).collect()
    for r in got:
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1)
                            + i * math.log(r.p) + (r.n - i) * math.log1p(-r.p)) for i in range(r.k + 1))
        assert math.isclose(r.x, want, rel_tol=1e-8)


def test_cutoffs_follow_the_guarantee(spark):
    """A stratum with enough good documents gets cutoffs that reject few of them; a small one gets none."""
    r = random.Random(7)
    rows = []
    for i in range(6000):
        lang = "en" if i < 5000 else "xx"
        bad = i % 10 == 0
        rows.append((i, lang, 200, 1000, r.randint(30, 90) if bad else r.choice([0] * 2000 + [300]), 0, 0, False))
    df = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
                               "n_repeat_words long, base_failed boolean")
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1, 0) for i in range(6000)] + [(None, 1, 0), (1, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    cut = {(x.stratum, x.rule): x for x in quality_rules.cutoffs(df, labels).collect()}
    assert {s for s, _ in cut} == {"en"}
    assert cut["en", "symbols"].cutoff <= 0.15 and cut["en", "symbols"].good == 4500
    judged = quality_rules.judge(df, labels).join(labels.where("quality is not null"), "doc_id")
    share = {(x.lang, x.quality): x.k for x in judged.groupBy("lang", "quality").agg(
        F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share["en", 0] < 0.1 and share["en", 1] > 0.98 and share["xx", 0] == share["xx", 1] == 1


def test_rules_without_labels_or_rows(docs_of, odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    judged = quality_rules.judge(save(quality_rules.measure(odd)), none)
    assert {r.doc_id: r.kept for r in judged.collect()} == {
        i: not brute_measure(t)[5] for i, t in ODD if i is not None}
    assert quality_rules.judge(save(quality_rules.measure(odd.limit(0))), none).count() == 0


# ---------------------------------------------------------------- packing

def brute_best_fit(lengths, capacity):
    import bisect
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        room = rooms.pop(i) if i < len(rooms) else capacity
        n += room == capacity and i >= len(rooms)
        if room > x:
            bisect.insort(rooms, room - x)
    return n


def check_layout(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for got in by.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed,capacity", [(1, 20), (2, 64), (3, 100), (4, 2048)])
def test_placing_equals_best_fit_decreasing(spark, seed, capacity):
    r = random.Random(seed)
    lengths = [min(capacity, max(1, int(r.expovariate(3 / capacity)))) for _ in range(1500)] + [capacity // 3] * 300
    df = spark.createDataFrame([(i, 0, n, "x") for i, n in enumerate(lengths)], "doc_id long, piece int, length long, offset string")
    rows = packing.place(df, capacity).collect()
    assert sorted((x.doc_id, x.length) for x in rows) == list(enumerate(lengths))
    assert check_layout(rows, capacity) == brute_best_fit(lengths, capacity)


def test_tree_finds_the_tightest_room():
    r = random.Random(6)
    for capacity in (1, 7, 8, 100):
        tree, rooms = packing.RoomTree(capacity), set()
        for _ in range(300):
            room = r.randint(1, capacity)
            (rooms.add if (on := r.random() < 0.5) else rooms.discard)(room)
            tree.set(room, on)
            need = r.randint(1, capacity)
            assert tree.tightest(need) == min((x for x in rooms if x >= need), default=None)


def test_pieces_hold_all_ids(docs_of, odd):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(BYTE_BPE)
    whole.encode_special_tokens = True
    rows = packing.pack_documents(odd, BYTE_BPE, capacity=100, end_id=0).collect()
    check_layout(rows, 100)
    # a repeated doc_id's pieces come as often as its rows
    count = Counter(i for i, _ in ODD if i is not None)
    for i, t in {i: t for i, t in ODD if i is not None}.items():
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)[::count[i]]
        assert [x for r in own for x in r.ids] == ids
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert all(r.length == 100 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length for r in own)
    assert packing.pack_documents(odd.limit(0), BYTE_BPE).count() == 0


@pytest.mark.parametrize("end_id", [0, 70_000])
def test_ids_of_two_or_four_bytes(docs_of, end_id):
    tokenizer = packing.load_tokenizer(BYTE_BPE)
    r = random.Random(8)
    bits = ["word", " ", "  ", "\n", "9", "é", "'s", "!", "\u3000", "\x1c", "\x85", "\xa0", "\u200b", "漢", "\t", "<|endoftext|>"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 300)))) for i in range(100)] + [(100, "x y " * 50_000), (101, " ")]
    assert packing.id_type(BYTE_BPE, end_id) == ("<u4" if end_id else "<u2")
    own = defaultdict(list)
    for p in sorted(packing.pack_bytes(docs_of(rows), BYTE_BPE, 128, end_id).collect(), key=lambda p: p.piece):
        assert p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length
        own[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    assert own == {i: tokenizer.encode(t, add_special_tokens=False).ids + [end_id] for i, t in rows}


def test_digest_of_kept_text(docs_of):
    got = line_dedup.dedup_lines(docs_of([(1, "é\nx")])).select(F.sha2("text", 256).alias("s")).first()
    assert got.s == hashlib.sha256("é\nx".encode()).hexdigest()
