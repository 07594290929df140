"""Tokenizer backend, top-k, URL filter, WARC, language model, classifier and pipeline."""

import base64
import hashlib
import itertools
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from stockroom.llm import lattice_lm, packing, piece_model, pu_classifier, simhash, topk, url_filter, warc
from stockroom.llm.common import fold, save, table

from .conftest import ODD
from .test_text_operators import brute_best_fit, brute_components, brute_fingerprint, brute_lines, brute_measure, check_layout

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- SentencePiece

def rough_texts(n, seed):
    r = random.Random(seed)
    bits = ["the", "ing", " ", "  ", "   " * 7, " " * 31, "\n", "\t", "é", "ſ", "ﬁ", "漢字", "\U0001f600", "▁", "<s>", "<0x41>", "\x00",
            "xyzzy", "　", "aaaa", "123", "½"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_pieces_agree_with_the_library():
    own, pieces = piece_model.library(PIECES), piece_model.load(PIECES)
    texts = [*rough_texts(400, 1), "", " ", "a" * 5000, "word  and word " * 9000]
    ids = own.encode(texts)
    assert pieces.encode(texts) == ids
    assert [pieces.decode(i) for i in ids] == [own.decode(i) for i in ids]


def test_ids_that_are_no_text_decode_as_the_library_does():
    own, pieces = piece_model.library(PIECES), piece_model.load(PIECES)
    r = random.Random(6)
    for _ in range(300):
        ids = [r.choice([3 + r.randrange(256), 3 + 0xC3, r.randrange(300, 32_000), 0]) for _ in range(r.randint(0, 8))]
        assert pieces.decode(ids) == own.decode(ids)


def message(number, payload):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(payload, int):
        return varint(number << 3) + varint(payload)
    if isinstance(payload, float):
        return varint(number << 3 | 5) + struct.pack("<f", payload)
    return varint(number << 3 | 2) + varint(len(payload)) + payload


@pytest.mark.parametrize("collapse", [0, 1])
def test_a_unigram_model_agrees_with_the_library(tmp_path, collapse):
    r = random.Random(2)
    words = {"".join(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(60)} | set("abcde▁")
    words |= {"▁" + w for w in list(words) if w != "▁"}
    made = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    made += [(w, -1.0 - 7 * r.random(), 1) for w in sorted(words)]
    data = b"".join(message(1, message(1, p.encode()) + message(2, s) + message(3, t)) for p, s, t in made)
    data += message(2, message(3, 1) + message(35, 1)) + message(3, message(1, b"identity") + message(3, 1) + message(4, collapse))
    path = tmp_path / "unigram.model"
    path.write_bytes(data)
    own, pieces = piece_model.library(str(path)), piece_model.load(str(path))
    texts = ["".join(r.choice("abcde  ") for _ in range(r.randint(0, 30))) for _ in range(300)] + [" é a ", "a\n漢"]
    ids = own.encode(texts)
    assert pieces.encode(texts) == ids
    assert [pieces.decode(i) for i in ids] == [own.decode(i) for i in ids]


def test_encode_and_decode_odd_rows(odd):
    got = piece_model.decode(piece_model.encode(odd.withColumn("ids", F.lit("mine")), PIECES), PIECES).collect()
    own = piece_model.library(PIECES)
    want = sorted((i, own.decode(own.encode(t or ""))) for i, t in ODD if i is not None)
    assert sorted((r.doc_id, r.text) for r in got) == want and all(r.parity for r in got)
    source = {i: t or "" for i, t in ODD}
    assert all(r.ids == own.encode(source[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert piece_model.encode(odd.limit(0), PIECES).count() == 0


# ---------------------------------------------------------------- top-k

def brute_top(rows, is_query, k):
    clean = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        z = [math.floor(256 * x) for x in v]
        clean[i] = min(clean.get(i, z), z)
    out = []
    for q in filter(is_query, clean):
        scored = sorted((-sum(a * b for a, b in zip(clean[q], v)), i) for i, v in clean.items() if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_words_encode_as_the_whole(monkeypatch):
    own = piece_model.library(PIECES)
    monkeypatch.setattr(piece_model, "CACHED_CHARS", 300)
    monkeypatch.setattr(piece_model, "JOINED", 7)
    cache = piece_model.WordCache(piece_model.load(PIECES), own)
    r = random.Random(1)
    bits = ["the", " ", "  ", "▁", "▁▁", "中", "é", "\n", "\t", "<0x41>", "<s>", "x" * 70, "\x00", "a▁", " ▁b", "", "ﬁ", "Ａ", "\u3000", "\xa0"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(1000)] + ["x" * 300_000, "中" * 100_000]
    for i in range(0, len(texts), 50):
        some = texts[i:i + 50]
        assert [(np.frombuffer(a, "<i4").tolist(), good) for a, good in cache.encode(some)] == [(ids, True) for ids in own.encode(some)]
        assert not any(len(w) > piece_model.LONG for w in cache.known)


def test_a_word_that_differs_marks_its_texts():
    own, cache = piece_model.library(PIECES), None

    class Other(piece_model.Pieces):
        def encode_words(self, words):
            return [[5 if i == ids[-1] and "wrong" in w else i for i in ids] for w, ids in zip(words, super().encode_words(words))]

    cache = piece_model.WordCache(Other(PIECES), own)
    texts = ["all right", "this is wrong here", "right again"]
    got = cache.encode(texts)
    assert [good for _, good in got] == [True, False, True]
    assert [np.frombuffer(a, "<i4").tolist() for a, _ in got] == own.encode(texts)


@pytest.mark.parametrize("kind", ["dense", "sparse", "ties", "huge", "few"])
def test_top_k_equals_brute_force(spark, monkeypatch, kind):
    r = random.Random(kind)
    value = {"dense": lambda: r.gauss(0, 0.2), "sparse": lambda: r.random() if r.random() < 0.2 else 0.0,
             "ties": lambda: r.choice([0.0, 0.5]), "huge": lambda: r.gauss(0, 1e6), "few": r.random}[kind]
    rows = [(i, [value() for _ in range(12)]) for i in range(4 if kind == "few" else 400)]
    rows += [(500, None), (501, [0.1, None]), (502, [float("nan")]), (503, [float("inf")] * 12), (None, [1.0] * 12), (505, []),
             (506, [0.7, -0.3]), (507, [1.0] * 12), (507, [0.5] * 12), (550, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))
    monkeypatch.setattr(topk, "SHARD", 90)
    monkeypatch.setattr(topk, "BLOCK", 7)
    got = topk.top_k(df, F.col("vec_id") % 25 == 0, 5).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, lambda i: i % 25 == 0, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 25 == 0).count() == 0


def test_max_score_prunes_and_keeps_ties():
    r = np.random.default_rng(3)
    v = np.floor(r.normal(0, 40, (3000, 32)))
    v[100:200] = v[0]
    postings = np.ascontiguousarray(v.T)
    ids = r.permutation(3000)
    for q in (0, 1, 150):
        got, score = topk.max_score(v[q], postings, postings.min(axis=1), postings.max(axis=1), ids, ids[q], 5)
        full = v @ v[q]
        want = sorted((-full[i], ids[i]) for i in range(3000) if i != q)[:5]
        assert list(zip(-score, got)) == want


# ---------------------------------------------------------------- URL filter

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def urls(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def no_labels(spark):
    return spark.createDataFrame([], "page_id long, bad boolean")


def test_fixed_rules(spark):
    cases = {
        "http://a.NET/x": ("a.net", "/x", "net/", "block"), "http://net/": ("net", "/", "net/", "block"),
        "http://a.net": ("a.net", "", None, "allow"), "http://planet.x/": ("planet.x", "/", None, "allow"),
        "http://www.example.net/en/1": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "http://notexample.net/en/1": ("notexample.net", "/en/1", "net/", "block"),
        "https://example.com/de/?q=/": ("example.com", "/de/", "example.com/de/", "block"),
        "https://example.com/DE/": ("example.com", "/DE/", None, "allow"), "x.org/fr/": ("", "", None, "allow"),
        "ftp://b.org/fr/#://net/": ("b.org", "/fr/", "org/fr/", "allow"), "://net/a": ("net", "/a", "net/", "block"),
        "a?u=http://net/": ("net", "/", "net/", "block"), "http://e.net\n/x": ("e.net\n", "/x", None, "allow"),
        "http://ÄB.org?x": ("Äb.org", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow")}
    rows = [(i, u, None) for i, u in enumerate(cases)] + [(None, "http://net/", None), (0, "http://zzz/", None)]
    got = url_filter.filter_urls(urls(spark, rows).withColumn("rule", F.lit("mine")), no_labels(spark), RULES).collect()
    want = sorted([(i, *c) for i, c in enumerate(cases.values())] + [(0, "zzz", "", None, "allow")][:0] + [(0, "zzz", "/", None, "allow")], key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert url_filter.filter_urls(urls(spark, []), no_labels(spark), RULES).count() == 0


def test_mined_rules_block_what_they_match(spark):
    r = random.Random(5)
    rows, bad = [], []
    for i in range(1200):
        spam = i % 6 == 0
        host = r.choice(["free-bets", "casino"]) if spam else r.choice(["news", "blog", "free-books"])
        rows.append((i, f"http://{host}.example.com/{r.choice(['en', 'fr'])}/{i}?utm={i}", None))
        if i < 800:
            bad.append((i, spam if r.random() < 0.97 else not spam))
    got = url_filter.filter_urls(urls(spark, rows), spark.createDataFrame(bad + [(None, True), (3, None)], "page_id long, bad boolean"), RULES)
    verdict = {x.page_id: x.verdict for x in got.collect()}
    assert all(v == ("block" if i % 6 == 0 else "allow") for i, v in verdict.items()) and len(verdict) == 1200


def test_mined_rules_equal_enumeration(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(7)]
    baskets = [(i, sorted(w for w in words if r.random() < 0.5), r.random() < 0.4) for i in range(300)]
    baskets = [(i, w, b or {"w0", "w1"} <= set(w)) for i, w, b in baskets]
    rules = {}
    for n in range(1, 8):
        for c in itertools.combinations(words, n):
            held = [b for _, w, b in baskets if set(c) <= set(w)]
            if sum(held) >= 15 and sum(held) / len(held) >= 0.6:
                rules[c] = sum(held) / len(held)
    want = {c for c, x in rules.items() if not any(set(o) < set(c) and y >= x for o, y in rules.items())}
    df = spark.createDataFrame(baskets, "page_id long, tokens array<string>, bad boolean")
    mined = save(url_filter.mine(df, min_support=0.0, min_count=15, min_confidence=0.6))
    assert {tuple(x.words) for x in mined.collect()} == want
    hits = {x.page_id for x in url_filter.matched(df.withColumn("url", F.lit("u")), mined).collect()}
    assert hits == {i for i, w, _ in baskets if any(set(c) <= set(w) for c in want)}


def test_a_small_bad_host_among_many_urls_is_blocked(spark):
    # 0.1 % of 24,000 labelled urls; the pair of tokens is as rare, and each of them is mostly good
    path = F.expr("case when id % 1000 = 7 then 'http://spam.example.com/en/' when id % 1000 = 8 then 'http://blog.example.com/win/'"
                  " when id % 1000 < 300 then 'http://blog.example.com/en/' else 'http://news.example.com/win/' end")
    pages = spark.range(25_000).select(F.col("id").alias("page_id"), F.concat(path, F.col("id").cast("string")).alias("url"),
                                       F.lit("").alias("html"))
    labels = spark.range(24_000).select(F.col("id").alias("page_id"), (F.col("id") % 1000).isin(7, 8).alias("bad"))
    got = url_filter.filter_urls(pages, labels, RULES)
    blocked = {r.page_id for r in got.where("verdict = 'block'").collect()}
    assert blocked == {i for i in range(25_000) if i % 1000 in (7, 8)}


def test_bad_urls_that_share_many_tokens_make_few_rules(spark):
    long = [f"w{i}" for i in range(40)]
    rows = [(i, [*long, "h:a"], True) for i in range(30)] + [(100 + i, ["h:a", "h:b"], i < 19) for i in range(60)]
    mined = url_filter.mine(spark.createDataFrame(rows, "page_id long, tokens array<string>, bad boolean"))
    assert sorted(tuple(r.words) for r in mined.collect()) == sorted((w,) for w in long)


# ---------------------------------------------------------------- WARC

def test_archive_round_trip(spark, tmp_path):
    long = "<p>ü</p>" * 40_000
    rows = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, None), (4, "http://c/\r\nEvil: 1", ""), (5, "http://d/", long),
            (6, "http://e/", "a\r\n\r\nb"), (9, "http://e/", "x"), (9, "http://e/", "x"), (7, "http://f/", long), (None, "http://g/", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("mine"))
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    stored = spark.read.parquet(f"{path}/payloads").collect()
    assert sorted(bytes(r.payload).decode() for r in stored) == sorted({h or "" for i, _, h in rows if i is not None})
    assert all(hashlib.sha256(r.payload).digest() == bytes(r.key) for r in stored)
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    want = []
    for i, _, h in rows:
        if i is not None:
            h = h or ""
            want.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(),
                         "response" if top[h] == i else "revisit", None if top[h] == i else top[h]))
    assert sorted(map(tuple, warc.describe(warc.records(spark, path)).collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, warc.read_back(spark, path).collect()), key=repr) == sorted(want, key=repr)
    full = warc.records(spark, path, expand=True).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in full) == sorted((i, h or "") for i, _, h in rows if i is not None)
    evil = warc.parse_record(bytes(next(r.record for r in full if r.page_id == 4)))
    assert "evil" not in evil["headers"] and evil["headers"]["warc-target-uri"] == "http://c/%0D%0AEvil: 1"


def test_archive_of_nothing_and_a_damaged_payload(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(empty, str(tmp_path / "none"))
    assert warc.describe(warc.records(spark, str(tmp_path / "none"))).count() == 0
    assert warc.read_back(spark, str(tmp_path / "none")).count() == 0
    bad = spark.createDataFrame([(bytearray(b"k" * 32), bytearray(b"v"))], "key binary, payload binary")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.verified(bad).collect()


@pytest.mark.parametrize("was, now", [("sha1:.", "sha1:0"), ("Content-Length: 3\r", "Content-Length: 4\r"),
                                      ("Refers-To: <urn:page:8>", "Refers-To: <urn:page:5>")])
def test_a_revisit_that_disagrees_with_its_payload_fails(spark, tmp_path, was, now):
    pages = spark.createDataFrame([(i, f"http://{i}/", "abc" if i % 2 == 0 else "ä") for i in range(1, 10)],
                                  "page_id long, url string, html string")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    warc.write_archive(pages, good)
    spark.read.parquet(f"{good}/payloads").write.parquet(f"{bad}/payloads")
    header = F.col("header").cast("string")
    changed = F.when(F.col("page_id") == 4, F.regexp_replace(header, was, now)).otherwise(header).cast("binary")
    spark.read.parquet(f"{good}/headers").withColumn("header", changed).write.parquet(f"{bad}/headers")
    assert warc.read_back(spark, good).count() == 9
    with pytest.raises(Exception, match="disagrees with the payload"):
        warc.read_back(spark, bad).collect()


# ---------------------------------------------------------------- language model

def brute_lattice(lattice, word):
    text = "▁" + word

    def total(i):
        if i == len(text):
            return 1.0
        p = math.exp(lattice.logs[-1]) ** len(text[i].encode()) * total(i + 1)
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in lattice.pieces:
                p += lattice.share[lattice.pieces[text[i:j]]] * total(j)
        return p

    return math.log(total(0))


def test_lattice_sums_all_segmentations():
    lattice = lattice_lm.Lattice(PIECES)
    for w in ["a", "the", "thering", "naïve", "漢字x", "\U0001f600", "zzzz"]:
        assert math.isclose(lattice.word(w), brute_lattice(lattice, w), rel_tol=1e-9)
        before = lattice.word(w)
        lattice.weigh(lattice.share[::-1])
        assert np.allclose(lattice.under_both(w), (lattice.word(w), before), rtol=1e-12)
        plain, logs = np.zeros(len(lattice.pieces)), np.zeros(len(lattice.pieces))
        lattice.expect(w, plain)
        lattice.expect_in_logs("▁" + w, logs)
        assert np.allclose(plain, logs, rtol=1e-9)
        lattice.weigh(lattice.share[::-1])
    # expected uses: each character of the word lies in one piece
    for w in ["thering", "x" * 2000, "字かな" * 500]:
        into = np.zeros(len(lattice.pieces))
        lattice.expect(w, into)
        used = sum(into[i] * len(p) for p, i in lattice.pieces.items())
        assert math.isclose(used, len(w) + 1, rel_tol=1e-3)


def test_words_of_a_small_lattice_sum_to_one(monkeypatch):
    lattice = lattice_lm.Lattice(PIECES)
    lattice.pieces = {"▁": 0, "▁a": 1, "a": 2, "b": 3, "ab": 4}
    lattice.prefixes = lattice_lm.prefix_table(lattice.pieces)
    lattice.spelt = {}
    lattice.share = np.array([0.3, 0.3, 0.15, 0.15, 0.1])
    lattice.logs = [*np.log(lattice.share), -math.inf]
    total = sum(math.exp(lattice.word("".join(w))) for n in range(13) for w in itertools.product("ab", repeat=n))
    assert 0.98 < total <= 1 + 1e-9


def score_rows(spark, rows, train="doc_id % 5 <> 1"):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    return lattice_lm.score_documents(df, PIECES, F.expr(train)).collect()


@pytest.mark.parametrize("block", [1, 50, 1 << 20])
def test_scores_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lattice_lm, "BLOCK_TOKENS", block)
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["The", "the", "Ä", "ä", "cat", "sat", "x\x00y"]) for _ in range(r.randint(0, 9)))) for i in range(40)]
    rows += [(41, None), (46, "unseen wörds"), (None, "no"), (7, "the the"), (56, "q" * 3000)]
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows if i is not None]
    count = Counter(w for i, t in tokens if i % 5 != 1 for w in t)
    n, v = sum(count.values()), len(count)
    norm = math.log10(n + 0.5 * (v + 1))
    want = sorted((i, i % 5 != 1, len(t), sum(count[w] > 0 for w in t), n,
                   round(sum(math.log10(count[w] + 0.5) - norm for w in t), 6)) for i, t in tokens)
    got = score_rows(spark, rows)
    assert sorted((x.doc_id, x.train, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    assert all(math.isfinite(x.score) and x.score < 0 for x in got)
    by = {x.doc_id: x.score for x in got}
    assert by[46] < by[0] and by[56] < -1000


def test_language_model_scores_equal_brute_force(spark, monkeypatch):
    """Both scores from their formulas, the lattice by recursion over all segmentations."""
    monkeypatch.setattr(lattice_lm, "BLOCK_TOKENS", 30)
    monkeypatch.setattr(lattice_lm, "ROUNDS", 0)
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["The", "cat", "sat", "mat", "Ä", "on" + "xyz"[i % 3]]) for _ in range(r.randint(0, 7)))) for i in range(25)]
    rows += [(31, "unseen wörds cat"), (36, None), (41, "漢字 \U0001f600")]
    texts = {i: (t or "").encode().lower().decode().split() for i, t in rows}
    count = Counter(w for i, t in texts.items() if i % 5 != 1 for w in [*t, None])
    n, v = sum(count.values()), len(count)
    once, twice = (sum(c == k for w, c in count.items() if w is not None) for k in (1, 2))
    d = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
    lattice = lattice_lm.Lattice(PIECES)
    start = {w: brute_lattice(lattice, w) for w in set().union(*texts.values())}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = lattice_lm.fit_pieces(df.select(F.explode(F.split("text", " ")).alias("word")), PIECES, 0)
    assert np.allclose(fitted / fitted.sum() * (1 - lattice_lm.BYTE_SHARE), lattice.share)

    def p(w):
        base = lattice_lm.END_SHARE if w is None else (1 - lattice_lm.END_SHARE) * math.exp(start[w])
        return (max(count[w] - d, 0) + d * v * base) / n

    monkeypatch.setattr(lattice_lm, "fit_pieces", lambda words, path: fitted)
    got = {x.doc_id: x for x in score_rows(spark, rows)}
    for i, t in texts.items():
        assert math.isclose(got[i].score, sum(math.log10(p(w)) for w in [*t, None]), rel_tol=1e-9)
        assert math.isclose(got[i].lattice_score, sum(start[w] for w in t) / math.log(10), rel_tol=1e-9, abs_tol=1e-12)


def test_fitted_pieces_equal_expectation_by_enumeration(spark):
    lattice = lattice_lm.Lattice(PIECES)

    def uses(text):
        """Probability of each segmentation of ``text`` with its pieces."""
        if not text:
            return [(1.0, Counter())]
        out = [(math.exp(lattice.spell(text[0])) * p, c) for p, c in uses(text[1:])]
        for j in range(1, len(text) + 1):
            k = lattice.pieces.get(text[:j])
            if k is not None:
                out += [(lattice.share[k] * p, c + Counter([k])) for p, c in uses(text[j:])]
        return out

    words, start = ["there", "cats", "漢x", "aaa"], lattice.share.copy()
    weights = start
    for _ in range(2):
        total = lattice_lm.PRIOR_USES * start
        for w in words:
            ways = uses("▁" + w)
            for p, c in ways:
                for k, times in c.items():
                    total[k] += times * p / sum(q for q, _ in ways)
        weights = total
        lattice.weigh(weights)
    got = lattice_lm.fit_pieces(spark.createDataFrame([(w,) for w in words], "word string"), PIECES, 2)
    assert np.allclose(got, weights, rtol=1e-9)


@pytest.mark.parametrize("batch, held", [(1, 1), (3, 7), (7, 1 << 20), (10_000, 50)])
def test_word_lists_become_one_row_per_word(spark, monkeypatch, batch, held):
    """A word's rows may come in several batches; its numbers get to each of its places once."""
    monkeypatch.setattr(lattice_lm, "BLOCK_TOKENS", 20)
    monkeypatch.setattr(lattice_lm, "HELD_PLACES", held)
    r = random.Random(6)
    rows = [(i, " ".join(["the", *(f"w{int(r.paretovariate(0.5)) % 60}" for _ in range(8))]), i % 3 > 0) for i in range(60)]
    folded = save(lattice_lm.blocks(spark.createDataFrame([*rows, (99, None, True)], "doc_id long, text string, train boolean").repartition(2)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        words = save(lattice_lm.word_places(folded))
        told = lattice_lm.marginals(words, PIECES, lattice_lm.load(PIECES).share).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lists = {x.block: x.words for x in folded.collect()}
    count = Counter(w for _, t, train in rows if train for w in t.split())
    got = words.collect()
    assert sorted((x.word, x.c) for x in got) == sorted((w, count[w]) for w in {w for _, t, _ in rows for w in t.split()})
    assert sorted((b, p, x.word) for x in got for b, p in zip(x.blocks, x.places)) == sorted(
        (b, p, w) for b, listed in lists.items() for p, w in enumerate(listed))
    lattice = lattice_lm.Lattice(PIECES)
    numbers = [(x.of_block, int(p), int(m["c"]), m["marginal"], m["given"]) for x in told
               for m in [lattice_lm.unpack(x.numbers, x.n, lattice_lm.NUMBERS)] for p, m in zip(np.cumsum(m["place"]), m)]
    assert len(numbers) == sum(map(len, lists.values()))
    assert len({x[:2] for x in numbers}) == len(numbers)
    for b, p, c, marginal, given in numbers:
        w = lists[b][p]
        assert c == count[w] and np.allclose((marginal, given), lattice.word(w), rtol=1e-9)


def test_numbers_go_back_without_a_second_shuffle_of_words(spark):
    """Once the words of each block moved twice and their numbers as plain rows: above 4 x the input on disk."""
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(20)], "doc_id long, text string")
    scored = lattice_lm.score_documents(docs, PIECES, F.lit(True))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "word#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    r = np.random.default_rng(1)
    rows = np.empty(5000, lattice_lm.NUMBERS)
    rows["place"], rows["c"], rows["marginal"], rows["given"] = 1, r.geometric(0.3, 5000), -r.random(5000) * 40, -r.random(5000) * 60
    packed = lattice_lm.pack(rows)
    assert len(packed) < 18 * len(rows) and (lattice_lm.unpack(packed, 5000, lattice_lm.NUMBERS) == rows).all()
    assert len(lattice_lm.unpack(lattice_lm.pack(rows[:0]), 0, lattice_lm.NUMBERS)) == 0


def test_scores_without_training_documents(spark):
    got = score_rows(spark, [(1, "a b"), (6, None)])
    assert {x.train_tokens for x in got} == {0} and all(math.isfinite(x.score) and x.score < 0 for x in got)
    assert score_rows(spark, [(None, "x")]) == []


def test_training_helps_held_out_text(spark):
    """Held-out text costs less per token under the fitted pieces than under the existing scores alone."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    held = lattice_lm.score_documents(docs, PIECES, fold(F.col("doc_id")) != 1).where("not train")
    plain = lattice_lm.score_documents(docs, PIECES, F.lit(False)).where(fold(F.col("doc_id")) == 1)
    mean = lambda x: x.agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    assert mean(held) > 0.6 * mean(plain)


# ---------------------------------------------------------------- classifier

def test_held_out_quality(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = pu_classifier.classify(docs, labels).join(labels, "doc_id").where(fold(F.col("doc_id")) == 0).collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.8 and np.mean([r.predicted == r.quality for r in got]) > 0.9
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_scores_do_not_see_held_out_labels_or_other_columns(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    a = pu_classifier.classify(docs, labels)
    changed = labels.withColumn("quality", F.when(fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    b = pu_classifier.classify(docs.select("doc_id", "text", F.lit(0.9).alias("score"), F.lit("zz").alias("lang")), changed)
    x, y = ({r.doc_id: round(r.score, 9) for r in d.collect()} for d in (a, b))
    assert x == y and len(set(x.values())) > 1


def test_classifier_odd_rows(odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in pu_classifier.classify(odd, none).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (9, None, 0), (None, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = pu_classifier.classify(odd, one, train=F.lit(True)).collect()
    assert len(got) == len([i for i, _ in ODD if i is not None]) and all(0 <= r.score <= 1 for r in got)
    assert pu_classifier.classify(odd.limit(0), one).count() == 0


def test_prior_counts_only_labels_of_the_input(spark, docs_of):
    docs = docs_of([(i, f"some words of text number {i}") for i in range(10)])
    labels = [(i, 0 if i < 2 else None, 0) for i in range(10)]
    # no positive among the documents: every score is the prior
    gone = [(100 + i, i % 2, 0) for i in range(50)]
    schema = "doc_id long, quality int, toxic int"
    scores = [{r.score for r in pu_classifier.classify(docs, spark.createDataFrame(x, schema), F.lit(True)).collect()}
              for x in (labels, labels + gone)]
    assert scores == [{1 / 4}, {1 / 4}]


def test_risk_correction_keeps_a_fit_finite(spark):
    """A prior far above the truth drives the negative part of the risk below zero."""
    r = random.Random(1)
    rows = [([r.gauss(2 * (i % 2), 1) for _ in pu_classifier.FEATURES], i % 4 == 1) for i in range(400)]
    model = pu_classifier.fit(spark.createDataFrame(rows, "f array<double>, positive boolean"), 0.99)
    assert np.isfinite(model["w"]).all() and np.abs(model["w"]).max() < 100


# ---------------------------------------------------------------- pipeline and registry

def test_stages_equal_brute_force(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "line_dedup", "simhash_near_dedup", "best_fit_packing"]
    at, rows = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at[name] = (rows, save(stage(spark, rows, SF)))
        rows = at[name][1]
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    for name in names[:-1]:
        assert at[name][1].columns == docs.columns and at[name][1].schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    before, after = map(read, at["quality_rules"])
    assert set(after) <= {i for i, t in before.items() if not brute_measure(t)[5]} and len(after) > 0.7 * len(before)
    before, after = map(read, at["quality_classifier"])
    assert all(before[i] == t for i, t in after.items()) and len(after) > 0.9 * len(before)
    before, after = map(read, at["line_dedup"])
    assert sorted(after.items()) == sorted((i, t) for i, t, *_ in brute_lines(sorted(before.items())))
    assert all(r.n_chars == len(r.text) for r in at["line_dedup"][1].collect())
    before, after = map(read, at["simhash_near_dedup"])
    ids = sorted(before)
    assert set(after) == set(brute_components([brute_fingerprint(before[i]) for i in ids], ids))
    packed = at["best_fit_packing"][1].collect()
    assert check_layout(packed, 2048) == brute_best_fit([r.length for r in packed], 2048)
    assert {r.doc_id for r in packed} == set(after)


def test_the_pipeline_returns_packed_ids(spark, docs_of):
    docs = docs_of([(1, "one two three " * 2000), (2, "a b"), (2, "c d"), (3, None)])
    rows = corpus_pipeline.pack(spark, docs, SF).collect()
    assert check_layout(rows, 2048) == brute_best_fit([r.length for r in rows], 2048)
    whole = packing.load_tokenizer(corpus_pipeline.BYTE_BPE)
    ids = lambda text: whole.encode(text, add_special_tokens=False).ids + [0]
    assert [x for r in sorted(rows, key=lambda r: r.piece) if r.doc_id == 1 for x in r.ids] == ids("one two three " * 2000)
    assert sorted(r.ids for r in rows if r.doc_id == 2) == sorted([ids("a b"), ids("c d")])
    assert [r.ids for r in rows if r.doc_id == 3] == [[0]]


def test_packing_query_digests_placed_ids(spark, docs_of, tmp_path, monkeypatch):
    docs_of([(1, "a b"), (2, "c d e")]).write.parquet(f"{tmp_path}/documents.parquet")
    true = packing.pack_bytes
    monkeypatch.setattr(packing, "pack_bytes", lambda *a, **k: true(*a, **k).withColumn("ids", F.lit(b"other")))
    got = entry.queries()["op3_best_fit_packing"](spark, str(tmp_path)).collect()
    assert {r.ids_crc32 for r in got} == {zlib.crc32(b"other")} and len(got) == 2


def test_pipeline_takes_odd_rows_and_empty_tables(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {i for i, _ in ODD}
    rows = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert save(stage(spark, rows, str(tmp_path))).count() == 0
    # repeated doc_ids are reduced to one
    got = corpus_pipeline.near_dedup(spark, odd, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == sorted(
        {c for c in brute_components([brute_fingerprint(t) for i, t in ODD if i], [i for i, _ in ODD if i])})


def test_columns_of_documents_may_have_the_operators_names(spark, docs_of):
    docs = table(spark, SF, "documents")
    for c in ("n_words", "kept", "__h", "__n", "n_lines", "n_dropped", "f", "score", "predicted", "base_failed", "component_id", "fp",
              "key", "__w", "lines"):
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")))
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = save(stage(spark, rows, SF))
        assert rows.columns == docs.columns, name
        bad = F.lit(False)
        for c in docs.columns[5:]:
            bad = bad | ~F.col(c).eqNullSafe(F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")))
        assert rows.where(bad).count() == 0 and rows.count() > 100, name  # of 200


def test_registry_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert simhash.hex_fingerprint is not None
