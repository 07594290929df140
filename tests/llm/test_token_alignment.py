"""Cross-tokenizer alignment against the two libraries and a plain set intersection."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stockroom.llm import byte_tokenizer, token_alignment
from stockroom.llm.queries import BYTE_BPE, PIECES

from .conftest import ODD


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute_tokens(text, library):
    """(ids, tokens' bytes) of A and B, or two empty ones."""
    none = ([], []), ([], [])
    if not text:
        return none
    a, b = library
    of = byte_tokenizer.byte_of_character()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
               for i in ids_b]
    raw = (" " + text).encode()
    return ((ids_a, bytes_a), (ids_b, bytes_b)) if b"".join(bytes_a) == raw == b"".join(bytes_b) else none


def brute(rows, library):
    made, count = [], Counter()
    for doc, text in rows:
        (ids_a, bytes_a), (ids_b, bytes_b) = brute_tokens(text, library)
        ends_a, ends_b = (np.cumsum([len(t) for t in x]).tolist() for x in (bytes_a, bytes_b))
        links = [(ids_a[ends_a.index(e)], ids_b[ends_b.index(e)]) for e in sorted(set(ends_a) & set(ends_b))]
        groups, low = [], 0
        for e in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(str(i) for i, x in zip(ids_a, ends_a) if low < x <= e) + "|"
                          + ",".join(str(i) for i, x in zip(ids_b, ends_b) if low < x <= e))
            low = e
        count.update(links)
        made.append((doc, len(ids_a), len(ids_b), groups, links))
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return sorted((doc, n_a, n_b, len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
                   hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
                  for doc, n_a, n_b, groups, links in made)


def texts(n, seed):
    r = random.Random(seed)
    parts = ["the", " of", "  ", "\n", "tokenisation", "Straße", "中文", "ا", "\U0001f600", "\x00", "3141", "...", "'ll", "\t", "▁", "é"]
    return [(i, "".join(r.choice(parts[:-2] if i % 5 else parts) + r.choice(["", " "]) for _ in range(r.randint(0, 40))))
            for i in range(n)]


def plain(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()))


def test_equals_brute_force(docs_of, library):
    rows = texts(80, 1)
    assert plain(token_alignment.align_documents(docs_of(rows), BYTE_BPE, PIECES)) == brute(rows, library)


def test_blocks_lanes_and_parts_do_not_matter(docs_of, library, monkeypatch):
    rows = texts(40, 2)
    for name, size in (("BLOCK", 50), ("LANE", 3), ("PART", 16), ("BATCH_CHARS", 100)):
        monkeypatch.setattr(token_alignment, name, size)
    b = token_alignment.PieceBytes(PIECES)
    plain_texts = [t for _, t in rows]
    assert b.encode(plain_texts) == [library[1].encode(t) for t in plain_texts]
    aligned = token_alignment.align(docs_of(rows).coalesce(1), BYTE_BPE, PIECES)
    got = [r.asDict() for r in aligned.collect()]
    for r in got:
        (ids_a, bytes_a), (ids_b, bytes_b) = brute_tokens(dict(rows)[r["doc_id"]], library)
        ends_a, ends_b = (np.cumsum([len(t) for t in x]).astype(int).tolist() for x in (bytes_a, bytes_b))
        assert (r["a_ids"], r["b_ids"]) == (ids_a, ids_b)
        assert r["cuts"] == sorted(set(ends_a) & set(ends_b))
        assert r["link_a"] == [ends_a.index(c) for c in r["cuts"]] and r["link_b"] == [ends_b.index(c) for c in r["cuts"]]


def test_many_blocks_share_the_counts(docs_of, library, monkeypatch):
    # blocks are cut inside tasks, which read the module's constant: many partitions stand for many blocks
    rows = texts(60, 3)
    assert plain(token_alignment.align_documents(docs_of(rows).repartition(7), BYTE_BPE, PIECES)) == brute(rows, library)


def test_a_task_has_one_python_process_and_a_link_two_bytes_at_most(docs_of, monkeypatch):
    saved, save = [], token_alignment.save

    def kept(df, *how):
        saved.append((df._jdf.queryExecution().optimizedPlan().toString(), save(df, *how)))
        return saved[-1][1]

    monkeypatch.setattr(token_alignment, "save", kept)
    n_links = sum(r[4] for r in plain(token_alignment.align_documents(docs_of(texts(300, 4)).coalesce(1), BYTE_BPE, PIECES)))
    steps, made = next(x for x in saved if "places" in x[1].columns)
    assert steps.count("MapInArrow") == 1
    assert 0 < made.select(F.sum(F.octet_length("places"))).first()[0] <= 2 * n_links


@pytest.mark.parametrize("n_pairs", [1, 1 << 16, (1 << 16) + 1])
@pytest.mark.parametrize("n", [0, 1, 5000])
def test_packed_places_come_back(n, n_pairs):
    places = np.random.default_rng(n).integers(0, n_pairs, n)
    places[:1] = n_pairs - 1
    back = token_alignment._unpacked(token_alignment._packed(places, n_pairs), n, n_pairs)
    assert back.tolist() == places.tolist()


def test_blocks_without_links(docs_of):
    got = plain(token_alignment.align_documents(docs_of([(1, None), (2, ""), (2, "")]), BYTE_BPE, PIECES))
    assert got == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 2)]


@pytest.mark.parametrize("lane", [1, 2, 5, 1000])
def test_lockstep_is_the_intersection_of_ends(lane):
    r = np.random.default_rng(lane)
    ends_a, ends_b, docs, low = [], [], [0], 0
    for n in r.integers(0, 60, 50):
        top = low + int(n)
        cut_a, cut_b = (sorted({*r.integers(low + 1, top + 1, n // 2).tolist(), top} if n else []) for _ in range(2))
        ends_a += cut_a
        ends_b += cut_b
        docs.append(len(ends_a))
        low = top
    ends_a, ends_b = np.array(ends_a), np.array(ends_b)
    a, b = token_alignment.lockstep(ends_a, ends_b, np.array(docs), lane)
    common = np.intersect1d(ends_a, ends_b)
    assert (ends_a[a] == common).all() and (ends_b[b] == common).all() and len(a) == len(common)


def test_odd_rows_and_columns(docs_of, odd, spark, library):
    rows = [(i, t) for i, t in ODD if i is not None and i not in (8, 9)]
    small = odd.where("doc_id is null or doc_id not in (8, 9)").withColumn("n_a", F.lit("mine")).withColumn("pair", F.lit(1))
    assert plain(token_alignment.align_documents(small, BYTE_BPE, PIECES)) == brute(rows, library)
    long = {r.doc_id: r for r in token_alignment.align_documents(odd.where("doc_id in (8, 9)"), BYTE_BPE, PIECES).collect()}
    assert long[8].n_groups > 29_000 and long[9].n_a == len(library[0].encode(" " + "x" * 70_000).ids)
    assert token_alignment.align_documents(odd.limit(0), BYTE_BPE, PIECES).count() == 0


def test_byte_tokenizer_is_the_tokenizers_library(library):
    r = random.Random(5)
    own = byte_tokenizer.load(BYTE_BPE)
    for low in range(0, 0x20000, 64):
        marks = [chr(c) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}b 1{c}. {c}{c} " for c in marks)
        assert own.encode(text).tolist() == library[0].encode(text, add_special_tokens=False).ids
    for _, t in texts(200, 6):
        assert own.encode(t).tolist() == library[0].encode(t, add_special_tokens=False).ids
    assert b"".join(own.tokens[i] for i in own.encode("Straße <|endoftext|>\n")) == "Straße <|endoftext|>\n".encode()
    assert public_tokenizers.PATTERN == byte_tokenizer.PATTERN and r
