"""Conversation repair against a search over all edits, and long conversations against short ones."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from stockroom.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\f\r"
WANT = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, lines) of the best edits: a best-first search over (cost, audit) that knows nothing of parsing."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    own = faults(rows)
    heap, seen = [(0, "", 0, "", "")], set()
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if at == len(rows) and WANT.fullmatch(roles):
            return rows, own, cost, audit, lines[1:]
        state = (at, roles[-1:] if len(roles) != 1 or roles != "s" else "s", bool(roles))
        if state in seen:
            continue
        seen.add(state)
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[roles[-1:]]
        for role in ("user", "assistant"):
            if role[0] in allowed:
                heapq.heappush(heap, (cost + 5, audit + "I", at, roles + role[0], lines + f"\n{role}:"))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles, lines))
            if own[at] in ("", "truncated"):
                more = 5 * (own[at] == "truncated")
                for edit, to, name in [("K", role, role), ("R", "user", "user"), ("R", "assistant", "assistant")]:
                    if to[:1] and to[0] in allowed:
                        heapq.heappush(heap, (cost + more + (edit == "R"), audit + edit, at + 1, roles + to[0], lines + f"\n{name}:{text}"))


def expected(conversations):
    out = []
    for i, rows in conversations.items():
        rows, own, cost, audit, lines = brute(rows)
        turns = [t for t, _, _ in rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out.append((i, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, own.count("blank"), own.count("duplicate"),
                    own.count("truncated"), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out)


def conversations(n, most, seed):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "ape", ""]
    texts = ["a.", "b!", "c?", "d. ", "cut", " ", "", None, "e.\n", "end"]
    return {i: [(r.choice([None, *range(most)]), r.choice(roles[:r.choice([4, 9])]), r.choice(texts[:4] + [f"{r.random()}."]) if r.random() < .7
                 else r.choice(texts)) for _ in range(r.randint(1, most))] for i in range(n)}


def frame(spark, made):
    return spark.createDataFrame([(i, *row) for i, rows in made.items() for row in rows], SCHEMA)


def plain(df):
    return sorted(map(tuple, df.select("conv_id", *repair.COUNTS, "audit", "repaired_sha256").collect()))


def test_equals_search(spark):
    made = conversations(150, 9, 1)
    assert plain(repair.digest(repair.repair(frame(spark, made)))) == expected(made)


@pytest.mark.parametrize("segment", [1, 3, 1000])
def test_long_conversations_in_segments(spark, monkeypatch, segment):
    made = conversations(30, 12, 2) | conversations(3, 70, 3) | {900: [(1, "user", "same.")] * 50 + [(2, "assistant", "b.")]}
    made |= {i: [(None, "user", " ")] * 9 for i in (901, 902)}
    monkeypatch.setattr(repair, "ROWS", 8)
    monkeypatch.setattr(repair, "SEGMENT_ROWS", segment)
    assert plain(repair.digest(repair.repair(frame(spark, made)))) == expected(made)


def test_long_texts_go_by_segments(spark, monkeypatch):
    monkeypatch.setattr(repair, "BYTES", 1000)
    made = {1: [(0, "user", "x" * 5000 + "."), (1, "assistant", "y.")], 2: [(0, "user", "a."), (1, "assistant", "b.")]}
    got = repair.repair(frame(spark, made))
    assert plain(repair.digest(got)) == expected(made)
    assert [(r.conv_id, x.turn, x.role, x.edit) for r in got.orderBy("conv_id", "segment").collect() for x in r.repaired] == [
        (i, t, role, "K") for i in (1, 2) for t, role in enumerate(("user", "assistant"))]


def test_all_role_sequences_by_the_table():
    p = repair.parser()
    for n in range(7):
        for roles in product("sua", repeat=n):
            stack = 0
            for t in roles:
                stack = None if stack is None else p.after[stack].get(t)
            assert (stack is not None and p.accepts[stack]) == bool(WANT.fullmatch("".join(roles))), roles
    assert len(p.between) == 5


def test_rules_that_do_not_fit():
    with pytest.raises(ValueError):  # the stack grows with every pair
        repair.Parser([("C", ""), ("C", "uaC")], 16)
    with pytest.raises(ValueError):  # two reductions
        repair.Parser([("C", "A"), ("C", "B"), ("A", "u"), ("B", "u")]).after


def test_damage(spark):
    rows = [(i, t, r, x) for i in range(40) for t, (r, x) in enumerate([("system", "S. a!"), ("assistant", "T? b."), (None, None)])]
    rows += [(7, None, "user", "n.")]
    want = []
    for i, t, r, x in rows:
        how = zlib.crc32(f"{i}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", " " if x is None else x
        if how:
            want += [(i, t, "user" if how == 4 else r, "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x)] * (1 + (how == 3))
    key = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3])
    assert sorted(map(tuple, repair.damage(spark.createDataFrame(rows, SCHEMA)).collect()), key=key) == sorted(want, key=key)


def test_odd_rows_and_columns(spark):
    rows = [(None, 1, "user", "no id."), (1, None, None, None), (1, None, "user", "a."), (2, 5, "user", "x " * 50_000 + "."),
            (2, 9, "assistant", ""), (3, 1, "", "a."), (3, 1, "", "a.")]
    df = spark.createDataFrame(rows, SCHEMA)
    made = {i: [r[1:] for r in rows if r[0] == i] for i in (1, 2, 3)}
    odd = df.withColumn("segment", F.lit("mine")).withColumn("n", F.lit(1)).withColumn("fault", F.lit(3)).withColumn("audit", F.lit("x"))
    assert plain(repair.digest(repair.repair(odd))) == expected(made)
    assert repair.digest(repair.repair(df.limit(0))).count() == 0
    assert repair.repair(df.where("conv_id = 1").withColumn("conv_id", F.lit("one"))).first()["conv_id"] == "one"
