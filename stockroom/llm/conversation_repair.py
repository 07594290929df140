"""Repair of conversations by generalised LR parsing over a grammar of roles.

The roles' initials of a repaired conversation form a sentence of ``RULES``:
an optional system turn, then pairs of a user and an assistant turn, or nothing
at all. Rows are kept (cost 0), rerole to user or assistant (1), deleted (2), and
empty user or assistant rows are inserted (5). Blank and duplicate rows must be
deleted; a truncated row that stays costs 5 more. Of the cheapest edits those
whose initials (D, I, K, R in order) come first in ASCII order are taken.

An SLR table is made from the rules. The parser follows all edits at once on a
graph-structured stack: a node is a state on the node below it, shared by all
stacks that agree so far, and stacks with equal tops are merged by the minimum
of (cost, audit). Inserted rows are parsed together with the row that follows, so
all audits at one place have used up the same rows and none is the beginning
of another: which of two continued audits is smaller is told by the order of
the tops they continue. A step thus looks at a few numbers, no audit is ever
compared or copied, and the audit is read off the links in the end.

On Spark, conversations of up to ``ROWS`` rows and ``BYTES`` bytes are sorted into
partitions by their id and parsed one at a time. Longer ones never meet in
a task: equal rows are first counted together, rows are dealt by ranges of
(conversation, turn, role, text) and parsed in segments, once for every stack
that a segment may begin with; the segments' results (cost and audit for each
pair of stacks) are then joined in order, and each segment is rewritten on its own.

Defined cases: rows with a null conv_id are left out; a null role or text is one
blank; rows are ordered by turn (nulls first), then role and text in UTF-8
order; repeated rows are duplicates; a conversation without rows is not
returned; an empty table gives no rows; other columns do not matter. White
space is ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, save, strip_white

# Nonterminals are capitals; a terminal is the initial of a role.
RULES = [("C", ""), ("C", "HT"), ("H", ""), ("H", "s"), ("T", "ua"), ("T", "Tua")]
NAMES = {"u": "user", "a": "assistant"}  # roles that rows are given
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAULTS = ("blank", "duplicate", "truncated")  # a row has the first that applies, or none (0); numbered from 1

ROWS, BYTES = 4096, 8 << 20  # longer conversations are parsed in segments
SEGMENT_ROWS, SEGMENT_BYTES = 1024, 4 << 20
SALTS = 16

Kind = tuple[int, str]  # a row's fault and its role's initial


class Parser:
    """SLR table of the rules, and the stacks that it can reach, numbered."""

    def __init__(self, rules=RULES, most: int = 64):
        self.rules = [("^", rules[0][0]), *rules]
        self.follow = self._follow()
        self.states: list[frozenset] = []
        self._number: dict[frozenset, int] = {}
        start = self._state({(0, 0)})
        self.stacks: list[tuple[int, int | None]] = [(start, None)]  # (state, the stack below)
        self._known = {self.stacks[0]: 0}
        self._moves: dict[tuple[int, Kind], list] = {}
        self.after: list[dict[str, int]] = []  # stack after a token
        while len(self.after) < len(self.stacks):
            if len(self.after) == most:
                raise ValueError("the rules' stacks grow without bound")
            stack = len(self.after)
            self.after.append({t: new for t in sorted({*NAMES, "s"}) if (new := self._read(stack, t)) is not None})
        self.between = {0}  # stacks that can lie between two rows
        while more := {x for s in self.between for x in self.after[s].values()} - self.between:
            self.between |= more
        self.accepts = [self._accepts(i) for i in range(len(self.after))]
        # up to two inserted rows: a third would come back to the same choices at a higher cost
        self.inserted = [[(s, 0)] + [(x, 1) for x in self._given(s)]
                         + [(y, 2) for x in self._given(s) for y in self._given(x)] for s in range(len(self.after))]

    def _given(self, stack: int) -> list[int]:
        return [self.after[stack][t] for t in NAMES if t in self.after[stack]]

    def _follow(self) -> dict[str, set[str]]:
        empty, first = set(), {}
        follow = {left: set() for left, _ in self.rules} | {"^": {"$"}}
        changed = True
        while changed:
            before = (len(empty), sum(map(len, first.values())), sum(map(len, follow.values())))
            for left, right in self.rules:
                if all(x in empty for x in right):
                    empty.add(left)
                for i, x in enumerate(right):
                    if all(y in empty for y in right[:i]):
                        first.setdefault(left, set()).update(first.get(x, ()) if x.isupper() else x)
                    if x.isupper():
                        rest = right[i + 1:]
                        for k, y in enumerate(rest):
                            follow[x] |= first.get(y, set()) if y.isupper() else {y}
                            if y not in empty:
                                break
                        else:
                            follow[x] |= follow[left]
            changed = before != (len(empty), sum(map(len, first.values())), sum(map(len, follow.values())))
        return follow

    def _state(self, kernel: set) -> int:
        items, new = set(kernel), list(kernel)
        while new:
            rule, dot = new.pop()
            right = self.rules[rule][1]
            if dot < len(right):
                more = {(i, 0) for i, (left, _) in enumerate(self.rules) if left == right[dot]} - items
                items |= more
                new += more
        found = frozenset(items)
        if found not in self._number:
            self._number[found] = len(self.states)
            self.states.append(found)
        return self._number[found]

    def _push(self, stack: int, symbol: str) -> int | None:
        kernel = {(r, d + 1) for r, d in self.states[self.stacks[stack][0]] if self.rules[r][1][d:d + 1] == symbol}
        if not kernel:
            return None
        node = (self._state(kernel), stack)
        if node not in self._known:
            self._known[node] = len(self.stacks)
            self.stacks.append(node)
        return self._known[node]

    def _reduced(self, stack: int, ahead: str | None) -> int | None:
        """The stack after one reduction: with ``ahead`` None, only one that the state admits no choice about."""
        items = self.states[self.stacks[stack][0]]
        done = [r for r, d in items if r and d == len(self.rules[r][1])
                and (len(items) == 1 if ahead is None else ahead in self.follow[self.rules[r][0]])]
        if not done:
            return None
        if len(done) > 1:
            raise ValueError("the rules are not SLR")
        left, right = self.rules[done[0]]
        for _ in right:
            stack = self.stacks[stack][1]
        return self._push(stack, left)

    def _read(self, stack: int, token: str) -> int | None:
        while (less := self._reduced(stack, token)) is not None:
            stack = less
        stack = self._push(stack, token)
        while stack is not None and (less := self._reduced(stack, None)) is not None:
            stack = less
        return stack

    def _accepts(self, stack: int) -> bool:
        while (less := self._reduced(stack, "$")) is not None:
            stack = less
        return (0, 1) in self.states[self.stacks[stack][0]]

    def moves(self, stack: int, kind: Kind) -> list[tuple[int, int, str]]:
        """(next stack, cost, edits) that use up a row: the cheapest, then the smallest edits, for each next stack."""
        if (stack, kind) not in self._moves:
            fault, initial = kind
            best: dict[int, tuple[int, str]] = {}
            for s, n in self.inserted[stack]:
                edits = [(s, DELETE, "D")]
                if fault not in (1, 2):
                    more = TRUNCATED if fault == 3 else 0
                    edits += [(self.after[s].get(initial), KEEP + more, "K")]
                    edits += [(self.after[s].get(t), REROLE + more, "R") for t in NAMES]
                for to, cost, edit in edits:
                    if to is not None:
                        best[to] = min(best.get(to, (1 << 60, "")), (cost + n * INSERT, "I" * n + edit))
            self._moves[stack, kind] = [(to, *x) for to, x in best.items()]
        return self._moves[stack, kind]

    def parse(self, kinds: list[Kind], start: int = 0) -> list[tuple[int, int, str]]:
        """(stack, cost, audit) of all tops after the rows, smallest audit first."""
        tops = [(start, 0)]
        links = []
        for kind in kinds:
            best: dict[int, tuple[int, int, str]] = {}
            for rank, (stack, cost) in enumerate(tops):
                for to, more, edits in self.moves(stack, kind):
                    new = (cost + more, rank, edits)
                    if to not in best or new < best[to]:
                        best[to] = new
            order = sorted(best.items(), key=lambda x: x[1][1:])
            tops = [(to, x[0]) for to, x in order]
            links.append([x[1:] for _, x in order])
        out = []
        for at, (stack, cost) in enumerate(tops):
            edits = []
            for link in reversed(links):
                at, some = link[at]
                edits.append(some)
            out.append((stack, cost, "".join(reversed(edits))))
        return out

    def finish(self, tops: list[tuple[int, int, str]]) -> tuple[int, str, int]:
        """The cheapest (cost, rows to insert at the end, place in ``tops``); ``tops`` are in order of their audits."""
        return min((cost + n * INSERT, at, "I" * n) for at, (stack, cost, _) in enumerate(tops)
                   for s, n in self.inserted[stack] if self.accepts[s])

    def replay(self, audit: str, rows: list[dict], start: int = 0) -> list[dict]:
        """The repaired rows."""
        stack, at, out = start, 0, []
        for edit in audit:
            row = None
            if edit != "I":
                row, at = rows[at], at + 1
            if edit == "D":
                continue
            token = row["role"][:1] if edit == "K" else next(t for t in NAMES if t in self.after[stack])
            stack = self.after[stack][token]
            out.append({"turn": row and row["turn"], "role": row["role"] if edit == "K" else NAMES[token],
                        "text": row["text"] if row else "", "edit": edit})
        return out


@lru_cache(maxsize=1)
def parser() -> Parser:
    return Parser()


ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_REPAIRED = "repaired array<struct<turn:long,role:string,text:string,edit:string>>"
_REPORT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, " + _REPAIRED


def _columns(conversations: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return conversations.where("conv_id is not null").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"))


def _with_fault(rows: DataFrame) -> DataFrame:
    """``rows`` with the fault that a row has by itself."""
    seen = strip_white(F.col("text"))
    return rows.withColumn("fault", F.when(seen == "", 1).when(F.right(seen, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3))


def _summary(rows: list[dict]) -> dict:
    """Sums over rows in order, whose faults are known."""
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    out = {c: sum(r["fault"] == i for r in rows) for i, c in enumerate(FAULTS, 1)}
    out["illegal"] = sum(a["role"][:1] + b["role"][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return out | {"low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns))}


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _one(rows: list[dict]) -> dict:
    """Report and repaired rows of a whole conversation."""
    seen = set()
    for r in rows:
        key = (r["role"], r["text"])
        if r["fault"] != 1 and key in seen:
            r["fault"] = 2
        seen.add(key)
    p, found = parser(), _summary(rows)
    tops = p.parse([(r["fault"], r["role"][:1]) for r in rows])
    cost, at, end = p.finish(tops)
    audit = tops[at][2] + end
    return {c: found.get(c) for c in COUNTS} | {"gaps": _gaps(found["low"], found["high"], found["turns"]), "cost": cost,
                                                "audit": audit, "repaired": p.replay(audit, rows)}


def _runs(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, dict]]:
    """Rows as dicts, each with its key."""
    for batch in batches:
        for at in range(0, len(batch), 1000):
            for row in batch.slice(at, 1000).to_pylist():
                yield tuple(row[c] for c in key), row


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations that fit a task, each parsed at once."""
    id_type = T.StructType([rows.schema["conv_id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = pa.schema([*to_arrow_schema(id_type), *[pa.field(c, pa.int64()) for c in COUNTS], pa.field("audit", pa.string()),
                            pa.field("repaired", pa.list_(ROW))])
        held, out, size, now = [], [], 0, None
        for key, row in _runs(batches, ("conv_id",)):
            if key != now and held:
                out.append({"conv_id": now[0], **_one(held)})
                held = []
                if size > 4 << 20 or len(out) > 2000:
                    yield _batch(out, schema)
                    out, size = [], 0
            now = key
            held.append(row)
            size += len(row["text"])
        if held:
            yield _batch([*out, {"conv_id": now[0], **_one(held)}], schema)

    dealt = _with_fault(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    name = rows.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"conv_id {name}, {_REPORT}").withColumn("segment", F.lit(0)).withColumn("segments", F.lit(1))


def _marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number ``n`` and their first occurrence's fault; later ones are duplicates."""
    counted = save(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")))
    order = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"))
    keyed = _with_fault(counted).withColumn("key", F.sha2("text", 256)).withColumn("at", order)
    again = save(keyed.groupBy("conv_id", "role", "key").agg(F.min("at").alias("first"), F.max("at").alias("last"))
                 .where("first < last").drop("last"))
    # rows that one conversation repeats in many turns are dealt by turn as well
    salted = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int"))
    return keyed.join(salted, ["conv_id", "role", "key", "salt"], "left").select(
        "conv_id", "turn", "role", "text", "n",
        F.when((F.col("fault") != 1) & (F.col("at") > F.col("first")), 2).otherwise(F.col("fault")).alias("fault"))


_MEMBER = "struct<turn:long,role:string,text:string,n:long,fault:int>"
_PATH = "struct<start:int,stack:int,cost:long,audit:string>"


def _segments(marked: DataFrame) -> DataFrame:
    """Consecutive rows of a conversation, with (cost, audit) from each stack to each other."""
    name = marked.schema["conv_id"].dataType.simpleString()
    id_type = T.StructType([marked.schema["conv_id"]])
    sums, most, most_bytes = [*FAULTS, "illegal", "low", "high", "turns"], SEGMENT_ROWS, SEGMENT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        part, p, number = TaskContext.get().partitionId(), parser(), 0
        member = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("fault", pa.int32())])
        path = pa.struct([("start", pa.int32()), ("stack", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
        schema = pa.schema([*to_arrow_schema(id_type), ("part", pa.int32()), ("number", pa.int32()), *[(c, pa.int64()) for c in sums],
                            ("head", pa.string()), ("tail", pa.string()), ("rows", pa.list_(member)), ("paths", pa.list_(path))])

        def made(key, held, number) -> pa.RecordBatch:
            single = [x for r in held for x in [r, *({**r, "fault": r["fault"] if r["fault"] == 1 else 2},) * (r["n"] - 1)]]
            kinds = [(r["fault"], r["role"][:1]) for r in single]
            paths = [dict(zip(("start", "stack", "cost", "audit"), (s, *top))) for s in sorted(p.between) for top in p.parse(kinds, s)]
            return _batch([{"conv_id": key[0], "part": part, "number": number, **_summary(single), "head": held[0]["role"][:1],
                            "tail": held[-1]["role"][:1], "rows": held, "paths": paths}], schema)

        held, count, size, now = [], 0, 0, None
        for key, row in _runs(batches, ("conv_id",)):
            left = row["n"]
            while left:
                if held and (key != now or count >= most or size > most_bytes):
                    yield made(now, held, number)
                    held, count, size, number = [], 0, 0, number + 1
                now, take = key, min(left, most)
                held.append({**row, "n": take, "fault": row["fault"] if left == row["n"] or row["fault"] == 1 else 2})
                left, count, size = left - take, count + take, size + len(row["text"])
        if held:
            yield made(now, held, number)

    order = ["conv_id", "turn", "role", "text"]
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, f"conv_id {name}, part int, number int, {', '.join(f'{c} long' for c in sums)}, head string, "
                                 f"tail string, rows array<{_MEMBER}>, paths array<{_PATH}>")


def _joined(made: DataFrame) -> DataFrame:
    """The choice in each segment: (conv_id, part, number, start, edits, segment) and the report, at the first segment."""
    name = made.schema["conv_id"].dataType.simpleString()
    id_type = T.StructType([made.schema["conv_id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        p = parser()
        schema = pa.schema([*to_arrow_schema(id_type), ("part", pa.int32()), ("number", pa.int32()), ("segment", pa.int32()),
                            ("segments", pa.int32()), ("start", pa.int32()), ("edits", pa.string()),
                            *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string())])

        def result(key) -> Iterator[pa.RecordBatch]:
            cost, at, end = p.finish(tops)
            chosen = []
            for link in reversed(links):
                before, start, audit = link[at]
                chosen.append((start, audit))
                at = before
            chosen.reverse()
            chosen[-1] = (chosen[-1][0], chosen[-1][1] + end)
            counts = {**total, "gaps": _gaps(total["low"], total["high"], total["turns"]), "cost": cost}
            for i, ((start, edits), (part, number)) in enumerate(zip(chosen, places)):
                head = {**{c: counts[c] for c in COUNTS}, "audit": "".join(e for _, e in chosen)} if not i else {}
                yield _batch([{"conv_id": key[0], "part": part, "number": number, "segment": i, "segments": len(chosen),
                               "start": start, "edits": edits, **dict.fromkeys([*COUNTS, "audit"]), **head}], schema)

        now, tops, links, places, total = None, [], [], [], {}
        for key, row in _runs(batches, ("conv_id",)):
            if key != now:
                if now is not None:
                    yield from result(now)
                now, tops, links, places = key, [(0, 0, "")], [], []
                total = dict.fromkeys([*FAULTS, "illegal", "turns"], 0) | {"low": None, "high": None, "tail": None}
            paths = {}
            for x in row["paths"]:
                paths.setdefault(x["start"], []).append((x["stack"], x["cost"], x["audit"]))
            best: dict[int, tuple[int, int, str]] = {}
            for rank, (stack, cost, _) in enumerate(tops):
                for to, more, audit in paths[stack]:
                    new = (cost + more, rank, audit)
                    if to not in best or new < best[to]:
                        best[to] = new
            order = sorted(best.items(), key=lambda x: x[1][1:])
            links.append([(rank, tops[rank][0], audit) for _, (_, rank, audit) in order])
            tops = [(to, cost, "") for to, (cost, _, _) in order]
            places.append((row["part"], row["number"]))
            if total["tail"] is not None and total["tail"] + row["head"] not in ("su", "ua", "au"):
                total["illegal"] += 1
            if row["low"] is not None:
                total["turns"] += row["turns"] - (total["high"] == row["low"])  # the turn goes on
                total["low"] = row["low"] if total["low"] is None else total["low"]
                total["high"] = row["high"]
            for c in (*FAULTS, "illegal"):
                total[c] += row[c]
            total["tail"] = row["tail"]
        if now is not None:
            yield from result(now)

    dealt = made.drop("rows").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return dealt.mapInArrow(run, f"conv_id {name}, part int, number int, segment int, segments int, start int, edits string, "
                                 f"{', '.join(f'{c} long' for c in COUNTS)}, audit string")


def _segmented(rows: DataFrame) -> DataFrame:
    """Conversations of any length, a row for each segment."""
    made = save(_segments(_marked(rows)))
    chosen = save(_joined(made))
    both = made.select("conv_id", "part", "number", "rows").join(chosen, ["conv_id", "part", "number"]).drop("part", "number")
    keep = [c for c in both.columns if c not in ("rows", "start", "edits")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser()
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                rows, start, edits = (one.column(one.schema.get_field_index(c))[0].as_py() for c in ("rows", "start", "edits"))
                rows = [r for r in rows for _ in range(r["n"])]
                yield pa.record_batch([*[one.column(one.schema.get_field_index(c)) for c in keep],
                                       pa.array([p.replay(edits, rows, start)], pa.list_(ROW))], names=[*keep, "repaired"])

    kept = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in keep)
    return both.mapInArrow(run, f"{kept}, {_REPAIRED}")


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, segment, segments, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired).

    One row for each conversation, or one for each segment of a long one: then the report stands in the first
    (``segment`` 0) and is null in the others. ``repaired`` has the rows (turn, role, text, edit) that remain, in order."""
    rows = _columns(conversations)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = save(sizes.where((F.col("n") > ROWS) | (F.col("bytes") > BYTES)).select("conv_id"))
    names = ["conv_id", "segment", "segments", *COUNTS, "audit", "repaired"]
    if long.isEmpty():
        return _whole(rows).select(names)
    return _whole(rows.join(long, "conv_id", "left_anti")).select(names).unionByName(
        _segmented(rows.join(long, "conv_id", "left_semi")).select(names))


def digest(repaired: DataFrame) -> DataFrame:
    """(conv_id, report, repaired_sha256): the hash of the repaired `role:text` lines, one row for each conversation."""
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    one = repaired.where("segments = 1").select("conv_id", *COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    name = repaired.schema["conv_id"].dataType.simpleString()
    id_type = T.StructType([repaired.schema["conv_id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A hash is one pass over a text in order: segments are read one at a time and not kept."""
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = pa.schema([*to_arrow_schema(id_type), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()),
                            ("repaired_sha256", pa.string())])
        now, state, empty = None, None, True
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["segment"] == 0:
                    if now is not None:
                        yield _batch([{**now, "repaired_sha256": state.hexdigest()}], schema)
                    now, state, empty = {c: row[c] for c in ("conv_id", *COUNTS, "audit")}, hashlib.sha256(), True
                if row["lines"] is not None:
                    state.update((row["lines"] if empty else "\n" + row["lines"]).encode())
                    empty = False
        if now is not None:
            yield _batch([{**now, "repaired_sha256": state.hexdigest()}], schema)

    many = repaired.where("segments > 1").select("conv_id", "segment", *COUNTS, "audit",
                                                 F.when(F.size("repaired") > 0, lines).alias("lines"))
    dealt = many.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return one.unionByName(dealt.mapInArrow(run, f"conv_id {name}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, "
                                                 "repaired_sha256 string"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of `conv_id:turn` modulo 20: dropped, emptied, without sentence ends, repeated, or a user's."""
    rows = _columns(conversations)
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    how = rows.withColumn("how", F.crc32(key.cast("binary")) % 20).where("how <> 0")
    return how.select(
        "conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
