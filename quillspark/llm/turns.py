"""Repair of the turn structure of conversations at least cost.

The initials of the roles that remain must read ``(s?(ua)+)?``. Its four states (nothing yet, after
the system turn, after a user's, after an assistant's) are a grammar, and each turn is kept (free),
given the role user or assistant (2) or deleted (3); empty turns of user or assistant may be
inserted anywhere (2). Blank and repeated turns must be deleted; a truncated one that stays adds 1.

Conversations are dealt out by a hash of their id. A task takes batches of them, bounded by rows and
by bytes, and hands each batch to a recursive DuckDB query: each recursion advances one turn for all
conversations of the batch and keeps, for each state, the least cost and the ASCII-least list of
edits (D, I, K, R) of that cost. Edits say which role a turn gets, as a state allows one only.

A conversation of more than ``SEGMENT`` turns or ``SEGMENT_BYTES`` of text is cut into parts by
ranges of its turns, which are dealt out as well, so no task holds all of it. The same query gives
for each part the best edits from each state to each other; parts are then joined in order, by
four states and a pointer each, and repaired where they are. Repeats in it are found by a join.
Only the hash over its repaired text has to see all of it in order, one part at a time.

Rows are taken by turn, nulls first, then by role and text; repeated rows stand side by side and all
but one are repeats. A null role or text is one space, so a null text is blank. Rows with a null id
are one conversation. A role's initial is its first character; one that is no s, u or a can't be
kept. A conversation without turns has nothing to repair. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_task, bound_batches, materialise, pick

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
SEGMENT, SEGMENT_BYTES = 256, 2 << 20
BATCH_ROWS, BATCH_BYTES = 16_384, 8 << 20
SPACE = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}

#: State -> initial -> state: 0 nothing yet, 1 after s, 2 after u, 3 after a.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTED = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Fault of a turn, as one character of its kind.
SOUND, CUT_SHORT, LOST = "0", "1", "2"


def _given(state: int) -> tuple[str, int]:
    """The role that a state gives to a turn whose role is changed or that is inserted, and the state after it."""
    return next((r, GRAMMAR[state][r]) for r in "ua" if r in GRAMMAR[state])


def _inserted(state: int) -> Iterator[tuple[int, str, int]]:
    """(state, edits, cost) after no, one or two inserted turns; three would come back to a state."""
    edits = ""
    for _ in range(3):
        yield state, edits, INSERT * len(edits)
        state, edits = _given(state)[1], edits + "I"


def _moves() -> list[tuple[int, str, int, str, int]]:
    """(state, kind of turn, state after it, edits, cost)."""
    out = []
    for state in GRAMMAR:
        for initial in "suax":
            for fault in (SOUND, CUT_SHORT, LOST):
                steps = [(state, "D", DELETE)]
                if fault != LOST:
                    more = TRUNCATED if fault == CUT_SHORT else 0
                    steps.append((_given(state)[1], "R", REROLE + more))
                    if initial in GRAMMAR[state]:
                        steps.append((GRAMMAR[state][initial], "K", KEEP + more))
                out += [(state, initial + fault, last, edit + more_edits, cost + more_cost) for now, edit, cost in steps for last, more_edits, more_cost in _inserted(now)]
    return out


_SOLVE = """
WITH RECURSIVE best AS (
  SELECT seg, entry, 0 AS n, state, {'cost': cost, 'audit': edits} AS found FROM entries JOIN starts USING (entry)
  UNION ALL
  SELECT b.seg, b.entry, b.n + 1, m.into_state, min({'cost': b.found.cost + m.cost, 'audit': b.found.audit || m.edits})
  FROM best b JOIN turns t ON t.seg = b.seg AND t.n = b.n + 1 JOIN moves m ON m.state = b.state AND m.kind = t.kind
  GROUP BY b.seg, b.entry, b.n, m.into_state
)
SELECT b.seg, b.entry, b.state, b.found.cost, b.found.audit FROM best b JOIN sizes s ON b.seg = s.seg AND b.n = s.n"""


class Solver:
    """The recursive query over batches of segments, in one in-memory database for each task."""

    def __init__(self):
        import duckdb

        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        self.db.execute("CREATE TABLE moves(state INT, kind VARCHAR, into_state INT, edits VARCHAR, cost BIGINT)")
        self.db.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", _moves())
        self.db.execute("CREATE TABLE starts(entry INT, state INT, edits VARCHAR, cost BIGINT)")
        self.db.executemany("INSERT INTO starts VALUES (?, ?, ?, ?)", [(s, *m) for s in GRAMMAR for m in _inserted(s)])

    def solve(self, kinds: list[list[str]], entries: Iterable[int]) -> list[dict[tuple[int, int], tuple[int, str]]]:
        """For each segment, (entry, state after it) -> (cost, audit)."""
        entries = list(entries)
        seg = [i for i, k in enumerate(kinds) for _ in k]
        tables = {
            "turns": pa.table({"seg": pa.array(seg, pa.int64()), "n": pa.array([n for k in kinds for n in range(1, len(k) + 1)], pa.int32()), "kind": pa.array([x for k in kinds for x in k], pa.string())}),
            "sizes": pa.table({"seg": pa.array(range(len(kinds)), pa.int64()), "n": pa.array(map(len, kinds), pa.int32())}),
            "entries": pa.table({"seg": pa.array([i for i in range(len(kinds)) for _ in entries], pa.int64()), "entry": pa.array(entries * len(kinds), pa.int32())}),
        }
        for name, table in tables.items():
            self.db.register(name, table)
        out: list[dict] = [{} for _ in kinds]
        for i, entry, state, cost, audit in self.db.execute(_SOLVE).fetchall():
            out[i][entry, state] = cost, audit
        for name in tables:
            self.db.unregister(name)
        return out


class Segment:
    """Turns of one conversation in order, with what is counted in them."""

    def __init__(self, key: tuple):
        self.key, self.turns, self.kinds, self.bytes = key, [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.numbers: list[int] = []  # distinct turn numbers
        self.last = None

    def add(self, turn: int | None, role: str, text: str, seen: bool, new_number: bool) -> None:
        said, fault = text.rstrip(SPACE), SOUND
        if not said.strip(SPACE):
            self.blank, fault = self.blank + 1, LOST
        elif seen:
            self.duplicate, fault = self.duplicate + 1, LOST
        elif said[-1] not in ".!?":
            self.truncated, fault = self.truncated + 1, CUT_SHORT
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and new_number:
            self.numbers.append(turn)
        self.kinds.append((initial if initial in ("s", "u", "a") else "x") + fault)
        self.turns.append((turn, role, text))
        self.bytes += len(text)


def edited(turns: list[tuple], state: int, audit: str) -> list[dict]:
    """Each edit with its turn: (edit, turn, role, text); the role and text are those after it."""
    out, rest = [], iter(turns)
    for edit in audit:
        turn, role, text = (None, "", "") if edit == "I" else next(rest)
        if edit in "IR":
            role, state = ROLES[_given(state)[0]], _given(state)[1]
        elif edit == "K":
            state = GRAMMAR[state][role[:1]]
        out.append({"edit": edit, "turn": turn, "role": role, "text": text})
    return out


_TURNS = pa.list_(pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_PARTS = "conv_id {kind}, part long, parts long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, turns array<struct<edit: string, turn: long, role: string, text: string>>"


def _batches(segments: Iterator[Segment]) -> Iterator[list[Segment]]:
    now, rows, size = [], 0, 0
    for s in segments:
        now.append(s)
        rows, size = rows + len(s.turns) + 1, size + s.bytes
        if rows >= BATCH_ROWS or size >= BATCH_BYTES:
            yield now
            now, rows, size = [], 0, 0
    if now:
        yield now


def _columns(rows: list[tuple], types: list) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)]


def _short(rows: DataFrame, kind: str) -> DataFrame:
    """One part for each conversation, whole conversations in a task."""

    def segments(batches: Iterator[pa.RecordBatch], types: list) -> Iterator[Segment]:
        now, seen = None, set()
        for b in batches:
            types[:] = [b.column(0).type]
            for conv, turn, role, text, kept in zip(*(b.column(i).to_pylist() for i in range(5))):
                if now is None or now.key != (conv,):
                    if now:
                        yield now
                    now, seen = Segment((conv,)), set()
                if kept:
                    now.add(turn, role, text, (role, text) in seen, turn not in now.numbers[-1:])
                    seen.add((role, text))
        if now:
            yield now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, types = None, []
        for some in _batches(segments(batches, types)):
            solver = solver or Solver()
            out = []
            for s, found in zip(some, solver.solve([s.kinds for s in some], [0])):
                cost, audit = min(found[0, x] for x in ACCEPTED if (0, x) in found)
                gaps = s.numbers[-1] - s.numbers[0] + 1 - len(s.numbers) if s.numbers else 0
                out.append((s.key[0], 0, 1, gaps, s.blank, s.duplicate, s.truncated, s.illegal, cost, audit, edited(s.turns, 0, audit)))
            names = ["conv_id", "part", "parts", *_COUNTS, "audit", "turns"]
            yield pa.RecordBatch.from_arrays(_columns(out, [types[0], *[pa.int64()] * 8, pa.string(), _TURNS]), names)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(arrow_task(run), _PARTS.format(kind=kind))


_MATRIX = pa.list_(pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
_SEGMENTS = "conv_id {kind}, unit long, cut long, first string, last string, low long, high long, numbers long, blank long, duplicate long, truncated long, illegal long, matrix array<struct<entry: int, state: int, cost: long, audit: string>>, turns array<struct<turn: long, role: string, text: string>>"


def _segments(rows: DataFrame, kind: str, segment: int, most: int) -> DataFrame:
    """Long conversations in segments, each with the best edits from each state to each other."""

    def segments(batches: Iterator[pa.RecordBatch], types: list) -> Iterator[Segment]:
        now, before = None, None
        for b in batches:
            types[:] = [b.column(0).type]
            for conv, unit, turn, role, text, first in zip(*(b.column(i).to_pylist() for i in range(6))):
                if now is None or now.key[:2] != (conv, unit):
                    if now:
                        yield now
                    now, before = Segment((conv, unit, 0)), None
                elif len(now.turns) >= segment or now.bytes >= most:
                    yield now
                    now = Segment((conv, unit, now.key[2] + 1))
                now.add(turn, role, text, turn != first or before == (turn, role, text), before is None or before[0] != turn)
                before = (turn, role, text)
        if now:
            yield now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, types = None, []
        for some in _batches(segments(batches, types)):
            solver = solver or Solver()
            out = []
            for s, found in zip(some, solver.solve([s.kinds for s in some], GRAMMAR)):
                matrix = [{"entry": e, "state": x, "cost": c, "audit": a} for (e, x), (c, a) in found.items()]
                out.append((*s.key, s.turns[0][1][:1], s.last, min(s.numbers, default=None), max(s.numbers, default=None), len(s.numbers), s.blank, s.duplicate, s.truncated, s.illegal, matrix, [{"turn": t, "role": r, "text": x} for t, r, x in s.turns]))
            types_ = [types[0], pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 7, _MATRIX, _ROWS]
            names = ["conv_id", "unit", "cut", "first", "last", "low", "high", "numbers", "blank", "duplicate", "truncated", "illegal", "matrix", "turns"]
            yield pa.RecordBatch.from_arrays(_columns(out, types_), names)

    dealt = rows.repartition("conv_id", "unit").sortWithinPartitions("conv_id", "unit", "turn", "role", "text")
    return dealt.select("conv_id", "unit", "turn", "role", "text", "first").mapInArrow(arrow_task(run), _SEGMENTS.format(kind=kind))


class Chain:
    """The best edits over the segments of one conversation so far, for each state: its cost and how
    its edits go on where those of the four states part; pointers back for each segment."""

    def __init__(self, conv):
        self.conv, self.keys, self.back, self.joints = conv, [], [], []
        self.best: dict[int, tuple[int, str]] = {0: (0, "")}
        self.last, self.low, self.high, self.numbers = None, None, None, 0

    def add(self, unit, cut, first, last, low, high, numbers, matrix) -> None:
        found: dict[int, tuple[int, str, int]] = {}
        for m in matrix:
            if m["entry"] in self.best:
                cost, audit = self.best[m["entry"]]
                new = (cost + m["cost"], audit + m["audit"], m["entry"])
                if m["state"] not in found or new < found[m["state"]]:
                    found[m["state"]] = new
        # A state that costs more than to go there from another can't be on the best way.
        done = min(c + (INSERT if s == 2 else 0) for s, (c, _, _) in found.items() if s in (2, 3))
        found = {s: f for s, f in found.items() if s > 1 or f[0] <= done + (DELETE if s == 0 else 0)}
        common = len(os.path.commonprefix([a for _, a, _ in found.values()]))
        self.best = {s: (c, a[common:]) for s, (c, a, _) in found.items()}
        self.back.append(bytes(found[s][2] if s in found else 9 for s in range(4)))
        self.joints.append(self.last is not None and self.last + first not in LEGAL)
        self.keys.append((unit, cut))
        self.last, self.numbers = last, self.numbers + numbers
        if low is not None:
            self.low, self.high = low if self.low is None else self.low, high

    def rows(self) -> list[tuple]:
        """(conv_id, unit, cut, part, parts, entry, state, joint, gaps) of each segment."""
        state = min((s for s in ACCEPTED if s in self.best), key=lambda s: self.best[s])
        gaps = self.high - self.low + 1 - self.numbers if self.low is not None else 0
        out = []
        for i in range(len(self.keys) - 1, -1, -1):
            entry = self.back[i][state]
            out.append((self.conv, *self.keys[i], i, len(self.keys), entry, state, int(self.joints[i]), 0 if i else gaps))
            state = entry
        return out


def _long(rows: DataFrame, kind: str, segment: int, most: int) -> DataFrame:
    """Parts of long conversations, dealt out by ranges of turns."""
    unit = F.floor(F.col("turn") / segment).cast("long")
    rows = rows.where("kept").select("conv_id", unit.alias("unit"), "turn", "role", "text", F.sha2("text", 256).alias("digest"))
    rows = materialise(rows, "turns-long")
    # The first turn of each role and text; a null turn comes before all others.
    by_number = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).getField("turn")
    first = rows.groupBy("conv_id", "role", "digest").agg(by_number.alias("first")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    marked = rows.join(first, rows.conv_id.eqNullSafe(first.c) & (rows.role == first.r) & (rows.digest == first.d))
    cut = materialise(_segments(marked, kind, segment, most), "turns-segments")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind_ = None, None
        names = ["conv_id", "unit", "cut", "part", "parts", "entry", "state", "joint", "gaps"]

        def table(c: Chain) -> Iterator[pa.RecordBatch]:
            found = c.rows()
            for a in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays(_columns(found[a : a + 10_000], [kind_, *[pa.int64()] * 8]), names)

        for b in batches:
            kind_ = b.column(0).type
            for conv, *rest in zip(*(b.column(i).to_pylist() for i in range(9))):
                if now is None or now.conv != conv:
                    if now:
                        yield from table(now)
                    now = Chain(conv)
                now.add(*rest)
        if now:
            yield from table(now)

    narrow = cut.select("conv_id", "unit", "cut", "first", "last", "low", "high", "numbers", "matrix")
    names = "conv_id {kind}, unit long, cut long, part long, parts long, entry long, state long, joint long, gaps long"
    ways = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "unit", "cut").mapInArrow(arrow_task(chain), names.format(kind=kind))
    ways = ways.select(*[F.col(c).alias(f"w_{c}") for c in ways.columns])
    same = cut.conv_id.eqNullSafe(ways.w_conv_id) & cut.unit.eqNullSafe(ways.w_unit) & (cut.cut == ways.w_cut)
    way = F.filter("matrix", lambda m: (m["entry"] == F.col("w_entry")) & (m["state"] == F.col("w_state")))[0]
    chosen = cut.join(ways, same).select("conv_id", "w_part", "w_parts", "w_gaps", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("w_joint")).alias("illegal"), way["cost"].alias("cost"), way["audit"].alias("audit"), "turns", "w_entry")

    def repair_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            audits, turns, entries = (b.column(i).to_pylist() for i in (9, 10, 11))
            done = [edited([(t["turn"], t["role"], t["text"]) for t in own], e, a) for own, e, a in zip(turns, entries, audits)]
            yield pa.RecordBatch.from_arrays([*b.columns[:10], pa.array(done, _TURNS)], ["conv_id", "part", "parts", *_COUNTS, "audit", "turns"])

    return chosen.mapInArrow(arrow_task(repair_part), _PARTS.format(kind=kind))


def _parts(rows: DataFrame, kept: Column | None, segment: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Parts of conversations that are one part, and of longer ones, where there are any."""
    bound_batches(rows.sparkSession)
    own = pick(rows, "conv_id", "turn", "role", "text") if kept is None else pick(rows.withColumn("__kept", kept), "conv_id", "turn", "role", "text", "__kept")
    kind = own.schema["conv_id"].dataType.simpleString()
    own = own.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.lit(True) if kept is None else F.coalesce("__kept", F.lit(False))).alias("kept"))
    size = own.where("kept").groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("b"))
    long = materialise(size.where((F.col("n") > segment) | (F.col("b") > most)).select("c"), "turns-ids")
    if long.isEmpty():
        return _short(own, kind), None
    same = own.conv_id.eqNullSafe(long.c)
    return _short(own.join(long, same, "left_anti"), kind), _long(own.join(long, same, "left_semi"), kind, segment, most)


def repair(rows: DataFrame, kept: Column | None = None, segment: int = SEGMENT, most: int = SEGMENT_BYTES) -> DataFrame:
    """Parts of all conversations: conv_id, part (from 0) and the number of parts, counts of faults and
    the cost in it, the edits' initials (audit), and each edit with its turn, role and text as repaired.

    Counts and costs of parts add up, and their audits follow each other. ``kept`` says which rows take
    part; others only name their conversation, which is reported also when it has no turn."""
    short, long = _parts(rows, kept, segment, most)
    return short if long is None else short.unionByName(long)


def report(rows: DataFrame, kept: Column | None = None, segment: int = SEGMENT, most: int = SEGMENT_BYTES) -> DataFrame:
    """One row a conversation: counts, cost, audit and the SHA-256 of its repaired turns. Conversations
    of one part stay where they are; others are read in order, a part at a time."""
    short, long = _parts(rows, kept, segment, most)
    out = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    said = F.transform(F.filter("turns", lambda t: t["edit"] != "D"), lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    whole = short.withColumn("repaired_sha256", F.sha2(F.array_join(said, "\n"), 256)).select(*out)
    if long is None:
        return whole
    kind = long.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, kind_, sums, audits, digest, begun = None, None, None, [], None, False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(_columns([(conv, *sums, "".join(audits), digest.hexdigest())], [kind_, *[pa.int64()] * 6, pa.string(), pa.string()]), out)

        for b in batches:
            kind_ = b.column(0).type
            for c, part, *counts, audit, turns in zip(*(b.column(i).to_pylist() for i in range(10))):
                if part == 0:
                    if sums:
                        yield row()
                    conv, sums, audits, digest, begun = c, [0] * 6, [], hashlib.sha256(), False
                sums = [a + x for a, x in zip(sums, counts)]
                audits.append(audit)
                for t in turns:
                    if t["edit"] != "D":
                        digest.update(f"{chr(10) if begun else ''}{t['role']}:{t['text']}".encode())
                        begun = True
        if sums:
            yield row()

    dealt = long.select("conv_id", "part", *_COUNTS, "audit", "turns").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.unionByName(dealt.mapInArrow(arrow_task(run), f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations damaged by a hash of id and turn: rows dropped (``kept`` false), emptied, without
    sentence ends, repeated or given to the user."""
    own = pick(rows, "conv_id", "turn", "role", "text")
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in own.columns}
    case = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"])) % 20
    own = own.select("conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"), case.alias("case"))
    said = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).when(F.col("case") != 0, F.col("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.col("case") != 0, F.when(F.col("case") == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", role.alias("role"), said.alias("text"), copies.alias("kept"))


def sql() -> str:
    """The report on damaged ``conversations``, by four columns of one state each instead of a table of moves."""

    def then(state: str, edit: str, cost: str, said: str = "''") -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{edit}', 'said': {state}.said || {said}}} END"

    line, more = "role || ':' || said || chr(10)", "CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END"
    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"

    def stay(state: str, initial: str) -> str:
        return f"CASE WHEN i = '{initial}' AND fault NOT IN ('blank', 'duplicate') THEN {then(state, 'K', more, line)} END"

    def change(state: str, role: str) -> str:
        return f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {then(state, 'R', '2 + ' + more, f"'{role}:' || said || chr(10)")} END"

    to_user = [f(s, x) for s in ("c0", "c1", "c3") for f, x in ((stay, "u"), (change, "user"))]
    step = {
        "o0": then("c0", "D", "3"),
        "o1": f"least({then('c1', 'D', '3')}, {stay('c0', 's')})",
        "o2": f"least({', '.join([then('c2', 'D', '3'), *to_user])})",
        "o3": f"least({then('c3', 'D', '3')}, {stay('c2', 'a')}, {change('c2', 'assistant')})",
    }
    insert = f"""o0 AS c0, o1 AS c1, least(o2, {', '.join(then(s, 'I', '2', user) for s in ('o0', 'o1', 'o3'))}) AS c2,
    least(o3, {then('o2', 'I', '2', assistant)}, {', '.join(then(s, 'II', '4', user + ' || ' + assistant) for s in ('o0', 'o1'))}) AS c3"""
    begin = "{'cost': 0, 'audit': '', 'said': ''}"
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), cases AS (
  SELECT *, xor(4294967295, list_reduce(list_transform(range(8 * len(name)), lambda j: CASE WHEN j % 8 = 0 THEN unicode(name[(j // 8 + 1)::INT]) ELSE 0 END::BIGINT),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT)) % 20 AS x FROM named
), hurt AS (
  SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS said
  FROM cases, range(CASE x WHEN 3 THEN 2 ELSE 1 END) WHERE x <> 0
), placed AS (
  SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) AS n FROM hurt
), counted_out AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, said ORDER BY n) AS nth FROM placed
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(said, '[^ 	-
]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(said, '[.!?]{space}*$') THEN 'truncated' ELSE '' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM counted_out
), counted AS (
  SELECT conv_id, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
), best AS (
  SELECT conv_id, 0::BIGINT AS n, {insert}
  FROM (SELECT conv_id, {begin} AS o0, CASE WHEN false THEN {begin} END AS o1, CASE WHEN false THEN {begin} END AS o2, CASE WHEN false THEN {begin} END AS o3 FROM (SELECT DISTINCT conv_id FROM conversations))
  UNION ALL
  SELECT conv_id, n, {insert}
  FROM (SELECT best.conv_id, judged.n, {', '.join(f"{e} AS {c}" for c, e in step.items())} FROM best JOIN judged ON judged.conv_id IS NOT DISTINCT FROM best.conv_id AND judged.n = best.n + 1)
), final AS (
  SELECT conv_id, n, least(c0, c3) AS c FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1
)
SELECT f.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, f.c.cost::BIGINT AS cost, f.c.audit AS audit, sha256(CASE WHEN f.c.said = '' THEN '' ELSE left(f.c.said, length(f.c.said) - 1) END) AS repaired_sha256
FROM final f LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM f.conv_id"""
