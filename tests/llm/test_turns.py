"""Conversation repair against all edits in order of cost, and against its SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile("(s?(ua)+)?")


def plain_edits(rows):
    """The cheapest (cost, audit, repaired lines) by a search that knows only the pattern of initials."""
    seen, faults = set(), []
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    least = {}
    heap = [(0, "", 0, "", ())]
    best = None
    while heap:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        # Only how the initials end matters to what may follow: nothing, one system turn, a user's or an assistant's.
        state = (i, initials[-1:] if initials != "s" else "S")
        if (cost, audit) > least.setdefault(state, (cost, audit)):
            continue
        if i == len(rows) and PATTERN.fullmatch(initials):
            best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
            continue
        steps = [(2, "I", i, r, f"{r}:") for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            steps.append((3, "D", i + 1, None, None))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                steps += [(more, "K", i + 1, role, f"{role}:{text}")] + [(2 + more, "R", i + 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for price, edit, at, role, line in steps:
            longer = initials + (role[:1] if role else "")
            # Initials that no longer start a legal sequence are given up.
            if PATTERN.fullmatch(longer) or PATTERN.fullmatch(longer + "a") or PATTERN.fullmatch(longer + "ua"):
                if role is None or role[:1]:
                    heapq.heappush(heap, (cost + price, audit + edit, at, longer, lines if line is None else (*lines, line)))
    return best, faults


def plain_report(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(([r[1:4] for r in rows if r[0] == conv and r[4]]), key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        (cost, audit, lines), faults = plain_edits(own)
        numbers = [t[0] for t in own if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [t[1][:1] for t in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, int(cost), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        for _ in range(2 if case == 3 else 1):
            yield conv, turn, "user" if case == 4 else role, text, case != 0


def some_conversations(n, longest, seed=1):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why", "  \t", "", "So it is?  ", "And then", "é.", "Fine."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "u"]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            rows.append((c if c else None, rng.choice([t, t, t + 3, None]), rng.choice(roles[: 8 if c % 3 else 4]), rng.choice(texts) if c % 2 else f"{rng.choice(texts)} {t}."))
    return rows


@pytest.mark.parametrize(("segment", "most"), [(turns.SEGMENT, turns.SEGMENT_BYTES), (3, 1000), (100, 6)])
def test_repair_against_all_edits(spark, segment, most):
    rows = some_conversations(60, 9) + [(900, t, None, None) for t in range(3)] + [(901, 0, "user", "Yes.")] * 3 + [(902, 5, "system", "Yes."), (903, None, "assistant", "Yes.")]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Yes."))
    damaged = list(plain_damage(rows))
    df = spark.createDataFrame([r[:4] for r in rows], SCHEMA).withColumns({c: F.lit("extra") for c in ("kept", "part", "seg", "n", "c", "case", "unit")})
    got = {r[0]: tuple(r)[1:] for r in turns.report(turns.damaged(df), F.col("kept"), segment, most).collect()}
    assert got == plain_report(damaged)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation_in_parts(spark):
    rows = [(1, t, "user" if t % 5 else "assistant", f"Word {t % 37}." if t % 11 else "open") for t in range(600)] + [(2, 0, "user", "A."), (2, 1, "assistant", "B.")]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, turns.report(df, segment=1000).collect()))
    assert whole == sorted(map(tuple, turns.report(df, segment=16).collect()))
    parts = turns.repair(df, segment=16).where("conv_id = 1").orderBy("part").collect()
    assert len(parts) == parts[0].parts == 38 and "".join(p.audit for p in parts) == whole[0][7]
    lines = [f"{t.role}:{t.text}" for p in parts for t in p.turns if t.edit != "D"]
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == whole[0][8]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "user", " "), (1, 4, "assistant", "It was")]
    (row,) = turns.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(t.edit, t.turn, t.role, t.text) for t in row.turns] == [("K", 0, "system", "Be brief."), ("I", None, "user", ""), ("K", 1, "assistant", "Hello."), ("K", 2, "user", "Hi."), ("D", 3, "user", " "), ("K", 4, "assistant", "It was")]
    assert (row.cost, row.blank, row.truncated, row.illegal, row.gaps) == (6, 1, 1, 2, 0)
    assert turns.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    (empty,) = turns.report(spark.createDataFrame(rows, SCHEMA), F.lit(False)).collect()
    assert tuple(empty)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y" * 3_000_000), (1, 2, "user", "x" * 3_000_000 + ".")]
    (row,) = turns.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (row.duplicate, row.truncated, row.cost, row.audit) == (1, 1, 4, "KKD")
    assert row.repaired_sha256 == hashlib.sha256(f"user:{rows[0][3]}\nassistant:{rows[1][3]}".encode()).hexdigest()


def test_sql(spark, tmp_path):
    rows = some_conversations(40, 8, seed=5)
    df = spark.createDataFrame(rows, SCHEMA)
    db = duckdb.connect()
    db.register("conversations", df.toArrow())
    want = sorted(db.execute(turns.sql()).fetchall(), key=str)
    assert sorted(map(tuple, turns.report(turns.damaged(df), F.col("kept")).collect()), key=str) == want
