"""Pattern packing against the tokenizer library and against plain best fit."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import packing, patterns, queries


def plain_best_fit(lengths, length):
    """The number of sequences of best fit, longest first, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(length - n)
    return len(rooms)


def check_slots(slots, counts, length):
    """Every piece has one place, and sequences hold their pieces without gaps; gives their number."""
    at, seen = {}, [0] * (length + 1)
    for n, first, base, count, copies, offset in slots.tolist():
        assert first == seen[n]
        seen[n] += count * copies
        for i in range(count):
            at.setdefault(base + i, []).extend((offset + k * n, n) for k in range(copies))
    assert seen == counts.tolist()
    for pieces in at.values():
        here = 0
        for offset, n in sorted(pieces):
            assert offset == here
            here += n
        assert here <= length
    return len(at)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_plan_of_any_lengths(lengths):
    counts = np.bincount(lengths, minlength=65).astype(np.int64)
    n = check_slots(patterns.plan(counts, 64, 16, 3), counts, 64)
    assert -(-sum(lengths) // 64) <= n <= plain_best_fit(lengths, 64) + 2 + n // 20


def test_plan_by_patterns():
    # 30 times 40 + 24 and 20 times 30 + 20 + 14: patterns of two and three pieces, and nothing else.
    counts = np.bincount([40, 24] * 30 + [30, 20, 14] * 20, minlength=65).astype(np.int64)
    assert check_slots(patterns.plan(counts, 64, 64, 3), counts, 64) == 50
    assert sum(n for _, n in patterns.repeats(counts, 64, 64, 3)) >= 45
    assert patterns.plan(np.zeros(65, np.int64), 64).tolist() == []


def test_patterns_fill_a_sequence():
    every = [p for k in (1, 2, 3) for p in patterns.patterns(8, 3, 8) if len(p) == k]
    assert len(set(every)) == len(every)
    want = {(a,) for a in range(1, 9) if a == 8} | {(a, b) for a in range(1, 9) for b in range(1, a + 1) if a + b == 9} | {(a, b, c) for a in range(1, 9) for b in range(1, a + 1) for c in range(1, b + 1) if a + b + c == 9}
    assert set(every) == want


def test_least_squares_against_a_grid():
    a, b = np.array([[2.0, 1.0], [0.0, 1.0], [1.0, 0.0]]), np.array([1.0, -3.0, 2.0])
    x = patterns.least_squares(a, b)
    grid = [np.array([i, j]) / 100 for i in range(300) for j in range(300)]
    assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= min(np.linalg.norm(a @ g - b) for g in grid) + 1e-9


def check_pieces(rows, texts, path, length=4096):
    t = packing.tokenizer(path)
    want = {i: t.full.encode(x or "", add_special_tokens=False).ids + [1] for i, x in texts.items()}
    of, at = {}, {}
    for p in rows:
        of.setdefault(p.doc_id, []).append(p)
        at.setdefault(p.sequence_id, []).append(p)
    assert of.keys() == want.keys()
    for i, ps in of.items():
        assert [(p.piece, p.start) for p in sorted(ps, key=lambda p: p.piece)] == [(k, k * length) for k in range(-(-len(want[i]) // length))]
        for p in ps:
            ids = want[i][p.start : p.start + length]
            assert p.length == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    for ps in at.values():
        here = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == here
            here += p.length
        assert here <= length
    return len(at)


@pytest.mark.parametrize("length", [4096, 128])
def test_pattern_packing(spark, small, length):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(5)
    path = queries.vocabulary()
    rows = patterns.pack(docs, path, length).collect()
    n = check_pieces(rows, {r.doc_id: r.text for r in docs.collect()}, path, length)
    assert n <= 1.01 * plain_best_fit([r["length"] for r in rows], length) + 1
    again = patterns.pack(docs.repartition(2), path, length).collect()
    assert len({r.sequence_id for r in again}) == n


def test_pattern_packing_odd_rows(spark, odd_docs):
    path = queries.vocabulary()
    some = odd_docs.where("doc_id IS NOT NULL AND doc_id <> 2")
    check_pieces(patterns.pack(some, path).collect(), {r.doc_id: r.text for r in some.collect()}, path)
    assert patterns.pack(odd_docs, path).agg(F.count_if(F.col("piece") == 0)).first()[0] == 12
    assert patterns.pack(odd_docs.limit(0), path).collect() == []


def test_one_length_may_be_all(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the mill was still").alias("text")).repartition(7)
    path = queries.vocabulary()
    rows = patterns.pack(docs, path).collect()
    n = rows[0]["length"]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3000 and len({r.sequence_id for r in rows}) == -(-3000 // (4096 // n))
