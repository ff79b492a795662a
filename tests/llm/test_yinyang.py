"""Vector codes against Lloyd rounds in plain integers and against their SQL."""

import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import yinyang


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error) of each row and the digest, by all distances of Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    kept = [r for r in kept[:1] + kept[1:] if len(r[1]) == len(kept[0][1])]
    dim = len(kept[0][1])
    vectors = [[math.floor(Fraction(x) * 1024) for x in r[1]] for r in kept]
    cut = [[v[dim * p // parts : dim * (p + 1) // parts] for p in range(parts)] for v in vectors]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(near(p, c[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(own[i]) for col in zip(*own[i])] if i in own else e for i, e in enumerate(books[p])]
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for r, e in zip(kept, errors):
        total[r[2]] = total.get(r[2], 0) + e
    top = (1 << 63) - 1
    out = [(r[0], "".join(f"{i:02x}" for _, i in f), min(e, top), min(total[r[2]], top)) for r, f, e in zip(kept, found, errors)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def check(spark, rows, kind="array<double>", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int").repartition(3)
    got = yinyang.compress(df.withColumns({c: F.lit("extra") for c in ("codes", "error", "l", "scanned")}), **how).collect()
    want, digest = plain_codes(rows, **how)
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=str) == sorted(want, key=str)
    assert {r.codebooks_sha256 for r in got} == ({digest} if want else set())


def test_codes_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    # Few different integers, so distances tie often, and copies of one vector.
    rows = [(i, [float(x) / 1024 for x in rng.integers(-3, 4, 8)], int(i % 3) if i % 5 else None) for i in range(400)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(200)] + [(5, rows[9][1], 2), (5, rows[9][1], 2), (None, rows[11][1], None), (None, rows[11][1], 0)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [None] * 8, 1), (2003, [float("nan")] * 8, 1), (2004, [float("inf")] * 8, 1), (2005, [0.5] * 4, 1)]
    check(spark, rows, entries=32)
    check(spark, rows[:20], entries=32)
    check(spark, [], entries=32)
    check(spark, [(1, [], 1), (2, [], None)])


@pytest.mark.parametrize("scale", [1.0, 5e3, 1e12, 1e200])
def test_codes_of_wide_numbers(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) * (scale if i % 9 == 1 else 1) for x in rng.normal(size=10)], i % 4) for i in range(120)]
    check(spark, rows, entries=16)
    check(spark, [(i, [x * scale for x in v], c) for i, v, c in rows[:60]], entries=16)


def test_bounds_leave_out_most_distances(spark, small):
    rows = spark.read.parquet(f"{small}/../sf0.01/embeddings.parquet")
    books = yinyang.train(rows, rounds=0)[1]
    coded = yinyang._assign(rows, books, 64, True)
    n, scanned = rows.count(), []
    for _ in range(3):
        books = yinyang._means(coded, books, 64)
        coded = yinyang._assign(coded, books, 64, False)
        scanned.append(coded.agg(F.sum("scanned")).first()[0] / (n * 4 * 256))
    assert scanned[-1] < 0.6, scanned


def test_next_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.integers(-500, 500, (300, 6)).astype(float)
    book = yinyang.Codebook(rng.integers(-500, 500, (64, 6)).tolist())
    state = yinyang.first_bounds(book, x)[:3]
    for _ in range(6):
        book = book.moved((book.points + rng.integers(-9, 10, book.points.shape)).astype(int).tolist())
        *state, _ = yinyang.next_bounds(book, x, *state)
        d = np.sqrt(book.squared(x, np.arange(64)))
        code, upper, lower = state
        assert (code == d.argmin(axis=1)).all() and (upper >= d.min(axis=1) - 1e-9).all()
        d[np.arange(300), code] = np.inf
        for g, own in enumerate(book.groups):
            assert (lower[:, g] <= d[:, own].min(axis=1) + 1e-9).all()


def test_sql(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    db = duckdb.connect()
    db.register("embeddings", rows.toArrow())
    want = sorted(db.execute(yinyang.sql()).fetchall(), key=str)
    got = yinyang.compress(rows).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == want
