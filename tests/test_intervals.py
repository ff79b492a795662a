"""As-of joins, sweeps and islands against plain loops, with few and many parts."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.markers import merge_spans
from quillspark.operators import intervals


@pytest.fixture(params=[1, 5])
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param == 1)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def some_spans(n, seed, most=60):
    """Spans of a hot key and others; ties and repeats are frequent."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randint(0, most)
        out.append((rng.choice([1, 1, 1, 2, 3, None]), a, a + rng.randint(1, 9)))
    return out


def test_as_of(spark, parts):
    rng = random.Random(2)
    starts = [(k, a, f"{k}/{a}/{i}") for i, (k, a, _) in enumerate(some_spans(90, 1))] + [(1, None, "none")]
    points = [(rng.choice([1, 1, 2, 3, 4, None]), rng.choice([None, *range(-3, 80)]), i) for i in range(200)]
    got = intervals.as_of(spark.createDataFrame(points, "k int, at int, i int"), spark.createDataFrame(starts, "k int, s int, name string"), "k", "at", "s", "name")
    assert got.columns == ["k", "at", "i", "s", "name"]
    for k, at, i, s, name in map(tuple, got.collect()):
        before = sorted((a, n) for k2, a, n in starts if k2 == k and a is not None and at is not None and a <= at)
        assert (s, name) == (before[-1] if before else (None, None)), i
    assert got.count() == len(points)


def test_lines_of_offsets(spark, parts):
    text = "\n".join("x" * random.Random(i).randint(0, 5) for i in range(50))
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
    lines = spark.createDataFrame([(1, a, n) for n, a in enumerate(starts)], "k int, s int, line_no int")
    points = spark.createDataFrame([(1, i) for i in range(len(text))], "k int, at int")
    for _, at, s, n in map(tuple, intervals.as_of(points, lines, "k", "at", "s", "line_no").collect()):
        assert n == bisect.bisect_right(starts, at) - 1 and s == starts[n]


def test_overlaps(spark, parts):
    spans, probes = some_spans(150, 3) + [(1, None, 4), (1, 5, 5), (2, 9, 3)], some_spans(80, 4) + [(1, 5, 5), (1, None, 3), (9, 0, 99)]
    got = intervals.overlaps(spark.createDataFrame(spans, "k int, start int, stop int"), spark.createDataFrame(probes, "k int, start int, stop int"), "k")
    real = [(k, a, b) for k, a, b in spans if a is not None and a < b]
    want = [(k, a, b, sum(k2 == k and x < b and y > a for k2, x, y in real) if a is not None else 0) for k, a, b in probes]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_merge(spark, parts):
    spans = some_spans(120, 5) + [(7, 0, 10), (7, 10, 12), (7, 3, 4), (7, 12, 12), (8, None, 1)]
    got = intervals.merge(spark.createDataFrame(spans, "k int, start int, stop int"), "k").collect()
    for key in {k for k, _, _ in spans}:
        own = [(a, b) for k, a, b in spans if k == key and a is not None]
        assert sorted((r.start, r.stop) for r in got if r.k == key) == merge_spans(own)
        assert sum(r.n for r in got if r.k == key) == len(own)


def test_numbers(spark, parts):
    rows = [(random.Random(i).choice([1, 1, 1, 2, None]), f"{i * 7 % 101:03}") for i in range(101)]
    got = intervals.numbered(spark.createDataFrame(rows, "k int, o string"), "k", "o", "nth").collect()
    for key in {k for k, _ in rows}:
        assert [r.nth for r in sorted((r for r in got if r.k == key), key=lambda r: r.o)] == list(range(1, 1 + sum(k == key for k, _ in rows)))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, start int, stop int")
    some = spark.createDataFrame([(1, 2, 3)], "k int, start int, stop int")
    assert intervals.merge(none, "k").collect() == [] and intervals.overlaps(none, some, "k").collect() == [(1, 2, 3, 0)] and intervals.overlaps(some, none, "k").collect() == []
    assert intervals.as_of(some.select("k", F.col("start").alias("at")), none, "k", "at", "start").collect() == [(1, 2, None)]
