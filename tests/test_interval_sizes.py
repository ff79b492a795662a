"""what the sorted passes hold and move follows the rows of a part, not the table."""

import random
import re

from pyspark.sql import functions as F

from quillspark.operators import intervals


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    """a larger table is sorted by more tasks, and no row moves to meet what parts before bring along; same results."""
    rng = random.Random(3)
    starts = [(rng.choice([1, 1, 2, None]), rng.randint(0, 400), i) for i in range(300)]
    points = [(rng.choice([1, 2, 3, None]), rng.choice([None, rng.randint(-5, 420)]), f"p{i}") for i in range(400)]
    s, p = spark.createDataFrame(starts, "k int, s long, i int"), spark.createDataFrame(points, "k long, at int, name string")
    found = []
    for rows in (1 << 22, 10):
        monkeypatch.setattr(intervals, "TASK_ROWS", rows)
        out = intervals.as_of(p, s, "k", "at", "s", "i")
        assert out.dtypes == [("k", "bigint"), ("at", "int"), ("name", "string"), ("s", "bigint"), ("i", "int")]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
        if rows == 10:
            assert max(int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan)) == 70
        found.append(sorted(map(str, out.collect())))
    want = []
    for k, at, name in points:
        before = sorted((a, i) for k2, a, i in starts if k2 == k and at is not None and a <= at)
        want.append((k, at, name, *(before[-1] if before else (None, None))))
    assert found[0] == found[1] == sorted(f"Row(k={k!r}, at={at!r}, name={n!r}, s={x!r}, i={i!r})" for k, at, n, x, i in want)


def test_a_row_a_part_is_carried(spark):
    """the table that is sent to all tasks has a row for each part that continues a key, however many keys there are."""
    rows = spark.range(3000).select((F.col("id") % 500).alias("k"), F.col("id").alias("at"))
    parts = intervals.dealt(rows, "k", "at")
    continued = parts.select("k", intervals.PART).distinct().groupBy("k").count().agg(F.sum(F.col("count") - 1)).first()[0]
    assert continued < parts.select(intervals.PART).distinct().count()


def test_patterns_once(spark, tmp_path, monkeypatch):
    """spans and probes are made of one table of lines, so no line is searched twice."""
    from quillspark import catalog

    spark.createDataFrame([(1, "a b\nc 1999 d"), (2, None), (3, "pp. 7 [1]\n\n")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    read = []
    whole = catalog.paper_lines
    monkeypatch.setattr(catalog, "paper_lines", lambda *a: read.append(a) or whole(*a))
    got = {(r.doc_id, r.line_no): r.n for r in catalog.span_overlaps(spark, str(tmp_path)).collect()}
    assert len(read) == 1
    rows = whole(spark, str(tmp_path)).select("doc_id", "line_no", "start_char", F.length("line").alias("n"), "features").collect()
    spans = [(r.doc_id, r.start_char - 20 * r.features, r.start_char + r.n + 1 + 25 * (r.features - 1)) for r in rows if r.features > 0]
    assert got == {(r.doc_id, r.line_no): sum(d == r.doc_id and a < b and a < r.start_char + r.n and b > r.start_char for d, a, b in spans) for r in rows}


def test_sums_of_split_keys_only(spark):
    """what is sorted for the sums of parts is the rows of keys that lie in several parts."""
    rows = spark.range(4000).select((F.col("id") % 500).alias("k"), F.col("id").alias("at"))
    parts = intervals.dealt(rows, "k", "at")
    out = intervals.running(parts, "k", ["at"], last=("last", F.struct("at"), True), n=("sum", F.lit(1), True))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    for r in out.collect():
        assert r["last"].at == r.at and r.n == r.at // 500 + 1
