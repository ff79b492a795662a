"""Exact top-k search by inner product with a vector-approximation file.

Each component x becomes floor(256 * x). The approximation file holds a vector's cells, a byte
each: ``CELLS`` cells of equal width where most components lie, the first and the last reaching to
the least and the greatest of all. The file is written once and stays where it is; queries are sent
to it in blocks of at most ``BLOCK`` vectors and ``BLOCK_BYTES`` bytes.

A block is scanned twice. The first scan keeps, in each task, the k + 1 greatest lower bounds of a
query's inner products; the k + 1-th greatest of all tasks is the query's floor. The second scan
emits only vectors whose upper bound reaches it, so nothing is written of other pairs. The exact
vectors of these are read in the order of their upper bounds, ``FIRST`` of them at first; then all
whose upper bound still reaches the k-th exact score. So the k-th result is certain.

Equal vectors are searched as one: it keeps its k + 1 smallest ids, which are all that can win a
tie, and its results are shared by its queries.

Vectors that are null or hold a null or non-finite component take no part, neither do null ids.
All others do: sums too great for a long are made as decimals, kept in their exact order and shown
as the nearest long; an integer component beyond 2^55 counts as 2^55 of its sign. Vectors of another
length than a query's are no candidates for it, and empty ones meet empty ones with score 0. Rows
that repeat an id and vector count once, and no row of the query's own id is its candidate. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_task, bound_batches, drop_table, materialise, pick

K = 5
CELLS = 256
BLOCK, BLOCK_BYTES, CHUNK = 2048, 16 << 20, 2048
FIRST = 16
#: Integer components are bounded by this, far above what a score that fits a long can hold.
MOST = float(1 << 55)


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part."""
    v = F.transform(F.col("embedding"), lambda x: F.floor(F.greatest(F.least(x.cast("double") * 256, F.lit(MOST)), F.lit(-MOST))))
    sound = F.forall(F.col("embedding"), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = pick(vectors, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(sound)
    return rows.select("vec_id", v.alias("v"))


class Cells:
    """Equal cells between ``low`` and ``high``; the outer ones reach to ``least`` and ``most``."""

    def __init__(self, least: float, low: float, high: float, most: float, n: int):
        self.low, self.n = low, n
        self.width = max(1.0, (high - low + 1) / n)
        edges = low + self.width * np.arange(n + 1, dtype=np.float64)
        edges[0], edges[-1] = min(edges[0], least), max(edges[-1], most)
        self.middle, self.half = (edges[1:] + edges[:-1]) / 2, (edges[1:] - edges[:-1]) / 2
        self.greatest = max(abs(edges[0]), abs(edges[-1]))

    def of(self, v: list[int]) -> bytes:
        return np.clip((np.array(v, np.float64) - self.low) // self.width, 0, self.n - 1).astype(np.uint8).tobytes()

    def bounds(self, q: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the inner products of queries with vectors of these cells."""
        middle = q @ self.middle[cells].T
        size = np.abs(q)
        total = size.sum(axis=1)[:, None]
        spread = total * self.half[0] if self.half.min() == self.half.max() else size @ self.half[cells].T
        # What rounding can add: far more than the last bits of a sum of so many products.
        spread = spread + 1e-6 + total * self.greatest * 1e-13 * (cells.shape[1] + 8)
        return middle - spread, middle + spread


def _packed(rows: DataFrame, cells: Cells) -> DataFrame:
    """(key, cells): the approximation file, with a byte per component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([cells.of(v) for v in b.column(1).to_pylist()], pa.binary())], ["key", "cells"])

    return rows.select("key", "v").mapInArrow(arrow_task(run), "key long, cells binary")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, keys, cells) of vectors of one length."""
    for b in batches:
        keys, cells = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
        sizes = np.array([len(c) for c in cells])
        for size in np.unique(sizes):
            of = np.flatnonzero(sizes == size)
            for a in range(0, len(of), CHUNK):
                at = of[a : a + CHUNK]
                yield int(size), keys[at], np.frombuffer(b"".join(cells[i] for i in at), np.uint8).reshape(len(at), int(size))


def _floors(file: DataFrame, shared, cells: Cells, k: int) -> DataFrame:
    """(query, least): the k-th greatest lower bound of each query of a block; none where it has fewer candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for size, _, own in _chunks(batches):
            if size in shared.value:
                lower = cells.bounds(shared.value[size][1], own)[0]
                if size in best:
                    lower = np.hstack([best[size], lower])
                best[size] = -np.partition(-lower, k - 1, axis=1)[:, :k] if lower.shape[1] > k else lower
        for size, lower in best.items():
            queries = shared.value[size][0]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, lower.shape[1])), pa.array(lower.ravel())], ["query", "lower"])

    found = file.mapInArrow(arrow_task(run), "query long, lower double")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower")))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).where(F.col("nth") == k).select("query", F.col("lower").alias("least"))


def _reach(file: DataFrame, shared, floors, cells: Cells) -> DataFrame:
    """(query, key, upper) of the vectors whose upper bound reaches the query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, keys, own in _chunks(batches):
            if size in shared.value:
                queries, q = shared.value[size]
                least = np.array([floors.value.get(int(x), -np.inf) for x in queries])
                upper = cells.bounds(q, own)[1]
                i, j = np.nonzero(upper >= least[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(queries[i]), pa.array(keys[j]), pa.array(upper[i, j])], ["query", "key", "upper"])

    return file.mapInArrow(arrow_task(run), "query long, key long, upper double")


def _candidates(file: DataFrame, asked: DataFrame, cells: Cells, k: int, block: int, longest: int) -> list[DataFrame]:
    """(query, key, upper) of all queries, a written table for each block."""
    context = file.sparkSession.sparkContext
    block = max(1, min(block, BLOCK_BYTES // (8 * max(1, longest))))
    n = -(-asked.count() // block)
    out = []
    for k_th in range(n):
        rows = (asked if n == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(n)) == k_th)).select("query", "q").collect()
        of: dict[int, list] = {}
        for r in rows:
            of.setdefault(len(r.q), []).append(r)
        shared = context.broadcast({size: (np.array([r["query"] for r in some], np.int64), np.array([r.q for r in some], np.float64).reshape(len(some), size)) for size, some in of.items()})
        floors = context.broadcast({r["query"]: r.least for r in _floors(file, shared, cells, k).collect()})
        out.append(materialise(_reach(file, shared, floors, cells), "vafile-reach"))
        shared.destroy()
        floors.destroy()
    return out


def search(vectors: DataFrame, is_query: Column, k: int = K, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows, ties to smaller ids."""
    bound_batches(vectors.sparkSession)
    rows = materialise(integers(vectors).distinct().withColumn("hash", F.xxhash64("v")), "vafile-vectors")
    span = rows.select(F.array_min("v").alias("a"), F.array_max("v").alias("b"), F.size("v").alias("n"))
    span = span.agg(F.min("a").alias("least"), F.percentile_approx("a", F.lit(0.01), F.lit(1000)).alias("low"), F.percentile_approx("b", F.lit(0.99), F.lit(1000)).alias("high"), F.max("b").alias("most"), F.max("n").alias("n")).first()
    least, low, high, most, longest = (int(x) if x is not None else 0 for x in span)
    table = Cells(least, min(low, high), max(low, high), most, cells)
    # The integer vector itself is the key; its hash only deals rows out.
    nth = Window.partitionBy("hash", "v").orderBy("vec_id")
    near = rows.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k + 1)
    distinct = near.groupBy("hash", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    distinct = materialise(distinct.withColumn("key", F.expr("ids[0]")), "vafile-distinct")
    asked = rows.where(is_query).select("hash", "v").distinct().join(distinct.select("hash", "v", "key"), ["hash", "v"]).select(F.col("key").alias("query"), F.col("v").alias("q"))
    asked = materialise(asked, "vafile-queries")
    file = materialise(_packed(distinct, table), "vafile-cells")
    parts = _candidates(file, asked, table, k + 1, block, longest)
    left = asked.sparkSession.createDataFrame([], "query long, key long, upper double") if not parts else parts[0]
    for more in parts[1:]:
        left = left.unionByName(more)
    order = Window.partitionBy("query").orderBy(F.desc("upper"), "key")
    # Only the first of a query are put in order, of parts of its candidates and then of these: a
    # query may have very many near to it.
    part = Window.partitionBy("query", "part").orderBy(F.desc("upper"), "key")
    ahead = left.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(FIRST))).withColumn("place", F.row_number().over(part)).where(F.col("place") <= FIRST)
    ahead = materialise(ahead.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST).select("query", "key"), "vafile-ahead")
    drop_table(file)
    if max(abs(least), abs(most)) ** 2 * max(1, longest) < 1 << 62:
        dot = F.expr("aggregate(zip_with(v, q, (x, y) -> x * y), 0L, (s, x) -> s + x)")
    else:
        dot = F.expr("aggregate(zip_with(v, q, (x, y) -> CAST(x AS DECIMAL(19,0)) * CAST(y AS DECIMAL(19,0))), CAST(0 AS DECIMAL(38,0)), (s, x) -> CAST(s + x AS DECIMAL(38,0)))")

    def exact(candidates: DataFrame) -> DataFrame:
        return candidates.join(distinct.select("key", "v"), "key").join(asked, "query").select("query", "key", dot.alias("score"))

    first = materialise(exact(ahead), "vafile-first")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    kth = first.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") == k + 1).select("query", F.col("score").alias("kth"))
    rest = left.join(kth, "query").where("upper >= kth").join(ahead, ["query", "key"], "left_anti")
    scored = first.unionByName(exact(rest))
    scored = scored.withColumn("nth", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("nth") <= k + 1)
    # A key stands for its ids, all of one score; the k + 1 best ids hold the k best others of any query.
    ids = scored.join(distinct.select("key", "ids"), "key").select("query", "score", F.explode("ids").alias("vec_id"))
    best = ids.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= k + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))
    lists = materialise(lists.join(distinct.select("hash", "v", F.col("key").alias("query")), "query").select("hash", "v", "best"), "vafile-lists")
    queries = rows.where(is_query).select("hash", "v", F.col("vec_id").alias("query_id")).join(lists, ["hash", "v"])
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = queries.select("query_id", F.posexplode(others).alias("at", "x"))
    score = -F.col("x.s")
    if dict(lists.dtypes)["best"].count("decimal"):
        score = F.least(F.greatest(score, F.lit(-(1 << 63)).cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), score.alias("score"))
