"""Offsets, spans and ranks of many rows a document, by sorted passes instead of joins of pairs.

All of them read rows in the order of (key, place). Rows are dealt out by ranges of that order, so a
document of any size is split over tasks; within a task a window runs over its part of a key, and
what the parts of the key before it bring along (a sum, a maximum, a last value) is worked out from
one row for each part and joined to it.

A null key is a key like any other. Rows whose place is null come before all places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.tables import materialise

PART = "__part"
#: Rows that a task sorts, about: there are more tasks where a table has more.
TASK_ROWS = 1 << 22


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` by ranges of ``order``, as a written table with the number of the part that each lies in."""
    return materialise(rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), "intervals-dealt")


def _carried(kind: str, within: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.coalesce(within, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return F.greatest(within, carry) if kind == "max" else F.coalesce(within, carry)


def running(parts: DataFrame, key: str, order: list[str], **values: tuple[str, Column, bool]) -> DataFrame:
    """``parts`` (as ``dealt`` by key and order) with running values: name=(kind, column, whether the row itself counts).

    Kinds are ``sum``, ``max`` and ``last`` (the last value that is not null)."""
    made = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    own = Window.partitionBy(key, PART).orderBy(*order)
    place = F.struct(*order)
    whole = {n: F.max_by(c, F.when(c.isNotNull(), place)) if kind == "last" else made[kind](c) for n, (kind, c, _) in values.items()}
    # Only keys that lie in several parts carry something, one for each part at most; a sort of all rows for their sums is spared.
    several = parts.select(F.col(key).alias("__k"), PART).distinct().groupBy("__k").count().where("count > 1").select("__k")
    cut = parts.join(F.broadcast(several), parts[key].eqNullSafe(several["__k"]), "left_semi")
    sums = cut.groupBy(F.col(key).alias("__k"), F.col(PART).alias("__p")).agg(*[c.alias(f"__{n}") for n, c in whole.items()])
    before = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("__k", "__p", *[made[kind](f"__{n}").over(before).alias(f"__c_{n}") for n, (kind, _, _) in values.items()])
    # Of a part only its first key can have begun before it, so there is a row a part at most.
    carry = carry.where(" OR ".join(f"`__c_{n}` IS NOT NULL" for n in values))
    n_tasks = -(-parts.count() // TASK_ROWS)
    out = parts.repartition(n_tasks, key, PART) if n_tasks > int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")) else parts
    for n, (kind, c, itself) in values.items():
        out = out.withColumn(n, made[kind](c).over(own.rowsBetween(Window.unboundedPreceding, 0 if itself else -1)))
    out = out.join(F.broadcast(carry), out[key].eqNullSafe(carry["__k"]) & (out[PART] == carry["__p"]), "left")
    out = out.withColumns({n: _carried(kind, F.col(n), F.col(f"__c_{n}")) for n, (kind, _, _) in values.items()})
    return out.drop("__k", "__p", *[f"__c_{n}" for n in values])


def numbered(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """``rows`` with their number, from 1, among those of their key in this order."""
    return running(dealt(rows, key, order), key, [order], **{name: ("sum", F.lit(1), True)}).drop(PART)


def as_of(points: DataFrame, starts: DataFrame, key: str, at: str, start: str, *columns: str) -> DataFrame:
    """``points`` with ``start`` and ``columns`` of the last row of ``starts`` of their key that begins at or before ``at``.

    Of starts at one place the one with the greatest columns counts; points before the first start,
    and points without a place, have nulls. Starts without a place are left out.
    """
    found = F.struct(F.col(start).alias("s"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    # Keys and places stand in the rows anyway; what else a point has goes along.
    kinds = dict(points.dtypes)
    rest = [c for c in points.columns if c not in (key, at)]
    here = starts.where(F.col(start).isNotNull()).select(F.col(key).alias("key"), F.col(start).alias("place"), F.lit(0).cast("byte").alias("kind"), found.alias("found"))
    rows = points.select(F.col(key).alias("key"), F.col(at).alias("place"), F.lit(1).cast("byte").alias("kind"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(rest)]).unionByName(here, allowMissingColumns=True)
    order = ["place", "kind", "found"]
    out = running(dealt(rows, "key", *order[:2]), "key", order, last=("last", F.col("found"), True)).where("kind = 1")
    named = {key: F.col("key").cast(kinds[key]), at: F.col("place").cast(kinds[at])} | {c: F.col(f"p{i}") for i, c in enumerate(rest)}
    return out.select(*[named[c].alias(c) for c in points.columns], F.col("last.s").alias(start), *[F.col(f"last.c{i}").alias(c) for i, c in enumerate(columns)])


def overlaps(spans: DataFrame, probes: DataFrame, key: str, start: str = "start", stop: str = "stop", name: str = "n") -> DataFrame:
    """``probes`` with the number of ``spans`` of their key that share characters with them: begin before their
    stop and end after their start.

    Counted as spans begun before the stop less spans ended by the start, so no pair is made. Spans that
    are empty or lack an end take no part; probes that lack one count 0.
    """
    real = spans.where(F.col(start) < F.col(stop)).select(F.col(key).alias("key"), F.col(start).alias("a"), F.col(stop).alias("b"))
    asked = probes.where(F.col(start).isNotNull() & F.col(stop).isNotNull()).select(F.col(key).alias("key"), F.col(start).alias("a"), F.col(stop).alias("b")).distinct()
    # At one place: what ends there counts as ended and what begins there as not begun.
    probe_events = F.array(F.struct(F.col("b").alias("place"), F.lit(0).cast("byte").alias("kind")), F.struct(F.col("a").alias("place"), F.lit(2).cast("byte").alias("kind")))
    span_events = F.array(F.struct(F.col("b").alias("place"), F.lit(1).cast("byte").alias("kind")), F.struct(F.col("a").alias("place"), F.lit(3).cast("byte").alias("kind")))
    rows = asked.select("key", "a", "b", F.inline(probe_events)).unionByName(real.select("key", F.inline(span_events)), allowMissingColumns=True)
    one = lambda kind: ("sum", F.when(F.col("kind") == kind, 1).otherwise(0), True)
    out = running(dealt(rows, "key", "place", "kind"), "key", ["place", "kind"], begun=one(3), ended=one(1))
    part = F.when(F.col("kind") == 0, F.col("begun")).otherwise(-F.col("ended"))
    counts = out.where("kind IN (0, 2)").groupBy(F.col("key").alias("__k"), F.col("a").alias("__a"), F.col("b").alias("__b")).agg(F.sum(part).alias(name))
    same = probes[key].eqNullSafe(counts["__k"]) & (probes[start] == counts["__a"]) & (probes[stop] == counts["__b"])
    return probes.join(counts, same, "left").drop("__k", "__a", "__b").withColumn(name, F.coalesce(F.greatest(F.col(name), F.lit(0)), F.lit(0)).cast("long"))


def merge(spans: DataFrame, key: str, start: str = "start", stop: str = "stop", name: str = "n") -> DataFrame:
    """(key, start, stop, n): spans of a key that overlap become one of n; those that only touch stay apart.

    Spans that lack an end are left out."""
    rows = spans.where(F.col(start).isNotNull() & F.col(stop).isNotNull()).select(key, start, stop)
    order = [start, stop]
    reached = running(dealt(rows, key, *order), key, order, reach=("max", F.col(stop), False))
    fresh = materialise(reached.withColumn("fresh", F.when(F.col("reach") > F.col(start), 0).otherwise(1)), "intervals-fresh")
    islands = running(fresh, key, order, island=("sum", F.col("fresh"), True))
    return islands.groupBy(key, "island").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count(F.lit(1)).alias(name)).drop("island")
