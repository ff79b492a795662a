"""Fixity audit of replicated record archives by Merkle trees.

A leaf is a record: the hash of its WARC header fields and payload. An archive is cut into segment
files of ``2 ** SEGMENT_BITS`` record ids; within a segment the records stand in order of id, so
each has a byte offset, and the first replica's offsets are cut into ranges of ``RANGE`` bytes. A
range's node is the hash of its records in order, a segment's the hash of its ranges, and nodes
above take ``2 ** SEGMENT_BITS`` segments or groups each, up to one root for each replica. A
second replica's records are dealt to the first one's ranges by the order of their ids, so a lost
or added record changes one range and what stands above it.

Both replicas' roots are compared first; equal ones end the audit. Below that, children are read
only of nodes that differ, level by level, down to the records of ranges that differ. Records that
differ are given by segment, byte offset and length in the first replica.

Rows that repeat an id are one leaf, made of the sums of their hashes and their number, so their
order and how many contents one id has don't matter. Records without an id are kept apart from all
others and told by a hash of their content; their page_id is null, and such a record that is
damaged shows as one missing and one extra. Null urls and payloads are hashed as such, unlike empty
ones. Equal replicas, and two empty ones, give no rows; against an empty replica each record is
missing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import drop_table, materialise, pick

#: Bits of a record id within one segment file, and of a segment within one node above.
SEGMENT_BITS = 12
#: Bytes of the first replica that one node above the records covers.
RANGE = 1 << 16
#: Hex digits of a hash that one of its sums takes.
_LANE = 16


def record(url: Column, payload: Column) -> Column:
    """A record as its archive holds it: header fields, an empty line, the payload."""
    head = [F.lit("WARC/1.1"), F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit("-"))), F.concat(F.lit("Content-Length: "), F.coalesce(F.octet_length(payload).cast("string"), F.lit("-")))]
    return F.concat_ws("\r\n", *head, F.lit(""), payload)


def leaves(pages: DataFrame, replica: int) -> DataFrame:
    """(replica, nameless, key, hash, size): one row per record id, with the bytes of its records."""
    rows = pick(pages, "page_id", "url", "html")
    body = record(F.col("url"), F.col("html"))
    key = F.coalesce(F.col("page_id").cast("long"), F.xxhash64("url", "html"))
    rows = rows.select(F.col("page_id").isNull().alias("nameless"), key.alias("key"), F.sha2(body, 256).alias("h"), F.octet_length(body).cast("long").alias("size"))
    # Sums of a hash's parts need no list of an id's contents and are made before the shuffle.
    lanes = [F.conv(F.substring("h", 1 + k, _LANE), 16, 10).cast("decimal(20,0)").alias(f"l{k}") for k in range(0, 64, _LANE)]
    sums = rows.select("nameless", "key", "size", *lanes).groupBy("nameless", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), *[F.sum(f"l{k}").alias(f"l{k}") for k in range(0, 64, _LANE)])
    one = F.lower(F.concat(*[F.lpad(F.conv(F.col(f"l{k}").cast("string"), 10, 16), _LANE, "0") for k in range(0, 64, _LANE)]))
    many = F.sha2(F.concat_ws(" ", F.col("n").cast("string"), *[F.col(f"l{k}").cast("string") for k in range(0, 64, _LANE)]), 256)
    return sums.select(F.lit(replica).alias("replica"), "nameless", "key", F.when(F.col("n") == 1, one).otherwise(many).alias("hash"), "size")


def _ranged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Leaves of both replicas with the segment, the first replica's byte offset, and its range."""
    both = leaves(first, 0).unionByName(leaves(second, 1)).withColumn("segment", F.shiftright("key", SEGMENT_BITS))
    by_key = Window.partitionBy("nameless", "segment").orderBy("key", "replica")
    own = F.when(F.col("replica") == 0, F.col("size")).otherwise(F.lit(0))
    before = F.coalesce(F.sum(own).over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = both.withColumn("offset", F.when(F.col("replica") == 0, before))
    # A record of the second replica stands with the last of the first whose id is not greater.
    at = F.coalesce(F.last("offset", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return placed.withColumn("range", F.floor(at / RANGE).cast("long"))


def _node(child: str) -> Column:
    children = F.array_sort(F.collect_list(F.struct(F.col(child).alias("k"), F.col("hash").alias("h"))))
    return F.sha2(F.array_join(F.transform(children, lambda x: F.concat_ws(":", x["k"].cast("string"), x["h"])), ","), 256).alias("hash")


class _Trees:
    """The written levels of both replicas' trees, records first; a level's rows name their parent."""

    def __init__(self, first: DataFrame, second: DataFrame):
        records = materialise(_ranged(first, second), "merkle-records")
        ranges = materialise(records.groupBy("replica", "nameless", "segment", "range").agg(_node("key")), "merkle-ranges")
        level = materialise(ranges.groupBy("replica", "nameless", "segment").agg(_node("range")), "merkle-segments").withColumnRenamed("segment", "key")
        self.records, self.ranges, self.above = records, ranges, [level]
        span = level.agg(F.min("key"), F.max("key")).first()
        most = max((abs(v) for v in span if v is not None), default=0)
        while most >> SEGMENT_BITS:
            most >>= SEGMENT_BITS
            up = level.withColumn("up", F.shiftright("key", SEGMENT_BITS)).groupBy("replica", "nameless", "up").agg(_node("key")).withColumnRenamed("up", "key")
            level = materialise(up, "merkle-groups")
            self.above.append(level)
        # What is left is a few nodes: ids below zero and above, with a name and without.
        self.top = {r.replica: r.hash for r in level.withColumn("at", F.struct("nameless", "key").cast("string")).groupBy("replica").agg(_node("at")).collect()}

    def root(self, replica: int) -> str:
        return self.top.get(replica, "")

    def drop(self) -> None:
        for table in (self.ranges, *self.above):
            drop_table(table)


def roots(first: DataFrame, second: DataFrame) -> tuple[str, str]:
    """The root hashes of two replicas; an empty one has the empty root."""
    trees = _Trees(first, second)
    return trees.root(0), trees.root(1)


def _differ(nodes: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Nodes whose hashes are not the same in both replicas, or which one of them lacks."""
    side = lambda k: F.max(F.when(F.col("replica") == k, F.col("hash")))
    return nodes.groupBy(*keys).agg(side(0).alias("expected"), side(1).alias("found"), *more).where(~F.col("expected").eqNullSafe(F.col("found")))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(page_id, status, segment, offset, size, expected, found) of records that differ.

    status: ``corrupt``, ``missing`` from the second replica, or ``extra`` in it; an extra record
    has no place in the first.
    """
    trees = _Trees(first, second)
    if trees.root(0) == trees.root(1):
        trees.drop()
        wrong = trees.records.where(F.lit(False))
    else:
        wrong = None
        for level in reversed(trees.above):
            nodes = level if wrong is None else level.withColumn("up", F.shiftright("key", SEGMENT_BITS)).join(wrong, ["nameless", "up"], "left_semi")
            wrong = _differ(nodes, ["nameless", "key"]).select("nameless", F.col("key").alias("up"))
        ranges = trees.ranges.join(wrong.withColumnRenamed("up", "segment"), ["nameless", "segment"], "left_semi")
        bad = materialise(_differ(ranges, ["nameless", "segment", "range"]).select("nameless", "segment", "range"), "merkle-differ")
        trees.drop()
        wrong = trees.records.join(bad, ["nameless", "segment", "range"], "left_semi")
    own = lambda c: F.max(F.when(F.col("replica") == 0, F.col(c))).alias(c)
    out = _differ(wrong, ["nameless", "key"], own("segment"), own("offset"), own("size"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("corrupt")
    return out.select(F.when(~F.col("nameless"), F.col("key")).alias("page_id"), status.alias("status"), "segment", "offset", "size", "expected", "found")
