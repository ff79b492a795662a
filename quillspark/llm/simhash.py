"""Near duplicates by 64-bit SimHash fingerprints and deletion-variant signatures.

A fingerprint holds bit b when more than half of the XXH64 values (seed 42) of the document's
3-word shingles have it. It is cut into so few segments that, of two fingerprints within
``max_bits`` bits, one segment differs in at most one: two segments for three bits, three for
five. Each segment is indexed once as it is and once with each of its bits wiped out, and an
equality match of these signatures meets every link. Each match is verified by counting bits.

Signatures are dealt out by hash and sorted, so a bucket arrives as a run of rows. A bucket
adds a spanning forest of its links and never its pairs. Buckets of over ``BUCKET`` different
fingerprints are dealt again by signatures of the other bits, cut in the same way.

Null and empty texts and texts of white space have the fingerprint zero and are linked like
any other. Repeated rows keep one output row each. Rows whose id is null get the component of
their fingerprint; a component with no id at all has a null component_id. An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_task, bound_batches, drop_table, materialise, pick

#: Different fingerprints that one signature may hold before it is dealt again.
BUCKET = 512
MAX_BITS = 3
SEED = 42
ROWS = 1 << 17
#: Links that one task joins.
ONE_TASK = 1 << 20


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of some 64-bit hashes have set; 0 of none."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        block = hashes[a : a + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one whole text as an unsigned integer."""
    import xxhash

    # bytes.lower() touches A-Z alone and bytes.split() cuts at 0x09-0x0D and 0x20 alone.
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(arrow_task(run), f"doc_id {kind}, fp long")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _forest(same: np.ndarray, wild: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the buckets join. ``same``: bucket number of each row, ascending;
    ``wild``: the wiped bit of that bucket, or -1; rows of a bucket are different fingerprints."""
    ids, node = np.unique(fp, return_inverse=True)
    label = np.arange(len(ids))

    def roots() -> None:
        while True:
            up = label[label]
            if np.array_equal(up, label):
                return
            label[:] = up

    at = np.arange(len(fp))
    step = 0
    while True:
        step += 1
        at = at[at + step < len(fp)]
        at = at[same[at] == same[at + step]]
        if not len(at):
            break
        other = fp[at] ^ fp[at + step]
        link = _bits(other) <= most
        bit = wild[at]
        # A wiped bit must differ: pairs alike in the whole half meet in its plain signature.
        link &= (bit < 0) | (((other >> np.maximum(bit, 0)) & 1) == 1)
        a, b = node[at[link]], node[at[link] + step]
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            roots()
    roots()
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int, rows: int = ROWS) -> Iterator[list[np.ndarray]]:
    """Columns (keys.., fp) of sorted rows in chunks that end with a bucket."""
    held: list[np.ndarray] = []

    def ends(cols: list[np.ndarray]) -> np.ndarray:
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:n_keys]:
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(x) for x in zip(held, cols)] if held else cols
        if len(held[0]) >= rows and len(cut := ends(held)):
            yield [c[: cut[-1]] for c in held]
            held = [c[cut[-1] :] for c in held]
    if held and len(held[0]):
        yield held


def segments(n_bits: int, max_bits: int) -> list[tuple[int, int]]:
    """(offset, width) of the segments that ``n_bits`` bits are cut into, the widest first."""
    parts = -(-(max_bits + 1) // 2)
    widths = [n_bits // parts + (k < n_bits % parts) for k in range(parts)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def _search(first: list[tuple[int, int]], second: list[tuple[int, int]] | None, most: int, limit: int):
    """The task that turns sorted signatures into links and into rows of overfull buckets.

    ``first``: segments of the signature in column 0; ``second``: those of column 1, which cut the
    bits above and then below the first's segment.
    """
    n_keys = 1 if second is None else 2

    def wiped(key: np.ndarray, cut: list[tuple[int, int]]) -> np.ndarray:
        """The place of the bit that a signature leaves out, or -1 where it is plain."""
        segment, mark = (key >> 38) & 7, (key >> 32) & 63
        return np.where(mark == np.array([w for _, w in cut])[segment], -1, np.array([o for o, _ in cut])[segment] + mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _runs(batches, n_keys):
            keys, fp = cols[:n_keys], cols[-1]
            new = np.ones(len(fp), bool)
            new[1:] = False
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            bucket = np.cumsum(new) - 1
            size = np.bincount(bucket)[bucket]
            some = (size > 1) & (size <= limit)
            if second is None:
                wild = wiped(keys[0], first)
            else:
                wild, end = wiped(keys[1], second), np.array([o + w for o, w in first])[(keys[0] >> 38) & 7]
                wild = np.where(wild >= 0, (wild + end) % 64, -1)
            a, b = _forest(bucket[some], wild[some], fp[some], most)
            over = size > limit
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.full(len(a), -1, np.int64), keys[0][over]])),
                    pa.array(np.concatenate([a, fp[over]])),
                    pa.array(np.concatenate([b, fp[over]])),
                ],
                ["key", "a", "b"],
            )

    return run


def _signatures(value: str, cut: list[tuple[int, int]]) -> tuple[str, int]:
    """SQL for the n-th signature of a value of bits, and how many there are: for each segment one
    for each bit that is wiped out, and the plain one."""
    cases, n = [], 0
    for k, (offset, width) in enumerate(cut):
        part = f"(shiftrightunsigned({value}, {offset}) & {(1 << width) - 1}L)"
        mark = f"CAST(n - {n} AS BIGINT)"
        wiped = f"CASE WHEN n - {n} < {width} THEN {part} & ~shiftleft(1L, CAST(n - {n} AS INT)) ELSE {part} END"
        cases.append(f"WHEN n < {n + width + 1} THEN shiftleft({k}L, 38) | shiftleft({mark}, 32) | {wiped}")
        n += width + 1
    return f"CASE {' '.join(cases)} END", n


def links(distinct_fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET, rows: int | None = None) -> DataFrame:
    """(a, b) links that connect all fingerprints within ``max_bits``; ``distinct_fps``: column fp, about ``rows`` of them."""
    if not 0 <= max_bits <= 5:
        raise ValueError("over five bits need segments too narrow to tell fingerprints apart")
    first = segments(64, max_bits)
    if len(first) == 1:
        first = [(0, 32), (32, 32)]
    signature, n = _signatures("fp", first)
    keyed = distinct_fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("n")).select(F.expr(signature).alias("key"), "fp")
    task = arrow_task(_search(first, None, max_bits, bucket))
    found = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(task, "key long, a long, b long")
    found = materialise(found, "simhash-buckets", rows)
    over = found.where("key >= 0")
    linked = found.where("key < 0").select("a", "b")
    if over.isEmpty():
        return linked
    # The bits beside an overfull bucket's segment, those above it first.
    rest = 64 - max(w for _, w in first)
    second = segments(rest, max_bits)
    turn = " ".join(f"WHEN {k} THEN {(o + w) % 64}" for k, (o, w) in enumerate(first))
    turned = over.withColumn("t", F.expr(f"CASE (shiftright(key, 38) & 7) {turn} END"))
    others = turned.select("key", F.col("a").alias("fp"), F.expr(f"(shiftrightunsigned(a, t) | shiftleft(a, 64 - t)) & {(1 << rest) - 1}L").alias("o"))
    signature, n = _signatures("o", second)
    deeper = others.select("key", "fp", "o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("n")).select("key", F.expr(signature).alias("sub"), "fp")
    # A first signature's wiped bit need not differ here: more links hold than are needed, none is wrong.
    task = arrow_task(_search(first, second, max_bits, 1 << 62))
    inner = deeper.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp").mapInArrow(task, "key long, a long, b long")
    return linked.unionByName(inner.select("a", "b"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all nodes of the links (a, b) of one task."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    ids, node = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = node[: len(a)], node[len(a) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        np.minimum.at(label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while not np.array_equal(up := label[label], label):
            label = up
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["node", "label"])


def _further(labels: DataFrame, up: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Labels followed one round further."""
    later = up.selectExpr("node AS label", "label AS end")
    return materialise(labels.join(later, "label", "left").selectExpr("node", "coalesce(end, label) AS label"), f"{what}-labels", rows)


def components(edges: DataFrame, what: str = "simhash", one_task: int = ONE_TASK, rows: int | None = None) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b), about ``rows``, can reach.

    In a round each node points to its smallest neighbour, or to itself where that is larger, and
    pointers are followed to their ends. Then each tree is one node, and the links left between
    trees make the next, smaller round: it has half of the nodes at most. ``one_task`` links or
    fewer, which take some tens of bytes each, are joined in one task. Each step is written to the
    shared folder.
    """
    pair = ["greatest(a, b) AS a", "least(a, b) AS b"]
    rest = materialise(edges.where("a <> b").selectExpr(*pair).distinct(), f"{what}-edges", rows)
    labels = None
    while n := rest.count():
        if n <= one_task:
            up = materialise(rest.repartition(1).mapInArrow(arrow_task(_joined), "node long, label long"), f"{what}-up")
            return up if labels is None else _further(labels, up, what, rows)
        both = rest.selectExpr("a AS node", "b AS other").union(rest.selectExpr("b AS node", "a AS other"))
        up = materialise(both.groupBy("node").agg(F.min("other").alias("m")).selectExpr("node", "least(node, m) AS label"), f"{what}-up", rows)
        while True:
            further = up.join(up.selectExpr("node AS label", "label AS end"), "label").selectExpr("node", "end AS label", "end <> label AS moved")
            further = materialise(further, f"{what}-up", rows)
            drop_table(up)
            up = further.select("node", "label")
            if further.where("moved").isEmpty():
                break
        left = rest.join(up.selectExpr("node AS a", "label AS x"), "a").join(up.selectExpr("node AS b", "label AS y"), "b")
        rest = materialise(left.where("x <> y").selectExpr("greatest(x, y) AS a", "least(x, y) AS b").distinct(), f"{what}-edges", rows)
        if labels is None:
            labels = up
        else:
            labels = _further(labels, up, what, rows)
    return rest.selectExpr("a AS node", "b AS label") if labels is None else labels


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id. See the module's text."""
    fps = materialise(fingerprints(pick(docs, "doc_id", "text"), shingle), "simhash-fps")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    labels = components(links(nodes.select("fp"), max_bits))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("label", "fp").alias("root"))
    named = materialise(named, "simhash-named")
    roots = materialise(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-roots")
    member = materialise(named.join(roots, "root").select("fp", "component_id"), "simhash-members")
    return fps.join(member, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
