"""Near duplicates by SimHash, completed and checked on the five-word shingles of the texts.

Words are runs of letters and digits, as in ``fmindex``; a text of fewer words is one shingle.
Two texts are near duplicates when their sets of shingles have a Jaccard similarity of ``LEAST`` or
more, and none is dropped without that comparison of whole texts.

Candidates come first from the fingerprints of the shingles, linked within ``FINGERPRINT_BITS`` bits
by the deletion-variant signatures of ``simhash``. Scattered changes move more bits than segments
can tell apart: at a similarity of 0.8 a bit differs with a probability of 0.15, about ten of 64. So
texts that are still apart also meet by ``BANDS`` keys over ``WIDTH`` minima of the set each; a pair
of similarity 0.8 shares none in four cases of ten thousand. A sketch of ``BINS`` bins, with the
least hash of each, estimates the similarity of those that meet, and pairs below ``ESTIMATE`` are left
out: at 0.8 the estimate of a long text is off by 0.0125 in the mean, so it falls that far for seven
pairs in ten thousand, and that of a short text is hardly off.

A round takes the best candidates between groups that are still apart and compares the two texts'
whole sets. Links that hold join groups, others are not tried again. In a bucket the texts beside its
largest group look for candidates among all of it, so a large group is never met with itself, and a
bucket of over ``PART`` texts is dealt to several tasks. The first round meets ``HUBS`` texts of each
bucket and tries one candidate for a text, each later one all texts of other groups in the bucket and
``MORE`` times as many candidates, in the buckets that had more of them than were taken. It ends when
none had, so all are tried that could join some, in few rounds, and pairs within a group are never written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_task, bound_batches, drop_table, materialise, place_of
from quillspark.llm.simhash import SEED, _runs, components, links, majority

SHINGLE = 5
LEAST = 0.8
FINGERPRINT_BITS = 5
BANDS, WIDTH = 20, 5
BINS, ESTIMATE = 1024, 0.76
HUBS, MORE = 32, 8
#: Texts of a bucket that one task looks for, and looks among.
PART = 1 << 12
#: Rows of sketches that a task holds, or one part of a bucket; candidates that it holds.
ROWS, EMIT = 1 << 14, 1 << 16
#: Rows of numbers that a row with a text or sketch counts for.
TEXT_ROWS = 16

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 64, (BANDS * WIDTH, 1), np.uint64) | np.uint64(1)
_MASK = _RNG.integers(0, 1 << 64, (BANDS * WIDTH, 1), np.uint64)


def shingle_hashes(text: str | None) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    import xxhash

    low = (text or "").encode("utf-8", "replace").lower()
    words = _WORD.findall(low)
    if len(words) < SHINGLE:
        parts = [b" ".join(words or low.split())]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The hashes of a text's shingles, each once, ascending."""
    return np.unique(shingle_hashes(text))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 2048):
        out = np.minimum(out, ((hashes[None, a : a + 2048] ^ _MASK) * _TIMES).min(axis=1))
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin, as a byte from 1; 0 for an empty bin."""
    mixed = (hashes ^ _MASK[0, 0]) * _TIMES[0, 0]
    mixed ^= mixed >> np.uint64(29)
    bins = (mixed & np.uint64(BINS - 1)).astype(np.int64)
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bins, mixed)
    return np.where(np.bincount(bins, minlength=BINS) > 0, 1 + (least >> np.uint64(20)) % np.uint64(255), 0).astype(np.uint8)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarities of each sketch of ``a`` with each of ``b``."""
    out = np.empty((len(a), len(b)), np.float32)
    step = max(1, (4 << 20) // (max(1, len(b)) * BINS))
    for i in range(0, len(a), step):
        x, y = a[i : i + step, None, :], b[None, :, :]
        some = ((x | y) != 0).sum(axis=2)
        out[i : i + step] = ((x == y) & (x != 0)).sum(axis=2) / np.maximum(some, 1)
    return out


def _signed(rows: DataFrame) -> DataFrame:
    """(doc_id, node, fp, bands, sketch) of rows (doc_id, node, text)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, bands, tails = [], [], []
            for t in b.column(2):
                hashes = shingle_hashes(t.as_py())
                fps.append(majority(hashes))
                own = np.unique(hashes)
                m = minima(own)
                keys = [xxhash.xxh64_intdigest(part.tobytes(), seed=k) for k, part in enumerate(m.reshape(BANDS, WIDTH))]
                bands.append(np.array(keys, np.uint64).view(np.int64))
                tails.append(sketch(own).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(tails, pa.binary())], ["doc_id", "node", "fp", "bands", "sketch"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "node", "text").mapInArrow(arrow_task(run), f"doc_id {kind}, node long, fp long, bands array<long>, sketch binary")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (who, key, node, label) of buckets with two labels or more; ``who`` tells the bucket's nodes."""
    import xxhash

    for key, node, label in _runs(batches, 1):
        start = np.append(True, key[1:] != key[:-1])
        bucket = np.cumsum(start) - 1
        several = np.zeros(bucket[-1] + 1, bool)
        several[bucket[label != label[start][bucket]]] = True
        some = several[bucket]
        key, node, label = key[some], node[some], label[some]
        cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)
        who = [xxhash.xxh64_intdigest(node[x:y].tobytes()) for x, y in zip(cut, cut[1:])]
        who = pa.array(np.repeat(np.array(who, np.uint64), np.diff(cut)).view(np.int64))
        yield pa.RecordBatch.from_arrays([who, pa.array(key), pa.array(node), pa.array(label)], ["who", "key", "node", "label"])


def _tried(node: np.ndarray, failed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of both nodes of each pair that was tried in vain, both ways round; ``node`` ascends."""
    some = [i for i, f in enumerate(failed) if f is not None]
    if not some:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, other = np.repeat(some, [len(failed[i]) for i in some]), np.concatenate([failed[i] for i in some])
    b = np.minimum(np.searchsorted(node, other), len(node) - 1)
    here = node[b] == other
    return np.append(a[here], b[here]), np.append(b[here], a[here])


def _candidates(most: int):
    """The task that finds, for each node of a part of a bucket that asks, its best candidates (key, a, b, alike)
    in other groups: ``most`` of the part's held nodes, or one among its hubs where that is 1.
    Rows: key, cell, node, label, asks, held, failed, sketch. A part where some are passed over has a row
    without candidates, so that its bucket is not thought done."""

    def best(node: np.ndarray, label: np.ndarray, asks: np.ndarray, held: np.ndarray, failed: np.ndarray, sketches: np.ndarray) -> Iterator[tuple | None]:
        """Arrays (a, b, alike), and None where some were passed over."""
        ask, hubs = np.flatnonzero(asks), np.flatnonzero(held)
        over = most == 1 and len(hubs) > HUBS
        if over:
            hubs = hubs[np.unique(np.linspace(0, len(hubs) - 1, HUBS).astype(np.int64))]
        place = np.full(len(node), -1)
        place[hubs] = np.arange(len(hubs))
        a, b = _tried(node, failed)
        known = asks[a] & (place[b] >= 0)
        a, b = np.searchsorted(ask, a[known]), place[b[known]]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        step = max(1, (1 << 20) // max(1, len(hubs)))
        for i in range(0, len(ask), step):
            own = ask[i : i + step]
            alike = estimates(sketches[own], sketches[hubs])
            alike[label[own, None] == label[hubs][None, :]] = 0
            x, y = np.searchsorted(a, (i, i + step))
            alike[a[x:y] - i, b[x:y]] = 0
            alike[alike < ESTIMATE] = 0
            over = over or bool(((alike > 0).sum(axis=1) > most).any())
            own, alike = own[some := alike.any(axis=1)], alike[some]
            take = np.argsort(-alike, axis=1, kind="stable")[:, :most]
            alike = np.take_along_axis(alike, take, 1)
            x, y = np.nonzero(alike)
            one, other = node[own[x]], node[hubs[take[x, y]]]
            yield np.minimum(one, other), np.maximum(one, other), alike[x, y].astype(np.float64)
        if over:
            yield None

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*found)], ["key", "a", "b", "alike"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cell, node, label, asks, held, failed, tails in _runs(batches, 2, ROWS):
            sketches = np.frombuffer(b"".join(tails), np.uint8).reshape(len(key), -1)
            cut = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))), len(key))
            found: list[tuple[pa.Array, ...]] = []
            n = 0
            for x, y in zip(cut, cut[1:]):
                # A pair may come from both of its nodes; equal ones become one after the shuffle.
                for part in best(node[x:y], label[x:y], asks[x:y], held[x:y], failed[x:y], sketches[x:y]):
                    a, b, alike = part or ([None], [None], [None])
                    found.append((pa.array(np.full(len(a), key[x])), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(alike, pa.float64())))
                    n += len(a)
                    if n >= EMIT:
                        yield table(found)
                        found, n = [], 0
            if found:
                yield table(found)

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, holds) of rows (a, b, text of a, text of b)."""
    for b in batches:
        holds = [similarity(shingle_set(x.as_py()), shingle_set(y.as_py())) >= LEAST for x, y in zip(b.column(2), b.column(3))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(holds, pa.bool_())], ["a", "b", "holds"])


def _by_fingerprint(nodes: DataFrame, n: int) -> DataFrame:
    """(a, b) with a < b: nodes of one fingerprint in a chain, and the first nodes of fingerprints that are linked."""
    chain = nodes.select(F.lag("node").over(Window.partitionBy("fp").orderBy("node")).alias("a"), F.col("node").alias("b")).where("a IS NOT NULL")
    first = materialise(nodes.groupBy("fp").agg(F.min("node").alias("node")), "shingle-fps", n)
    near = links(first.select("fp"), FINGERPRINT_BITS, rows=n).toDF("x", "y").join(first.toDF("x", "p"), "x").join(first.toDF("y", "q"), "y")
    return chain.unionByName(near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))).distinct()


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, holds) of pairs of nodes."""
    n = TEXT_ROWS * pairs.count()
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    held = materialise(texts.join(asked, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "shingle-texts", n)
    both = pairs.join(held.toDF("a", "x").hint("merge"), "a").join(held.toDF("b", "y").hint("merge"), "b")
    out = materialise(both.select("a", "b", "x", "y").mapInArrow(arrow_task(_compared), "a long, b long, holds boolean"), "shingle-links", n)
    drop_table(held)
    return out


def _apart(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """Rows (key, node, label) of those buckets of ``keys`` that hold two labels or more, each with its bucket's
    number of nodes, the label of most of them and the number of the others."""
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("nodes"), F.max(F.struct("n", "label")).alias("m"))
    sizes = sizes.select("key", "nodes", F.col("m.label").alias("main"), (F.col("nodes") - F.col("m.n")).alias("others")).where("others > 0")
    # The keys meet the sizes, not the rows, which so are joined once a round.
    return materialise(rows.join(sizes.join(keys, "key"), "key"), "shingle-apart", BANDS * n)


def _dealt(buckets: DataFrame, hubs: bool) -> DataFrame:
    """Rows of buckets with the part of the bucket, ``cell``, that they go to, and whether they ask or are held there.

    The nodes beside the largest group ask; all are held. Of a large bucket each part of those that ask meets
    each part of those that are held, or, for ``hubs``, those that share its part alone.
    """
    rows = buckets.withColumn("some", F.expr(f"ceil(nodes / {PART})")).withColumn("own", F.expr("pmod(xxhash64(node), some)"))
    rows = rows.withColumn("turns", F.lit(1).cast("long") if hubs else F.expr(f"ceil(others / {PART})")).withColumn("turn", F.expr("pmod(xxhash64(node, 1), turns)"))
    cells = "transform(sequence(0L, turns - 1), t -> own * turns + t)"
    if not hubs:
        cells = f"IF(label = main, {cells}, array_union({cells}, transform(sequence(0L, some - 1), p -> p * turns + turn)))"
    rows = rows.withColumn("cell", F.explode(F.expr(cells)))
    return rows.select("key", "cell", "node", "label", F.expr("label <> main AND cell % turns = turn").alias("asks"), F.expr("cell div turns = own").alias("held"), "failed", "sketch")


def _groups(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the groups that all links which hold make, of nodes with such a link.

    ``texts``: node, text, with repeats; ``nodes``: node, fp, bands, sketch.
    """
    n = nodes.count()
    tried = _checked(materialise(_by_fingerprint(nodes, n), "shingle-pairs", n), texts)
    labels = components(tried.where("holds").select("a", "b"), "shingle", rows=n)
    # Buckets that are one group have nothing left to join, and are not written.
    named = nodes.select("node", "bands").join(labels, "node", "left").select(F.explode("bands").alias("key"), "node", F.coalesce("label", "node").alias("label"))
    task = arrow_task(_shared)
    buckets = materialise(named.repartition("key").sortWithinPartitions("key", "node").mapInArrow(task, "who long, key long, node long, label long"), "shingle-shared", BANDS * n)
    # Near copies share many keys: of buckets with the same nodes one is kept.
    one = buckets.groupBy("who").agg(F.min("key").alias("key")).select("key")
    buckets = _apart(buckets.drop("who"), one, n)
    sketches = nodes.select("node", "sketch").hint("merge")
    most = 1
    while True:
        failed = tried.where("NOT holds").groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("failed"))
        rows = _dealt(buckets.join(failed, "node", "left").join(sketches, "node"), most == 1)
        found = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "node").mapInArrow(arrow_task(_candidates(most)), "key long, a long, b long, alike double")
        found = materialise(found, "shingle-candidates", BANDS * n)
        best = found.where("a IS NOT NULL").groupBy("a", "b").agg(F.max("alike").alias("alike"))
        nth = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("alike"), "a"))
        pairs = materialise(best.withColumn("nth", nth).where(F.col("nth") <= most).select("a", "b"), "shingle-pairs", n * most)
        # A bucket whose candidates are all taken gets no more: groups only grow, and tried pairs stay tried.
        more = materialise(found.join(pairs, ["a", "b"], "left_anti").select("key").distinct(), "shingle-more", n)
        if not pairs.isEmpty():
            tried = tried.unionByName(_checked(pairs, texts))
            labels = components(tried.where("holds").select("a", "b"), "shingle", rows=n)
        if more.isEmpty():
            return labels
        rows = buckets.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        buckets = _apart(materialise(rows, "shingle-named", BANDS * n), more, n)
        most *= MORE


def keep_one_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of linked texts, the one of smallest id; same columns.

    Rows alike in id and text count once; rows that share an id alone are compared like any others.
    Rows without an id always stay. Null and empty texts are one text. An empty table gives none.
    Other columns are passed on, whatever their names.
    """
    bound_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at, text = (names[place_of(docs, c)] for c in ("doc_id", "text"))
    node = F.xxhash64(F.coalesce(text, F.lit("")))
    own = docs.toDF(*names)
    rows = own.select(F.col(at).alias("doc_id"), node.alias("node"), F.col(text).alias("text"))
    signed = materialise(_signed(rows.where("doc_id IS NOT NULL")), "shingle-minima")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = materialise(nodes, "shingle-nodes", TEXT_ROWS * signed.count())
    labels = _groups(rows.select("node", F.coalesce("text", F.lit("")).alias("text")), nodes)
    named = nodes.select("node", "least").join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("root"))
    kept = named.groupBy("root").agg(F.min(F.struct("least", "node")).alias("m")).select(F.col("m.least").alias("doc_id"), F.col("m.node").alias("node"))
    kept = kept.join(signed.select("doc_id", "node"), ["doc_id", "node"]).groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n_rows"))
    kept = materialise(kept.toDF("keep_id", "keep_node", "n_rows"), "shingle-kept", signed.count())
    # Merged at every size: texts move once, whether or not the list of kept rows is small.
    joined = own.withColumn("node", node).join(kept.hint("merge"), (F.col(at) == F.col("keep_id")) & (F.col("node") == F.col("keep_node")))
    once = joined.where("n_rows = 1").select(*names)
    again = joined.where("n_rows > 1").dropDuplicates([at, "node"]).select(*names)
    return once.unionByName(again).unionByName(own.where(F.col(at).isNull())).toDF(*docs.columns)
