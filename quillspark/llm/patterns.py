"""Pattern packing of token sequences by non-negative least squares.

Documents longer than a sequence are cut into whole sequences and one shorter piece; nothing else
is cut. The lengths of all pieces are counted, which gives at most ``length`` numbers whatever the
corpus. On this histogram the driver makes a plan:

* Lengths fall into ``BUCKETS`` buckets of equal width. All patterns of at most ``DEPTH`` buckets
  whose middles fill a sequence are enumerated, and non-negative least squares finds how often to
  repeat each of them so that together they use up the histogram; long buckets weigh more, as short
  pieces fit anywhere. Repeats are rounded to whole numbers that the histogram can serve.
* A pattern takes pieces of its buckets, longest first, and its last piece is the longest one left
  that still fits.
* What is left (the residual) goes, longest first, into the fullest sequence with room for it, and
  opens sequences when there is none. Sequences alike are held as one entry with a count, so the
  plan's size follows from the sequence length and not from the number of documents.

The plan is a list of slots: (length, first rank, sequence, repeats, copies, offset). Each piece
has a rank among the pieces of its length: its place in its task's rows plus the number of such
pieces in earlier tasks. Its slot follows from length and rank alone, so tasks that run again give
the same rows, one length may hold any share of all pieces, and no text is shuffled.

A null text is packed like an empty one: its end token alone. Repeated rows are packed each, also
where they repeat an id; a null id stays null. Pieces of equal length are interchangeable. An empty
table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_task, bound_batches, materialise, pick
from quillspark.llm.packing import tokenizer

LENGTH = 4096
END_ID = 1
BUCKETS = 64
DEPTH = 4
#: Weight of the shortest bucket's residual; the longest weighs 1.
LEAST_WEIGHT = 0.05


def patterns(buckets: int = BUCKETS, depth: int = DEPTH, width: int = LENGTH // BUCKETS) -> list[tuple[int, ...]]:
    """Falling sequences of at most ``depth`` buckets, counted from 1, whose middles fill a sequence."""

    def parts(total: int, k: int, most: int) -> Iterator[tuple[int, ...]]:
        if k == 0:
            yield from [()] if total == 0 else []
            return
        for b in range(min(most, total - k + 1), -(-total // k) - 1, -1):
            for rest in parts(total - b, k - 1, b):
                yield (b, *rest)

    # A middle lies (width - 1) / 2 tokens below its bucket's end, so k ends reach k times that further, to whole buckets.
    return [p for k in range(1, depth + 1) for p in parts(buckets + (k * (width - 1) + width) // (2 * width), k, buckets)]


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by active sets."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    least = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0.0))
    for _ in range(rounds):
        slope = np.where(on, -np.inf, a.T @ (b - a @ x))
        best = int(slope.argmax())
        if slope[best] <= least:
            break
        on[best] = True
        while True:
            z = np.zeros_like(x)
            z[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            bad = on & (z <= 0)
            if not bad.any():
                break
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x = x + step * (z - x)
            on &= x > 1e-12
            x[~on] = 0
        x = z
    return x


def repeats(counts: np.ndarray, length: int = LENGTH, buckets: int = BUCKETS, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats), most repeated first, for ``counts[n]`` pieces of n tokens."""
    width = -(-length // buckets)
    held = np.bincount((np.arange(1, length) - 1) // width, counts[1:length], minlength=buckets)
    some = patterns(buckets, depth, width)
    use = np.zeros((buckets, len(some)))
    for j, p in enumerate(some):
        np.add.at(use[:, j], np.array(p) - 1, 1)
    weight = LEAST_WEIGHT + (1 - LEAST_WEIGHT) * np.arange(buckets) / max(1, buckets - 1)
    scale = max(1.0, held.max())
    x = np.rint(least_squares(use * weight[:, None], held / scale * weight) * scale).astype(np.int64)
    return sorted(((some[j], int(x[j])) for j in np.flatnonzero(x)), key=lambda r: (-r[1], r[0]))


class Plan:
    """Sequences by the room they have left: entries of (count, runs), a run being (length, copies)."""

    def __init__(self, length: int):
        self.length = length
        self.at: list[list[tuple[int, tuple]]] = [[] for _ in range(length + 1)]

    def put(self, room: int, count: int, runs: tuple) -> None:
        if count:
            self.at[room].append((count, runs))

    def follow(self, pattern: tuple[int, ...], times: int, left: np.ndarray, width: int) -> None:
        """Sequences of a pattern, as many of ``times`` as ``left`` can serve."""
        open_ = [(times, self.length, ())]
        for place, bucket in enumerate(pattern):
            last, now = place == len(pattern) - 1, []
            for count, room, runs in open_:
                # The last piece closes its sequence, so it may be of a neighbouring bucket too.
                top = min(room, bucket * width + (width if last else 0), self.length - 1)
                for n in range(top, max(0, (bucket - 1) * width - (width if last else 0)), -1):
                    took = min(count, int(left[n]))
                    if took:
                        left[n] -= took
                        now.append((took, room - n, (*runs, (n, 1))))
                        count -= took
                    if not count:
                        break
                if count and runs:
                    self.put(room, count, runs)
            open_ = now
        for count, room, runs in open_:
            self.put(room, count, runs)

    def fill(self, left: np.ndarray) -> None:
        """Put all that is left, longest first, where it leaves the least room."""
        for n in np.flatnonzero(left)[::-1].tolist():
            count = int(left[n])
            for room in range(n, self.length + 1):
                if not count:
                    break
                here, self.at[room] = self.at[room], []
                for have, runs in here:
                    count -= self._take(n, room, have, runs, count)
            if count:
                self._take(n, self.length, -(-count // (self.length // n)), (), count)
        left[:] = 0

    def _take(self, n: int, room: int, have: int, runs: tuple, count: int) -> int:
        """Pieces of n tokens into ``have`` sequences alike: whole ones, one in part, the others as they are."""
        copies = room // n
        whole = min(have, count // copies)
        self.put(room - copies * n, whole, (*runs, (n, copies)))
        rest = count - whole * copies if whole < have else 0
        if rest:
            self.put(room - rest * n, 1, (*runs, (n, rest)))
        self.put(room, have - whole - bool(rest), runs)
        return whole * copies + rest

    def slots(self) -> np.ndarray:
        """Rows of (length, first rank, first sequence, repeats, copies, offset), by length and rank."""
        rank, sequence, out = [0] * (self.length + 1), 0, []
        for some in self.at:
            for count, runs in some:
                offset = 0
                for n, copies in runs:
                    out.append((n, rank[n], sequence, count, copies, offset))
                    rank[n] += count * copies
                    offset += n * copies
                sequence += count if runs else 0
        return np.array(sorted(out), np.int64).reshape(-1, 6)


def plan(counts: np.ndarray, length: int = LENGTH, buckets: int = BUCKETS, depth: int = DEPTH) -> np.ndarray:
    """The slots for ``counts[n]`` pieces of n tokens, n from 1 to ``length``."""
    left, made = counts.astype(np.int64).copy(), Plan(length)
    made.put(0, int(left[length]), ((length, 1),))
    left[length] = 0
    buckets = min(buckets, length)
    for pattern, times in repeats(left, length, buckets, depth) if left.any() else []:
        made.follow(pattern, times, left, -(-length // buckets))
    made.fill(left)
    return made.slots()


_PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, length: int = LENGTH, make: Callable[[str], object] = tokenizer) -> DataFrame:
    """Pieces of all documents, with the task that made them and their place among its pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, known, seen = TaskContext.get().partitionId(), make(path), [0] * (length + 1)
        for batch in batches:
            doc, rows = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(known.ids(text.as_py() or ""), END_ID).astype("<u4")
                for k, start in enumerate(range(0, len(ids), length)):
                    own = ids[start : start + length]
                    doc.append(i)
                    rows.append((k, start, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)]))
                    seen[len(own)] += 1
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, [pa.int32(), *[pa.int64()] * 5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), *cols], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(arrow_task(run), f"{_PIECES.format(kind=kind)}, part long, place long")


def pack(docs: DataFrame, path: str, length: int = LENGTH, buckets: int = BUCKETS, depth: int = DEPTH, make: Callable[[str], object] = tokenizer) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = pick(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = materialise(pieces(docs, path, length, make), "pattern-pieces")
    held = materialise(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "pattern-counts")
    counts = np.zeros(length + 1, np.int64)
    for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``length`` rows
        counts[r["length"]] = r["n"]
    slots = plan(counts, length, buckets, depth)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # Merged at every size: ``before`` grows with the number of tasks.
    ranked = cut.join(before.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    # Six numbers a slot; their number is bounded by the sequence length, not by the documents.
    shared = spark.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, base, _, copies, offset = shared.value.T
        key = (n << 48) | first
        for batch in batches:
            own, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = np.searchsorted(key, (own << 48) | rank, "right") - 1
            nth, copy = np.divmod(rank - first[at], copies[at])
            placed = [pa.array(base[at] + nth), pa.array(offset[at] + copy * own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *placed], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(arrow_task(run), f"{_PIECES.format(kind=kind)}, sequence_id long, offset long")
