"""Product quantisation of vectors with codebooks from Yinyang Lloyd rounds, in exact integers.

Each component x becomes floor(1024 * x) and each vector is cut into ``PARTS`` parts. A part
position's codebook starts as that part of the vectors with the ``ENTRIES`` smallest ids. In each
round every part goes to its nearest entry, ties to the lower index, and entries become the floored
means of their parts; unused ones stay.

The entries of a codebook are clustered into ``GROUPS`` groups once. A vector carries, for each part,
its entry, an upper bound of the distance to it, and one lower bound for each group of the
distances to the group's other entries. When entries move, the upper bound grows by its entry's
drift and a group's lower bound falls by the group's greatest drift. Where every lower bound stays
above the upper bound, nothing is computed; else the distance to the own entry is computed, and
only groups whose bound still fails are scanned. Bounds are rounded outwards, and bounds within a
rounding of each other count as failed, so ties are always decided on squared distances, which are
integers.

Distances of components up to ``NARROW`` are exact in floating point. A codebook entry beyond ``NARROW``
by more than all distances among narrow ones is never nearest to a narrow part; parts that are wider
(x beyond some thousands), and all parts while no entry is narrow, are compared in Python's integers.

Rounds read and write tables of vectors and bounds where they lie: nothing is shuffled but sums for
each task and entry, which Spark adds up; the driver sees ``PARTS * ENTRIES`` of them whatever the
input. One vector or label may hold any share of the rows.

Rows whose vector is null or holds null or non-finite components are dropped, as are those of
another length than the vector of smallest id has. If that is no multiple of ``PARTS``, later parts may be
one longer; an empty vector has code zero. Null ids come last among ids; rows of equal id go by their
vectors; repeated rows are coded each. Errors beyond a long are shown as its greatest value. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_task, bound_batches, drop_table, materialise, pick

SCALE = 1024
PARTS, ENTRIES, GROUPS, ROUNDS = 4, 256, 16, 4
#: Integers that exact floating-point distances allow for parts of up to 64 components.
NARROW = 1 << 20
#: What rounding of a bound can change, relative to it.
SLACK = 1e-6
CHUNK = 4096
LIMB = 1 << 60
LONGEST = (1 << 63) - 1


def floors(values: list[float]) -> list[int]:
    """floor(SCALE * x) of any finite numbers, exactly."""
    out = []
    for x in values:
        top, bottom = float(x).as_integer_ratio()
        out.append(top * SCALE // bottom)
    return out


def bounds_of(dim: int, parts: int) -> list[tuple[int, int]]:
    return [(dim * i // parts, dim * (i + 1) // parts) for i in range(parts)]


class Codebook:
    """Entries of one part position in integers, with their groups and how far they moved last."""

    def __init__(self, entries: list[list[int]], groups: list[np.ndarray] | None = None, before: Codebook | None = None):
        self.entries = entries
        dim = len(entries[0])
        # An entry further out than this is never nearest to a narrow part, if any entry is narrow.
        self.narrow = min(NARROW, int((2**25 / max(1, dim) ** 0.5) / (2 * max(1, dim) ** 0.5 + 3)))
        self.far_off = 2 * self.narrow * dim**0.5 + 1
        size = [max(map(abs, e), default=0) for e in entries]
        self.far = np.array([s > self.narrow + self.far_off for s in size], bool)
        self.exact = any(s <= self.narrow for s in size)
        self.points = np.array([[0] * dim if f else e for e, f in zip(entries, self.far)], np.float64).reshape(len(entries), dim)
        self.squares = (self.points * self.points).sum(axis=1)
        self.groups = _grouped(self.points) if groups is None else groups
        self.group_of = np.zeros(len(entries), np.int64)
        for g, own in enumerate(self.groups):
            self.group_of[own] = g
        self.drift = np.array([_length(a, b) for a, b in zip(entries, before.entries)]) if before else np.zeros(len(entries))
        self.group_drift = np.array([self.drift[own].max(initial=0.0) for own in self.groups])

    def moved(self, entries: list[list[int]]) -> Codebook:
        return Codebook(entries, self.groups, self)

    def squared(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Squared distances of narrow parts to some entries; exact integers, infinite for far entries."""
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ self.points[own].T) + self.squares[own]
        d[:, self.far[own]] = np.inf
        return d

    def to_own(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        diff = x - self.points[code]
        return np.where(self.far[code], np.inf, (diff * diff).sum(axis=1))

    def nearest(self, values: list[int]) -> tuple[int, int]:
        """(squared distance, entry) in integers of any size."""
        return min((sum((a - b) ** 2 for a, b in zip(values, e)), i) for i, e in enumerate(self.entries))


def _length(a: list[int], b: list[int]) -> float:
    """An upper bound of the distance of two integer points."""
    total = sum((x - y) ** 2 for x, y in zip(a, b))
    return float(total) ** 0.5 * (1 + SLACK) if total < 1 << 1000 else float("inf")


def _grouped(points: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> list[np.ndarray]:
    """Indexes of entries by cluster, in a few Lloyd rounds over the entries alone."""
    at = np.linspace(0, len(points) - 1, min(groups, len(points))).astype(int)
    middle = points[at]
    for _ in range(rounds):
        own = ((points[:, None, :] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        middle = np.array([points[own == g].mean(axis=0) if (own == g).any() else middle[g] for g in range(len(middle))]).reshape(middle.shape)
    return [g for k in range(len(middle)) if len(g := np.flatnonzero(own == k))]


def first_bounds(book: Codebook, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, upper, lower, entries scanned) by all distances."""
    d = book.squared(x, np.arange(len(book.entries)))
    code = d.argmin(axis=1)
    upper = np.sqrt(d[np.arange(len(x)), code])
    d[np.arange(len(x)), code] = np.inf
    lower = np.stack([_capped(book, own, np.sqrt(d[:, own].min(axis=1))) for own in book.groups], axis=1)
    return code, upper, lower, d.size


def _capped(book: Codebook, own: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return np.minimum(lower, book.far_off - 1) if book.far[own].any() else lower


def next_bounds(book: Codebook, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, upper, lower, entries scanned) from those of the last round, for entries that have drifted."""
    code, upper = code.copy(), upper + book.drift[code]
    with np.errstate(invalid="ignore"):
        lower = np.maximum(np.nan_to_num(lower - book.group_drift, nan=0.0, posinf=np.inf), 0.0)
    open_ = np.flatnonzero(lower.min(axis=1) <= upper * (1 + SLACK))
    if not len(open_):
        return code, upper, lower, 0
    own = book.to_own(x[open_], code[open_])
    upper[open_] = np.sqrt(own)
    fails = lower[open_] <= upper[open_, None] * (1 + SLACK)
    best, entry, scanned = own.copy(), code[open_], len(open_)
    least, second = np.full(fails.shape, np.inf), np.full(fails.shape, np.inf)
    for g, members in enumerate(book.groups):
        rows = np.flatnonzero(fails[:, g])
        if not len(rows):
            continue
        d = book.squared(x[open_[rows]], members)
        scanned += d.size
        # argmin takes the first, and members rise, so ties within a group go to the lower index.
        first = d.argmin(axis=1)
        least[rows, g] = d[np.arange(len(rows)), first]
        found = members[first]
        better = (least[rows, g] < best[rows]) | ((least[rows, g] == best[rows]) & (found < entry[rows]))
        best[rows[better]], entry[rows[better]] = least[rows[better], g], found[better]
        d[np.arange(len(rows)), first] = np.inf
        second[rows, g] = d.min(axis=1)
    group = book.group_of[entry]
    for g, members in enumerate(book.groups):
        rows = np.flatnonzero(fails[:, g])
        near = np.where(group[rows] == g, second[rows, g], least[rows, g])
        lower[open_[rows], g] = _capped(book, members, np.sqrt(near))
    # The entry left behind belongs to its group's others now; scanned groups have counted it.
    left = np.flatnonzero(entry != code[open_])
    old = book.group_of[code[open_[left]]]
    keep = ~fails[left, old]
    at, old = open_[left[keep]], old[keep]
    lower[at, old] = np.minimum(lower[at, old], np.sqrt(own[left[keep]]))
    code[open_], upper[open_] = entry, np.sqrt(best)
    return code, upper, lower, scanned


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


class Batch:
    """A batch's integer parts: exact floats where all of a vector is narrow, the others in integers."""

    def __init__(self, column: pa.Array, dim: int, parts: int, narrow: float):
        raw = _matrix(column, dim)
        with np.errstate(over="ignore"):
            self.x = np.floor(raw * SCALE)
        self.wide = np.flatnonzero(np.abs(self.x).max(axis=1, initial=0.0) > narrow)
        self.integers = {int(i): floors(raw[i].tolist()) for i in self.wide}
        self.x[self.wide] = 0
        self.bounds = bounds_of(dim, parts)

    def part(self, p: int) -> np.ndarray:
        a, b = self.bounds[p]
        return self.x[:, a:b]

    def whole(self, p: int, rows) -> Iterator[tuple[int, list[int]]]:
        a, b = self.bounds[p]
        for i in rows:
            yield i, self.integers[i][a:b] if i in self.integers else [int(v) for v in self.x[i, a:b]]


def _assign(rows: DataFrame, books: list[Codebook], dim: int, first: bool) -> DataFrame:
    """The vectors with their codes and bounds against these codebooks; ``scanned`` counts distances computed."""
    parts, narrow = len(books), min(b.narrow for b in books)
    shared = rows.sparkSession.sparkContext.broadcast(books)  # PARTS * ENTRIES entries
    groups = [len(b.groups) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, CHUNK):
                b = whole.slice(a, CHUNK)
                held, n = Batch(b.column(1), dim, parts, narrow), b.num_rows
                codes, uppers = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32)
                lowers, scanned = np.zeros((n, sum(groups)), np.float32), np.zeros(n, np.int64)
                if not first:
                    old = [np.frombuffer(b"".join(b.column(i).to_pylist()), t).reshape(n, -1) for i, t in ((3, np.uint8), (4, np.float32), (5, np.float32))]
                at, count = 0, 0
                for p, book in enumerate(books):
                    own = slice(at, at := at + groups[p])
                    if not book.exact:
                        for i, v in held.whole(p, range(n)):
                            codes[i, p] = book.nearest(v)[1]
                        continue
                    if first:
                        code, upper, lower, some = first_bounds(book, held.part(p))
                    else:
                        code, upper, lower, some = next_bounds(book, held.part(p), old[0][:, p].astype(np.int64), old[1][:, p].astype(np.float64), old[2][:, own].astype(np.float64))
                    for i, v in held.whole(p, held.wide.tolist()):
                        code[i] = book.nearest(v)[1]
                    codes[:, p], uppers[:, p], lowers[:, own] = code, upper * (1 + SLACK), lower * (1 - SLACK)
                    count += some
                scanned[:1] = count
                packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (codes, uppers, lowers)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *packed, pa.array(scanned)], ["vec_id", "embedding", "label", "codes", "uppers", "lowers", "scanned"])

    given = rows if first else rows.select("vec_id", "embedding", "label", "codes", "uppers", "lowers")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, embedding {kinds['embedding']}, label {kinds['label']}, codes binary, uppers binary, lowers binary, scanned long"
    return materialise(given.mapInArrow(arrow_task(run), schema), "yinyang-round")


def _limbs(value: int) -> Iterator[int]:
    """Digits of an integer of any size, the last one with its sign; a long holds each."""
    while not -LIMB <= value < LIMB:
        value, low = divmod(value, LIMB)
        yield low
    yield value


def _means(coded: DataFrame, books: list[Codebook], dim: int) -> list[Codebook]:
    """The codebooks with each used entry at the floored mean of its parts."""
    parts, entries, narrow = len(books), len(books[0].entries), min(b.narrow for b in books)
    width = max(b - a for a, b in bounds_of(dim, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        wide: dict[tuple[int, int, int], int] = {}
        for b in batches:
            held, codes = Batch(b.column(0), dim, parts, narrow), np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                x = held.part(p).astype(np.int64)
                np.add.at(sums[p, :, : x.shape[1]], codes[:, p], x)
                sums[p, :, width] += np.bincount(codes[:, p], minlength=entries)
                for i, v in held.whole(p, held.wide.tolist()):
                    for k, value in enumerate(v):
                        key = p, int(codes[i, p]), k
                        wide[key] = wide.get(key, 0) + value
        found = [(int(p), int(e), 0, sums[p, e].tolist()) for p, e in np.argwhere(sums[:, :, width])]
        for (p, e, k), value in wide.items():
            for limb, digit in enumerate(_limbs(value)):
                found.append((p, e, limb, [digit if j == k else 0 for j in range(width + 1)]))
        cols = zip(*found) if found else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())])], ["part", "entry", "limb", "sums"])

    partial = coded.select("embedding", "codes").mapInArrow(arrow_task(run), "part int, entry int, limb int, sums array<long>")
    total = partial.groupBy("part", "entry", "limb").agg(F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(width + 1)]).alias("sums"))
    found: dict[tuple[int, int], list[int]] = {}
    for r in total.collect():  # PARTS * ENTRIES rows, and some more for very wide numbers
        own = found.setdefault((r.part, r.entry), [0] * (width + 1))
        for k, s in enumerate(r.sums):
            own[k] += int(s) * LIMB**r.limb
    out = []
    for p, book in enumerate(books):
        size = len(book.entries[0])
        out.append(book.moved([[s // found[p, e][width] for s in found[p, e][:size]] if (p, e) in found else old for e, old in enumerate(book.entries)]))
    return out


def _coded(rows: DataFrame, books: list[Codebook], dim: int) -> DataFrame:
    """(vec_id, label, code, error): final codes as text with the squared distances in integers."""
    parts, narrow = len(books), min(b.narrow for b in books)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for b in batches:
            held, codes = Batch(b.column(1), dim, parts, narrow), np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, parts)
            error = np.zeros(b.num_rows, object)
            for p, book in enumerate(books):
                near = book.to_own(held.part(p), codes[:, p])
                loose = set(held.wide.tolist()) | set(np.flatnonzero(~np.isfinite(near)).tolist())
                near[list(loose)] = 0
                error += near.astype(np.int64)
                for i, v in held.whole(p, loose):
                    error[i] += sum((x - y) ** 2 for x, y in zip(v, book.entries[codes[i, p]]))
            hexes = pa.array([r.tobytes().hex() for r in codes], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), hexes, pa.array([min(int(e), LONGEST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("vec_id", "embedding", "label", "codes").mapInArrow(arrow_task(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[Codebook], int]:
    """(the vectors with codes against the final codebooks, these codebooks, the vectors' length)."""
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    dim = len(start[0].embedding)
    start = [floors(r.embedding) for r in start if len(r.embedding) == dim]
    books = [Codebook([v[a:b] for v in start]) for a, b in bounds_of(dim, parts)]
    coded = _assign(rows.where(F.size("embedding") == dim), books, dim, True)
    for _ in range(rounds):
        books = _means(coded, books, dim)
        coded, before = _assign(coded, books, dim, False), coded
        drop_table(before)
    return coded, books, dim


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of all vectors that take part."""
    bound_batches(vectors.sparkSession)
    sound = F.forall(F.col("embedding"), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = pick(vectors, "vec_id", "embedding", "label").where("embedding IS NOT NULL").where(sound)
    if rows.isEmpty():
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded, books, dim = train(rows, parts, entries, rounds)
    done = materialise(_coded(coded, books, dim), "yinyang-codes")
    drop_table(coded)
    sums = done.groupBy(F.col("label").alias("l")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = materialise(sums, "yinyang-labels")
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book.entries for x in e).encode()).hexdigest()
    return done.join(sums, done.label.eqNullSafe(sums.l)).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same codes by all distances in every round."""
    steps = [f"""v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT r, p, e[(p * len(e) // {parts} + 1):((p + 1) * len(e) // {parts})] AS x FROM v, range({parts}) AS t(p) WHERE len(e) = (SELECT len(e) FROM v WHERE r = 0)
), book0 AS (SELECT p, r AS c, x AS y FROM parts WHERE r < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS (
  SELECT parts.r, p, min({{'d': list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': c}}) AS best FROM parts JOIN book{k} USING (p) GROUP BY parts.r, p
)""")
        if k < rounds:
            steps.append(f"""sums{k} AS (
  SELECT p, c, list(s ORDER BY i) AS y FROM (SELECT p, n.best.c AS c, i, floor(sum(x[i]) / count(*))::BIGINT AS s FROM near{k} n JOIN parts USING (r, p), range(1, len(x) + 1) AS t(i) GROUP BY ALL) GROUP BY p, c
), book{k + 1} AS (SELECT p, c, coalesce(sums{k}.y, book{k}.y) AS y FROM book{k} LEFT JOIN sums{k} USING (p, c))""")
    return "WITH " + ", ".join(steps) + f""", coded AS (
  SELECT r, string_agg(lpad(lower(to_hex(n.best.c)), 2, '0'), '' ORDER BY p) AS code, sum(n.best.d)::BIGINT AS error FROM near{rounds} n GROUP BY r
), digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (r), digest"""
