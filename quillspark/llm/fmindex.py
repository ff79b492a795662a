"""Benchmark decontamination with one FM-index for each shard of the training text.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. A test
phrase is ten consecutive words of an item, or the whole of a shorter item. A shard is a run of
documents of one partition, of about ``SHARD_WORDS`` words. Its word numbers are indexed: a
suffix array by prefix doubling, the Burrows-Wheeler transform, a wavelet matrix for ranks, and
suffix positions sampled at every eighth place. All phrases are searched backwards at once,
their rows are walked to sampled places, and the spans of a document merge into its hit words.

Words that no item has become one separator before indexing, and stretches between separators
that are shorter than the shortest phrase are left out: no phrase can lie in them, so the
result is the same and the index is small.

Items are sent to executors in blocks of about ``BLOCK_WORDS`` words, one at a time, so their size
has a bound on the driver too; the documents are read once a block. With one block each row is final
in its task; with more, the spans of the later blocks are written for rows with hits, and merged by
a key made of the whole row, so the result is that of one block.

Null and empty texts have no words and no hits. Null items and items without words have no
phrase. Items that repeat an id count once; an item whose id is null marks words but is not
named or counted. Repeated documents each keep a row. Empty tables give no rows, or rows
without hits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_task, bound_batches, materialise, pick, place_of
from quillspark.llm.suffixes import suffix_array

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 4_000_000
SAMPLE = 8

_TO = bytearray(range(256))
for _c in [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]:
    _TO[_c] = 0x20
for _c in range(0x41, 0x5B):
    _TO[_c] = _c + 32
_TO = bytes(_TO)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_TO).split()


class WaveletMatrix:
    """Ranks of symbols below 2 ** levels in a sequence."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels, self.zeros, self.ranks = levels, [], []
        cur = seq
        for level in range(levels - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(np.int32)
            ones = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(len(cur) - int(ones[-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        lo, hi = np.zeros_like(at), at.copy()
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            ones, z = self.ranks[k], self.zeros[k]
            l1, h1 = ones[lo], ones[hi]
            lo = np.where(bit == 1, z + l1, lo - l1)
            hi = np.where(bit == 1, z + h1, hi - h1)
        return hi - lo

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        lo, pos, symbol = np.zeros_like(at), at.copy(), np.zeros_like(at)
        for k in range(self.levels):
            ones, z = self.ranks[k], self.zeros[k]
            p1, l1 = ones[pos], ones[lo]
            bit = ones[pos + 1] - p1
            symbol = symbol * 2 + bit
            pos = np.where(bit == 1, z + p1, pos - p1)
            lo = np.where(bit == 1, z + l1, lo - l1)
        return symbol, pos - lo


class FMIndex:
    """Backward search over a sequence of numbers from 1 up; 0 ends it."""

    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        seq = np.append(seq, 0).astype(np.int64)
        order, _ = suffix_array(seq)
        self.n = len(seq)
        self.bwt = WaveletMatrix(seq[order - 1], max(1, int(n_symbols).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols + 1))]).astype(np.int64)
        marked = order % sample == 0
        self.marked = np.concatenate([[0], np.cumsum(marked)])
        self.sampled = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each phrase; ``phrases`` is a matrix, a phrase a row."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.first[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.first[c] + self.bwt.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in these rows."""
        place, walked = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            done = self.marked[at + 1] > self.marked[at]
            place[live[done]] = self.sampled[self.marked[at[done]]] + walked[live[done]]
            live, at = live[~done], at[~done]
            symbol, rank = self.bwt.access_rank(at)
            at = self.first[symbol] + rank
            walked[live] += 1
        return place


class Phrases:
    """The phrases of a block of items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item_id, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 2) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                names = found.setdefault(tuple(ids[i : i + window]), set())
                if item_id is not None:
                    names.add(item_id)
        self.items = list(found.values())
        self.least = min(map(len, found), default=0)
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []
        for size in sorted({len(p) for p in found}):
            some = [(k, p) for k, p in enumerate(found) if len(p) == size]
            self.groups.append((np.array([k for k, _ in some]), np.array([p for _, p in some], np.int64)))

    @property
    def n_symbols(self) -> int:
        return len(self.vocab) + 1


def search_shard(docs: list[np.ndarray], phrases: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, starts, ends, phrase numbers) of each document with hits; ``docs``: word numbers, 0 where no item has the word."""
    lengths = np.array([len(d) for d in docs], np.int64)
    # A separator after each document keeps phrases from running over its end.
    flat = np.zeros(int(lengths.sum()) + len(docs), np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    for d, a in zip(docs, begin):
        flat[a : a + len(d)] = d
    known = np.concatenate([[False], flat > 0])
    edge = np.diff(known.astype(np.int8), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(ends) < len(starts):
        ends = np.append(ends, len(flat))
    long = ends - starts >= max(1, phrases.least)
    starts, ends = starts[long], ends[long]
    if not len(starts) or not phrases.groups:
        return
    sizes = ends - starts
    offset = np.concatenate([[0], np.cumsum(sizes + 1)])
    seq = np.ones(int(offset[-1]), np.int64)
    source = np.repeat(starts - offset[:-1], sizes + 1) + np.arange(len(seq))
    inner = np.ones(len(seq), bool)
    inner[offset[1:] - 1] = False
    seq[inner] = flat[source[inner]]
    index = FMIndex(seq, phrases.n_symbols)
    at, size, number = [], [], []
    for numbers, matrix in phrases.groups:
        lo, hi = index.search(matrix)
        count = hi - lo
        if not count.any():
            continue
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        at.append(source[index.locate(rows)])
        size.append(np.full(len(rows), matrix.shape[1]))
        number.append(np.repeat(numbers, count))
    if not at:
        return
    at, size, number = map(np.concatenate, (at, size, number))
    doc = np.searchsorted(begin, at, side="right") - 1
    by = np.argsort(doc, kind="stable")
    doc, at, size, number = doc[by], at[by], size[by], number[by]
    cut = np.flatnonzero(np.diff(doc)) + 1
    for d, a, s, p in zip(doc[np.concatenate([[0], cut])], np.split(at, cut), np.split(size, cut), np.split(number, cut)):
        yield int(d), a - begin[d], a - begin[d] + s, p


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch become one."""
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)] if len(starts) else ends


def _blocks(items: DataFrame, block_words: int) -> list[DataFrame]:
    """The items, cut by hash where they have more words than one block may hold."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // (2 * block_words)) or 1
    # By id and text, so that an item whose text many others have does not bring them all.
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


#: What is made of the batches of ``_spans``, and its schema.
Then = tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]


def _spans(docs: DataFrame, phrases: Phrases, shard_words: int, carry: list[str], then: Then | None = None) -> DataFrame:
    """The carried columns with n_words, starts, ends (merged word spans) and item ids as text; or
    what ``then`` makes of them in the same worker, as a second step would take a second worker."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    text_at = docs.columns.index("text")
    carry_at = [docs.columns.index(c) for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        number = phrases.vocab.get

        def finish(kept: list[pa.RecordBatch], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            starts, ends, names = ([[] for _ in docs] for _ in range(3))
            for d, a, b, p in search_shard(docs, phrases):
                starts[d], ends[d] = (x.tolist() for x in merge(a, b))
                names[d] = sorted({str(i) for k in np.unique(p) for i in phrases.items[k]})
            table = pa.Table.from_batches(kept).combine_chunks()
            cols = [table.column(i).combine_chunks() for i in range(len(carry_at))]
            out = [pa.array([len(d) for d in docs], pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))]
            yield from pa.Table.from_arrays([*cols, *out], [*carry, "n_words", "starts", "ends", "items"]).to_batches()

        kept, docs, total = [], [], 0
        for batch in batches:
            first = 0
            for i, text in enumerate(batch.column(text_at)):
                words = words_of(text.as_py())
                docs.append(np.fromiter((number(w, 0) for w in words), np.int32, len(words)))
                total += len(words)
                if total >= shard_words:
                    kept.append(batch.select(carry_at).slice(first, i + 1 - first))
                    yield from finish(kept, docs)
                    kept, docs, total, first = [], [], 0, i + 1
            if first < batch.num_rows:
                kept.append(batch.select(carry_at).slice(first))
        if docs:
            yield from finish(kept, docs)

    if then:
        return docs.mapInArrow(arrow_task(lambda batches: then[0](run(batches))), then[1])
    fields = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in carry)
    return docs.mapInArrow(arrow_task(run), f"{fields}, n_words long, starts array<long>, ends array<long>, items array<string>")


def _spans_of_all(docs: DataFrame, items: DataFrame, carry: list[str], window: int, shard_words: int, block_words: int, then: Then | None = None) -> DataFrame:
    items = pick(items, "item_id", "text").where(F.col("text").isNotNull())
    blocks = _blocks(items, block_words)
    if len(blocks) == 1:
        return _spans(docs, Phrases([tuple(r) for r in blocks[0].collect()], window), shard_words, carry, then)
    # Rows alike in what is carried and in the text have the same hits; others never share a key.
    row = F.struct(F.xxhash64(*carry, "text"), F.hash("text", *carry), F.length("text"))
    keyed = docs.withColumn("__row", row)
    first, others = None, []
    for block in blocks:
        found = _spans(keyed, Phrases([tuple(r) for r in block.collect()], window), shard_words, ["__row", *carry] if first is None else ["__row"])
        if first is None:
            first = materialise(found, "leaks-first")
        else:
            others.append(materialise(found.where("size(starts) > 0").dropDuplicates(["__row"]), "leaks-block"))
    more = others[0]
    for table in others[1:]:
        more = more.unionByName(table)
    more = more.groupBy("__row").agg(*[F.flatten(F.collect_list(c)).alias(f"__{c}") for c in ("starts", "ends", "items")])
    joined = first.join(more, "__row", "left")
    whole = lambda c, kind: F.concat(c, F.coalesce(f"__{c}", F.array().cast(f"array<{kind}>")))
    found = joined.select(*carry, "n_words", whole("starts", "long").alias("starts"), whole("ends", "long").alias("ends"), F.array_distinct(whole("items", "string")).alias("items"))
    return found.mapInArrow(arrow_task(then[0]), then[1]) if then else found


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = _spans_of_all(pick(docs, "doc_id", "text"), items, ["doc_id"], window, shard_words, block_words)
    return _digest(found)


def _digest(found: DataFrame) -> DataFrame:
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, sha, n = [], [], []
            for starts, ends, items in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                s, e = merge(np.array(starts, np.int64), np.array(ends, np.int64)) if starts else ((), ())
                hit.append(int(np.sum(e) - np.sum(s)) if len(s) else 0)
                sha.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
                n.append(len(items))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array([h > 0 for h in hit])], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = dict(found.dtypes)["doc_id"]
    return found.mapInArrow(arrow_task(counts), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def cut_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with every merged span of test phrases taken out of the text; same columns and rows.

    A text without hits stays as it is, to the byte. What stands around a span is joined by one
    space. n_chars, where there is such a column, is counted anew for texts that changed. Null and
    empty texts stay, repeated rows are cut alike, an empty table gives none, and an empty table of
    items changes nothing.
    """
    import re

    names = [f"c{i}" for i in range(len(docs.columns))]
    lower = [c.lower() for c in docs.columns]
    at = names[place_of(docs, "text")]
    own = docs.toDF(*names)
    frame = own.withColumnRenamed(at, "text")
    carry = [c for c in frame.columns]
    place = carry.index("text")
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(place).to_pylist()
            for i, (starts, ends) in enumerate(zip(b.column(len(carry) + 1).to_pylist(), b.column(len(carry) + 2).to_pylist())):
                if not starts:
                    continue
                s, e = merge(np.array(starts, np.int64), np.array(ends, np.int64))
                spans, last, parts = [m.span() for m in word.finditer(texts[i])], 0, []
                for x, y in zip(s, e):
                    parts.append(texts[i][last : spans[x][0]].strip())
                    last = spans[y - 1][1]
                parts.append(texts[i][last:].strip())
                texts[i] = " ".join(p for p in parts if p)
            cols = [b.column(i) for i in range(len(carry))]
            cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, carry)

    fields = ", ".join(f"`{c}` {t}" for c, t in frame.dtypes)
    out = _spans_of_all(frame, items, carry, window, shard_words, block_words, (run, fields)).toDF(*names)
    if "n_chars" in lower:
        n = names[place_of(docs, "n_chars")]
        out = out.withColumn(n, F.when(F.col(at).isNull() | F.col(n).isNull(), F.col(n)).otherwise(F.length(at)).cast(dict(own.dtypes)[n]))
    return out.toDF(*docs.columns)
