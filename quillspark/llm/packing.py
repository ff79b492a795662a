"""Bounded-space online packing of token sequences.

Each partition keeps ``OPEN`` windows open. A document's full windows are emitted at once; the
rest goes to the open window it fits best. When none fits, the fullest window takes as much of
it as it has room for and is emitted, and what is left opens a new window. At its end a
partition pours its open windows together, so it has one partly filled window at most. These
last windows are merged in groups of ``MERGE`` partitions in the same way; what a group has over
is cut into sequences of lengths that are powers of two, which need no padding.

A null text is packed like an empty one: its end token alone. Very long texts are cut at window
ends. Repeated rows are packed each, also where they repeat an id. A null id stays null. An
empty table gives no pieces. Other columns are ignored. A piece never holds tokens of two
documents, and its sequence and place follow from the partition's rows in their order, so a task
that runs again gives the same pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_task, bound_batches, materialise, pick

LENGTH = 4096
OPEN = 32
MERGE = 256
END_ID = 2
CACHE = 300_000

#: What a stretch of lower-cased text may not hold: anything but printable ASCII and the Latin
#: letters whose composed form and lower case are one character in every library.
_OTHER = re.compile("[^!-~ß-öø-įı-ſ]|<\\|")
#: White space that only some libraries take for such.
_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")


class _Odd(Exception):
    """A stretch of text that only the library itself may cut."""


class WordTokenizer(dict):
    """Ids of a lower-casing byte-pair tokenizer file. Stretches of plain Latin text between white
    space are looked up in this dictionary, which the library's own model fills; any other text
    goes to the library whole, with equal ids. Two generations of ``CACHE`` entries are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.full = Tokenizer.from_file(path)
        self.cut = self.full.model.tokenize
        self.kind = "H" if max(self.full.get_vocab().values()) < 1 << 16 else "I"
        self.older: dict[str, bytes] = {}
        self.tails = {c: array(self.kind, [t.id for t in self.cut(c)]).tobytes() for c in ".,;:!?)"}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.pop(chunk, None)
        if ids is None:
            ids = self._cut(chunk)
        self[chunk] = ids
        return ids

    def _cut(self, chunk: str) -> bytes:
        # One word, or one word and a sign after it, are the usual cases.
        if chunk.isalpha():
            if chunk.isascii():
                return array(self.kind, [t.id for t in self.cut(chunk)]).tobytes()
            if not _OTHER.search(chunk):
                return array(self.kind, [t.id for t in self.cut(_byte_level(chunk))]).tobytes()
        elif chunk[-1] in self.tails and chunk[:-1].isalpha():
            return self[chunk[:-1]] + self.tails[chunk[-1]]
        if _OTHER.search(chunk):
            raise _Odd
        return array(self.kind, [t.id for w in _PIECE.findall(chunk) for t in self.cut(_byte_level(w))]).tobytes()

    def ids(self, text: str) -> np.ndarray:
        if len(self) > CACHE:
            self.older = dict(self)
            self.clear()
        odd = _SPACE.search(text) if not text.isascii() else any(c in text for c in "\x1c\x1d\x1e\x1f")
        if not odd:
            try:
                return np.frombuffer(b"".join(map(self.__getitem__, text.lower().split())), self.kind).astype(np.uint32)
            except _Odd:
                pass
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


def _byte_level(word: str) -> str:
    """The word's UTF-8 bytes as the characters that stand for them in byte-level vocabularies."""
    return word.encode().decode("latin-1").translate(_BYTES)


#: Bytes that are not printable Latin-1 characters stand at 256 and up, in order.
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b))}


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class Packer:
    """Open windows of one partition; emits (doc, start, ids, doc tokens, sequence, offset)."""

    def __init__(self, length: int = LENGTH, n_open: int = OPEN, first: int = 0):
        self.length, self.n_open, self.next = length, n_open, first
        self.open: list[list] = []  # [room, [(doc, start, ids, doc tokens)]]
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids, total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        while len(ids) >= self.length:
            self._emit([(doc, start, ids[: self.length], total)])
            ids, start = ids[self.length :], start + self.length
        if not len(ids):
            return
        best = min((w for w in self.open if w[0] >= len(ids)), key=lambda w: w[0], default=None)
        if best is None and len(self.open) >= self.n_open:
            full = min(self.open, key=lambda w: w[0])
            self.open.remove(full)
            self._emit([*full[1], (doc, start, ids[: full[0]], total)])
            ids, start = ids[full[0] :], start + full[0]
        if best is None:
            self.open.append(best := [self.length, []])
        best[0] -= len(ids)
        best[1].append((doc, start, ids, total))
        if not best[0]:
            self.open.remove(best)
            self._emit(best[1])

    def pour(self) -> list[tuple]:
        """Open windows flow together; what fills no whole window is returned."""
        pieces = [p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]]
        self.open = []
        room, now = self.length, []
        for doc, start, ids, total in pieces:
            while len(ids) >= room:
                self._emit([*now, (doc, start, ids[:room], total)])
                ids, start, room, now = ids[room:], start + room, self.length, []
            if len(ids):
                now.append((doc, start, ids, total))
                room -= len(ids)
        return now

    def pour_out(self) -> None:
        """Like ``pour``; what is left is emitted in lengths that are powers of two."""
        left = self.pour()
        size = sum(len(p[2]) for p in left)
        while left:
            room, now, rest = 1 << (size.bit_length() - 1), [], []
            size -= room
            for doc, start, ids, total in left:
                if room:
                    now.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.append((doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self._emit(now)
            left = rest


_PIECES = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _table(out: list[tuple], kind: pa.DataType, extra: list | None = None) -> pa.RecordBatch:
    doc, start, ids, total, seq, at = zip(*out) if out else ((),) * 6
    ints = [start, [len(i) for i in ids], [_crc(i) for i in ids], total, seq, at]
    cols = [pa.array(doc, kind), *(pa.array(x, pa.int64()) for x in ints)]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if extra is not None:
        cols, names = [*cols, *extra], [*names, "part", "ids"]
    return pa.RecordBatch.from_arrays(cols, names)


def pack(docs: DataFrame, path: str, length: int = LENGTH, n_open: int = OPEN, merge: int = MERGE, make: Callable[[str], object] = tokenizer) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    bound_batches(docs.sparkSession)
    docs = pick(docs, "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        known, packer, id_type = make(path), Packer(length, n_open, part << 32), None
        for batch in batches:
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, np.append(known.ids(text.as_py() or ""), np.uint32(END_ID)))
            n = len(packer.out)
            yield _table(packer.out, id_type, [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())])
            packer.out = []
        if id_type is not None:
            left = [(*p, None, None) for p in packer.pour()]
            n = len(packer.out)
            yield _table(packer.out, id_type, [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())])
            yield _table(left, id_type, [pa.array([part] * len(left), pa.int64()), pa.array([p[2].astype("<u4").tobytes() for p in left], pa.binary())])

    pieces = materialise(docs.mapInArrow(arrow_task(run), f"{_PIECES.format(kind=kind)}, part long, ids binary"), "packing")
    names = pieces.columns[:7]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer, id_type = None, None, None
        for batch in batches:
            id_type = batch.column(0).type
            rows = zip(*(batch.column(i).to_pylist() for i in range(5)))
            for doc, start, total, part, ids in rows:
                if group != part // merge:
                    if packer:
                        packer.pour_out()
                        yield _table(packer.out, id_type)
                    group = part // merge
                    packer = Packer(length, n_open, (1 << 62) | (group << 32))
                packer.add(doc, np.frombuffer(ids, "<u4"), start, total)
        if packer:
            packer.pour_out()
            yield _table(packer.out, id_type)

    left = pieces.where("part IS NOT NULL").select("doc_id", "start", "doc_tokens", "part", "ids")
    left = left.repartition(F.floor(F.col("part") / merge)).sortWithinPartitions("part", "doc_id", "start")
    return pieces.where("part IS NULL").select(*names).unionByName(left.mapInArrow(arrow_task(last), _PIECES.format(kind=kind)))
