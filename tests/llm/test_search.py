"""Decontamination, vector search and packing against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import fmindex, packing, queries, vafile
from quillspark.llm.suffixes import suffix_array


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(text, items, window=10):
    w, hit, named = words(text), set(), set()
    for i, t in items:
        x = words(t) if t is not None else []
        for k in range(max(1, len(x) - window + 1) if x else 0):
            p = x[k : k + window]
            for a in range(len(w) - len(p) + 1):
                if w[a : a + len(p)] == p:
                    hit |= set(range(a, a + len(p)))
                    if i is not None:
                        named.add(str(i))
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


def test_index():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, v = rng.integers(1, 60), rng.integers(2, 5)
        seq = rng.integers(1, v + 1, n)
        whole = np.append(seq, 0)
        order, _ = suffix_array(whole)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: whole[i:].tolist())
        index = fmindex.FMIndex(seq, int(v), sample=4)
        for size in (1, 2, 3):
            asked = rng.integers(1, v + 1, (5, size))
            for p, a, b in zip(asked, *index.search(asked)):
                assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - size + 1) if (seq[i : i + size] == p).all()]


ITEMS = [(1, "the harvest of the valley was good and the mill was still in it"), (2, "short item here"), (3, None), (4, "..."), (2, "Short item HERE"), (None, "a nameless one"), (10, "the the the the")]
TEXTS = ["x the harvest of the valley was good and the mill was still in it y", "SHORT item, here! short item here", "the the the the the the", "harvest of the valley was good and the mill was", None, "", "a nameless one", "the harvest of the valley was good", "Ünï short item here ünï"]


@pytest.mark.parametrize(("shard", "block"), [(2_000_000, 4_000_000), (5, 4_000_000), (7, 4)])
def test_decontaminate(spark, shard, block):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumn("n_hit", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = fmindex.decontaminate(docs, items, shard_words=shard, block_words=block)
    for r in got.collect():
        assert tuple(r)[1:] == plain_hits(TEXTS[r.doc_id], ITEMS), r
    assert got.count() == len(TEXTS)


@pytest.mark.parametrize("block", [4_000_000, 5])
def test_rows_that_share_an_id(spark, block):
    texts = [(5, TEXTS[0]), (5, "nothing of it"), (None, TEXTS[1]), (None, "clean words"), (5, TEXTS[0]), (5, None)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = sorted(tuple(r)[1:] for r in fmindex.decontaminate(docs, items, block_words=block).collect())
    assert got == sorted(plain_hits(t, ITEMS) for _, t in texts)
    cut = sorted(str(r.text) for r in fmindex.cut_spans(docs, items, block_words=block).collect())
    assert cut == sorted(["x y", "x y", "nothing of it", "", "clean words", "None"])


def test_decontaminate_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    pairs = [tuple(r) for r in items.collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = fmindex.decontaminate(docs, items).collect()
    assert len(rows) == len(texts)
    hit = [r for r in rows if r.contaminated]
    assert hit
    for r in hit + rows[:10]:
        assert tuple(r)[1:] == plain_hits(texts[r.doc_id], pairs)


def test_decontaminate_odd_rows(spark, odd_docs):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert fmindex.decontaminate(odd_docs, items).count() == 12
    assert fmindex.decontaminate(odd_docs.limit(0), items).count() == 0
    assert {r.contaminated for r in fmindex.decontaminate(odd_docs, items.limit(0)).collect()} == {False}


def test_cut_spans(spark, odd_docs):
    items = spark.createDataFrame([(1, "valley was good")], "item_id int, text string")
    out = fmindex.cut_spans(odd_docs, items)
    assert out.columns == odd_docs.columns and out.count() == 12
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].text == "The harvest of the and the mill was still." and by[1].n_chars == len(by[1].text)
    was = {r.doc_id: r.text for r in odd_docs.collect()}
    assert all(by[i].text == was[i] for i in by if i not in (1, 2))


def test_cut_spans_in_one_worker(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    out = fmindex.cut_spans(docs, items)
    # Each Python step of a task holds a worker of its own, and idle ones stay.
    assert out._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    rows = sorted(map(str, out.collect()))
    assert len(rows) == len(TEXTS) and any("text='x y'" in r for r in rows)
    for shard, block in ((5, 4_000_000), (7, 4)):
        assert sorted(map(str, fmindex.cut_spans(docs, items, shard_words=shard, block_words=block).collect())) == rows


def plain_top(rows, k=5, every=50):
    v = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            v[i] = np.array([math.floor(256 * x) for x in e], object)
    out = []
    for q in (i for i in v if i % every == 0):
        best = sorted((-int(sum(v[q] * v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
        out += [(q, n + 1, c, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, c) in enumerate(best)]
    return sorted(out)


def test_vectors(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    got = sorted(tuple(r) for r in vafile.search(df, F.col("vec_id") % 50 == 0).collect())
    assert got == plain_top([(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize(("block", "cells"), [(2048, 256), (2, 64), (3, 2)])
def test_odd_vectors(spark, block, cells):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(120)]
    rows += [(i, [0.5] * 6) for i in range(200, 260)]  # ties
    rows += [(300, None), (350, []), (360, []), (None, [0.1] * 6), (400, [None] * 6), (450, [float("nan")] * 6), (500, [float("inf")] * 6), (550, [0.1, 0.2]), (551, [0.3, 0.2])]
    df = spark.createDataFrame(rows + [(200, [0.5] * 6)], "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("v", F.lit(1))
    got = sorted(tuple(r) for r in vafile.search(df, F.col("vec_id") % 50 == 0, cells=cells, block=block).collect())
    assert got == plain_top(rows)
    assert vafile.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("scale", [5000.0, 3e9, 1e13])
def test_great_components(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=5) * (scale if i % 7 == 0 else 1)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in vafile.search(df, F.col("vec_id") % 10 == 0).collect()) == plain_top(rows, every=10)


def test_tokenizer():
    t = packing.tokenizer(queries.vocabulary())
    for x in ["it's Ünïcode don't''s <|endoftext|> hi", "a\x1cb", "ΣΑΣ", "", "İx é", "'S'T 123 ½ ﬁ", "<|startoftext|", "x\x00y", "a  b\n\tc, d.e!?", "ŉ ſ ÿ Ÿ Ǆ", "é", "naïve co-op's 42nd"]:
        assert t.full.encode(x, add_special_tokens=False).ids == t.ids(x).tolist(), x


def check_pieces(pieces, texts, path, length=4096):
    t = packing.tokenizer(path)
    want = {i: t.full.encode(x or "", add_special_tokens=False).ids + [2] for i, x in texts.items()}
    of, at = {}, {}
    for p in pieces:
        of.setdefault(p.doc_id, []).append(p)
        at.setdefault(p.sequence_id, []).append(p)
    assert of.keys() == want.keys()
    for i, ps in of.items():
        here = 0
        for p in sorted(ps, key=lambda p: p.start):
            ids = want[i][p.start : p.start + p.length]
            assert p.start == here and p.doc_tokens == len(want[i]) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            here += p.length
        assert here == len(want[i])
    for ps in at.values():
        here = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == here
            here += p.length
        assert here <= length and (here == length or here & (here - 1) == 0)


@pytest.mark.parametrize(("length", "n_open", "merge"), [(4096, 32, 256), (64, 3, 2)])
def test_packing(spark, small, length, n_open, merge):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(5)
    rows = {r.doc_id: r.text for r in docs.collect()}
    path = queries.vocabulary()
    pieces = packing.pack(docs, path, length, n_open, merge).collect()
    check_pieces(pieces, rows, path, length)


def test_packing_odd_rows(spark, odd_docs):
    path = queries.vocabulary()
    some = odd_docs.where("doc_id IS NOT NULL AND doc_id <> 2")
    check_pieces(packing.pack(some, path).collect(), {r.doc_id: r.text for r in some.collect()}, path)
    assert packing.pack(odd_docs, path).agg(F.count_if(F.col("start") == 0)).first()[0] == 12
    assert packing.pack(odd_docs.limit(0), path).collect() == []
