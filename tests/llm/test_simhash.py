"""Near duplicates against all pairs."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import shingles, simhash


def plain(text, shingle=3):
    """The fingerprint by the letter of its definition."""
    import re

    import xxhash

    low = "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > len(h) / 2)


def groups(fps, most=3):
    """Smallest index reachable, by all pairs."""
    fp = np.array(fps, np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= most
    label = np.arange(len(fp))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fp))])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("text", ["", None, " \t", "one", "One TWO", "a b c", "a b c d", "É é Ü", "a b c\x0bd e\x1cf", "x y z " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_spark_hashes_alike(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == __import__("xxhash").xxh64_intdigest(b"a b c", seed=42)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    label = groups([plain(r.text) for r in rows])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    for r, k in zip(rows, label):
        assert got[r.doc_id].fingerprint == f"{plain(r.text):016x}" and got[r.doc_id].component_id == rows[k].doc_id


def test_segments():
    assert simhash.segments(64, 3) == [(0, 32), (32, 32)] and simhash.segments(64, 5) == [(0, 22), (22, 21), (43, 21)]


@pytest.mark.parametrize(("bucket", "most"), [(512, 3), (4, 3), (512, 5), (4, 5), (4, 1)])
def test_links(spark, bucket, most):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 25)):
            fps.add(x)
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
    # One dense ball, whose buckets overflow.
    centre = rng.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(12), 3)) for _ in range(120)}
    fps |= {0, (1 << 64) - 1, 1 << 63, 7 << 61, 1 << 32, 1 << 31}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.array(x, np.uint64).view(np.int64)),) for x in fps], "fp long").repartition(3)
    edges = simhash.links(df, most, bucket)
    signed = [int(np.array(x, np.uint64).view(np.int64)) for x in fps]
    found = {r.node: r.label for r in simhash.components(edges, one_task=1 << 20 if most == 3 else 10).collect()}
    want = groups(fps, most)
    names: dict = {}
    for s, k in zip(signed, want):
        names.setdefault(int(k), set()).add(found.get(s, s))
    assert all(len(v) == 1 for v in names.values())
    assert len({next(iter(v)) for v in names.values()}) == len(names)


@pytest.mark.parametrize("one_task", [0, 5, 1 << 20])
def test_a_chain(spark, one_task):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.label for r in simhash.components(edges, one_task=one_task).collect()}
    assert simhash.components(edges.limit(0), one_task=one_task).collect() == []
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100


def test_odd_rows(spark, odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == 1 and by[3].component_id == by[4].component_id == by[5].component_id == 3
    assert by[3].fingerprint == "0" * 16
    assert simhash.near_duplicates(odd_docs.limit(0)).collect() == []
    kept = shingles.keep_one_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(2) == 0 and ids.count(1) == 1 and None in ids and len(ids) == len(set(ids))
    assert shingles.keep_one_each(odd_docs.limit(0)).collect() == []
