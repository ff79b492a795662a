"""Queries whose figures grew too fast with their input: the same results by less work."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import normalise, scalars


@pytest.fixture
def odd_texts(spark):
    texts = ["", "  a b", "Title: x\n\f body  of-\n text ", "​​head ﬁne—\n low", "é é", None]
    return spark.createDataFrame([(t, h) for t in texts for h in (0, 1, 3, 9, 40, None)], "raw string, head int")


def test_floor_without_maps(odd_texts):
    """the floor is that of the map, which never leaves its task."""
    rows = odd_texts.withColumn("x", normalise.normalise_udf()("raw"))
    want = F.when(F.col("raw").isNotNull() & F.col("head").isNotNull(), scalars.lower_bound(F.col("x.norm_map"), F.col("head")))
    got = rows.select(want.alias("want"), normalise.norm_floor_udf("raw", "head").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert {r.got for r in got} > {None, 0, 3}


def test_two_words_without_pairs(spark):
    """strings that share a frequent word meet its places once, and copies of a text or a string are counted, not paired."""
    from quillspark.operators import postings

    texts = ["The a", "in The ab The b", "'The a of", "The", "a b The abc", None, "", "The  a"] + ["The of it"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "paper_id long, norm string")
    strings = ["The a", "The ab", "e a", "The", "ab", " a", "The ", "The of", "b The ab", " ", "of it"] + ["The of"] * 30
    asked = spark.createDataFrame(list(enumerate(strings)), "quote_id long, norm string")
    want = sorted((d, s) for d, t in enumerate(texts) for s, x in enumerate(strings) if t and x in t)
    index = postings.build(docs, "norm")
    assert sorted(map(tuple, postings.search(index, asked, "norm").collect())) == want
    counts = {s: (sum(q == s for _, q in want), min(d for d, q in want if q == s)) for s in {q for _, q in want}}
    assert {r.quote_id: (r.n_docs, r.first_doc) for r in postings.counted(index, asked, "norm").collect()} == counts
    distinct = asked.selectExpr("norm", "monotonically_increasing_id() AS q").dropDuplicates(["norm"]).selectExpr("q", "split(norm, ' ', -1) AS words").selectExpr("q", "words", "size(words) AS size")
    assert postings._short(index, distinct.localCheckpoint().where("size <= 2")).count() == len({(d, strings[s]) for d, s in want if len(strings[s].split(" ")) <= 2})


def test_region_moves_texts_once(spark):
    """F8: no line is shuffled, and texts without a heading's words are not cut into lines."""
    import re

    from quillspark.operators import region

    listed = "Words.\nReferences\n" + "\n".join(f"[{k}] Smith, J. Title. Journal, 19{k}." for k in range(60, 99))
    docs = spark.createDataFrame([(1, listed), (2, "no list"), (3, None), (4, ""), (5, "References are few"), (6, listed + "\n\n")], "paper_id long, raw string")
    found = region.detect(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    rows = {r.paper_id: (r.start_char, r.status) for r in found.collect()}
    assert rows.pop(1)[0] == rows.pop(6)[0] == 7
    assert set(rows.values()) == {(None, "REGION_UNKNOWN")} and len(rows) == 4
