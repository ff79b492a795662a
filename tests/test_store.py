"""Prepared documents by content: what is prepared anew, and that answers don't change."""

import pytest
from pyspark.sql import functions as F

from quillspark.plans import served, store, verify

DOCS = [("a", "Its long-term plan was sound, they wrote, and no one said a word."), ("b", "Another text (Smith, 2001) stands here ﬁnally [3]."), ("c", "Its long-term plan was sound, they wrote, and no one said a word."), ("d", None), ("e", "  "), ("f", "")]


@pytest.fixture
def kept(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "store"))


def papers(spark, rows):
    return spark.createDataFrame(rows, "paper_id string, raw string")


def rows_of(corpus):
    """Rows by id; of a document without a text only that it is there counts."""
    rows = [r.asDict(True) for r in corpus.collect()]
    return sorted((r if r["raw"] is not None else {"paper_id": r["paper_id"], "norm": r["norm"]} for r in rows), key=lambda r: r["paper_id"])


def test_second_call_prepares_nothing(spark, kept, monkeypatch):
    first = rows_of(kept.prepare(papers(spark, DOCS)))
    assert kept.added == 4 and first == rows_of(verify.prepare_corpus(papers(spark, DOCS)))
    monkeypatch.setattr(verify, "prepare_corpus", lambda *a: pytest.fail("a text was prepared again"))
    assert rows_of(kept.prepare(papers(spark, DOCS))) == first and kept.added == 0


def test_only_new_texts_are_prepared(spark, kept):
    kept.prepare(papers(spark, DOCS[:2]))
    more = [*DOCS, ("g", "Quite new text."), ("h", "Quite new text.")]
    again = rows_of(kept.prepare(papers(spark, more)))
    assert kept.added == 3 and [r["paper_id"] for r in again] == list("abcdefgh") and again == rows_of(verify.prepare_corpus(papers(spark, more)))
    assert kept.held().count() == 5


def test_other_versions_are_left_out(spark, kept):
    kept.prepare(papers(spark, DOCS))
    other = store.Store(spark, kept.folder, "other")
    other.prepare(papers(spark, DOCS[:1]))
    assert other.added == 1 and kept.forget_others() == 1 and other.held() is None and kept.held().count() == 4
    assert store.versions() == kept.version


def test_no_papers(spark, kept):
    assert kept.prepare(papers(spark, [])).collect() == [] and kept.added == 0
    assert [r["norm"] for r in rows_of(kept.prepare(papers(spark, [("d", None)])))] == [None]


def test_answers_from_a_store(spark, kept):
    asked = spark.createDataFrame([(1, "long-term plan was sound"), (2, "Another text stands here finally"), (3, "quite other words than these")], "quote_id int, quote string")
    corpus = kept.prepare(papers(spark, DOCS))
    want, got = (sorted(map(str, verify.verify_quotes(papers(spark, DOCS), asked, corpus=c).collect())) for c in (None, corpus))
    assert got == want


def test_served_corpora_use_the_store(spark, kept, monkeypatch):
    seen = []
    monkeypatch.setattr(store.Store, "prepare", lambda self, rows, key="paper_id": seen.append(self.folder) or verify.prepare_corpus(rows, key))
    opened = served.Opened(papers(spark, DOCS), papers(spark, []).select("paper_id"), 0)
    monkeypatch.setattr(served, "open_corpus", lambda *a: opened)
    asked = spark.createDataFrame([(1, "long-term plan was sound")], "quote_id int, quote string")
    spark.conf.set(store.SETTING, kept.folder)
    try:
        (hit,) = served.find_passages(spark, asked).collect()
    finally:
        spark.conf.unset(store.SETTING)
    assert seen == [kept.folder] and hit.hit_count == 2


@pytest.mark.parametrize("few", [200_000, 0])
def test_no_corpus_and_no_moved_texts(spark, kept, monkeypatch, few):
    """a store is filled and asked without a corpus being written; texts that repeat, with keys that repeat or are null, are stored once."""
    written = []
    real = store.materialise
    monkeypatch.setattr(store, "materialise", lambda df, what, *a, **b: written.append(what) or real(df, what, *a, **b))
    monkeypatch.setattr(verify, "materialise", lambda df, what, *a, **b: written.append(what) or real(df, what, *a, **b))
    monkeypatch.setattr(store, "FEW", few)
    rows = [*DOCS, DOCS[0], DOCS[2], (None, "Of no key."), (None, DOCS[0][1])]
    kept.add(papers(spark, DOCS[:2]))
    kept.add(papers(spark, rows))
    assert kept.added == 3 and kept.held().count() == 5 and written == ["store-fresh", "store-texts"] * 2 and "pages" not in kept.held().columns
    forms = kept.forms(papers(spark, rows), norm_sha256=F.sha2("norm", 256))
    want = {r.raw: r.norm for r in verify.prepare_corpus(papers(spark, [r for r in rows if r[0]])).select("raw", "norm").collect()} | {"Of no key.": "Of no key."}
    got = sorted(map(str, forms.select("paper_id", "norm_sha256").collect()))
    asked = spark.createDataFrame([(k, want[t]) for k, t in rows], "paper_id string, norm string")
    assert got == sorted(map(str, asked.select("paper_id", F.sha2("norm", 256).alias("norm_sha256")).collect()))
    moved = [x for x in forms._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x or "Sort " in x]
    assert moved and not any("norm#" in x or "raw#" in x for x in moved)
