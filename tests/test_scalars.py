"""Document format, ids, guards, line features and local blocks."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scalars as s

HEAD = f"Title: A  thing\nPaper ID: x1\nNote: n\nOther: no\n{s.SENTINEL}\n"


def one(spark, value, *exprs):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(*[e(F.col("t")).alias(f"c{i}") for i, e in enumerate(exprs)]).first()


@pytest.mark.parametrize(
    ("raw", "pages", "end"),
    [(HEAD + "\fone\ftwo", ["one", "two"], len(HEAD) + 1), ("one\ftwo\f", ["one", "two"], 0), ("one", ["one"], 0), ("", [""], 0), ("\f", [""], 0), (HEAD + "\fone\f", ["one", ""], len(HEAD) + 1)],
)
def test_documents(spark, raw, pages, end):
    got = one(spark, raw, s.pages, s.header_end, s.body)
    assert got.c0 == pages and got.c1 == end and got.c2 == raw[end:]


def test_header_fields(spark):
    assert one(spark, HEAD + "\fx", s.header_fields).c0 == {"Title": "A  thing", "Paper ID": "x1"}
    assert one(spark, "no header", s.header_fields).c0 == {}


@pytest.mark.parametrize(("name", "want"), [("a b(1).pdf", "a_b_1"), ("/x/y/Ünï.PDF", "n"), ("___.pdf", "paper"), ("a.b.pdf", "a.b"), ("plain", "plain"), ("x-1+2.pdf", "x-1+2")])
def test_ids(spark, name, want):
    assert one(spark, name, s.paper_id).c0 == want


@pytest.mark.parametrize(("value", "safe"), [("a.b-c_1", True), ("a+b", False), ("", False), ("a" * 129, False), ("a\n", False)])
def test_safe(spark, value, safe):
    assert one(spark, value, s.is_safe_id).c0 == safe


def test_blank_pages(spark):
    df = spark.createDataFrame([(["a", " ", "", "\x1c ", "b"],), ([],), ([""] * 14,)], "p array<string>")
    rows = df.select(s.blank_pages(F.col("p")).alias("b"), s.page_list(s.blank_pages(F.col("p"))).alias("l"), s.measure(F.col("p")).alias("m")).collect()
    assert rows[0].b == [2, 3, 4] and rows[0].l == "2, 3, 4" and rows[0].m.per_page == 1
    assert rows[1].b == [] and rows[1].m == (0, 0, 0)
    assert rows[2].l == "1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12 and 2 more"


def test_guards(spark):
    df = spark.createDataFrame([("x" * 5001, "x"), (" short ", " short "), ("long enough text", "long enough text")], "r string, n string")
    assert [r[0] for r in df.select(s.guard(F.col("r"), F.col("n"))).collect()] == ["TOO_LONG", "TOO_SHORT", None]


@pytest.mark.parametrize(("value", "t", "noted"), [(None, 0.65, True), ("x", 0.65, True), ("NaN", 0.65, True), ("-1", 0.65, True), ("0.6", 0.6, False), ("0.9", 0.9, True)])
def test_threshold(spark, value, t, noted):
    assert one(spark, value, s.threshold).c0 == (t, noted)


@pytest.mark.parametrize(
    ("line", "n"), [("[1] Smith, J., A title. Journal of X, 1999.", 4), ("12. Smith wrote", 1), ("in 1999 it was", 1), ("plain words only", 0), ("see doi for it", 1), ("in 2051 it was", 0), ("É. A. was", 1)]
)
def test_features(spark, line, n):
    assert one(spark, line, s.feature_count).c0 == n


@pytest.mark.parametrize(("line", "row"), [("a | b | c", True), ("0.1  0.2  0.3", True), ("12 34 a", True), ("a plain sentence", False), ("", False), ("short  cells  here", True), ("one long cell of over twenty-four  b  c", False)])
def test_table_rows(spark, line, row):
    assert one(spark, line, s.is_table_row).c0 == row


def test_local_block(spark):
    text = "body in 1999\n\n[1] Smith, J. A. Title. Journal of X, 1999.\nmore\n \nafter"
    block = lambda at: one(spark, text, lambda c: s.local_block(c, F.lit(at)), lambda c: s.block_label(s.local_block(c, F.lit(at))))
    got = block(text.index("Title"))
    assert got.c0.startswith("[1]") and got.c0.endswith("more") and got.c1 == "REFERENCE_LIKE_BLOCK_WARNING"
    assert block(3).c1 == "NO_REFERENCE_LIKE_BLOCK"
    assert spark.range(1).select(s.block_label(F.lit(None).cast("string"))).first()[0] == "LOCAL_BLOCK_NOT_ASSESSED"


def test_lookups(spark):
    df = spark.createDataFrame([(["ab", "cd ef", "cd"], "cd", [0, 2, 2, 5], 2)], "p array<string>, s string, m array<int>, v int")
    got = df.select(s.page_of(F.col("p"), F.col("s")), s.page_of(F.col("p"), F.lit("zz")), s.lower_bound(F.col("m"), F.col("v")), s.count_of(F.lit("aaaa"), F.lit("aa"))).first()
    assert tuple(got) == (2, None, 1, 2)
