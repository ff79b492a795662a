"""The two queries end to end: every outcome, headers, limits, restrictions, the contract."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.scalars import SENTINEL
from quillspark.plans import contract, verify

HEAD = f"Title: The harvest of the northern valleys\n{SENTINEL}\n"
PAPERS = [
    ("a", HEAD + "\fThe valley’s long-term harvest was good [12]. It rained in\nthe spring of that year.\fA second page on barley and rye."),
    ("b", "It rained in the spring of that year. The well-known mill stood by the river for long."),
    ("c", "   "),
    ("d", None),
]
QUOTES = [
    (1, "It rained in the spring of that year", None),
    (2, "the WELLKNOWN mill stood by the river", None),
    (3, "The wellknown mill stands by a river for long", None),
    (4, "Nobody here mentions quantum chromodynamics lattices", None),
    (5, "short", None),
    (6, "x" * 5001, None),
    (7, "It rained in the spring of that year", "zzz"),
    (8, "It rained in the spring of that year", "c"),
    (9, "The harvest of the northern valleys", None),
    (10, "It rained in the spring of that year", "b"),
    (11, "valley's long-term harvest was good [12].", None),
    (12, None, None),
]


@pytest.fixture(scope="module")
def papers(spark):
    return spark.createDataFrame(PAPERS, "paper_id string, raw string")


@pytest.fixture(scope="module")
def answers(spark, papers):
    rows = verify.verify_quotes(papers, spark.createDataFrame(QUOTES, "quote_id int, quote string, paper_id string"), mode="exact")
    return {r.quote_id: r for r in rows.collect()}


def test_outcomes(answers):
    want = ["VERBATIM_EXACT", "VERBATIM_RELAXED_EXTRACTOR_DAMAGE", "PASSAGE_RELOCATED_QUOTE_DIFFERS", "NOT_LOCATABLE", "NOT_LOCATABLE", "NOT_LOCATABLE", "SOURCE_UNKNOWN", "SOURCE_NOT_HELD", None, "VERBATIM_EXACT", "VERBATIM_EXACT", "NOT_LOCATABLE"]
    for (i, _, _), outcome in zip(QUOTES, want):
        if outcome:
            assert answers[i].outcome == outcome, i


def test_a_location(answers):
    r = answers[1]
    assert r.paper_id == "a" and list(r.also_occurs_in) == ["b"] and r.page == 1
    assert r.document_text == "It rained in\nthe spring of that year" and r.your_text is None
    assert answers[10].also_occurs_in is None and answers[10].paper_id == "b"


def test_a_relocation(answers):
    r = answers[3]
    assert r.char_diff.startswith("char diff") and r.your_text and 0.65 <= r.score < 1


def test_no_location(answers):
    assert answers[4].char_interval is None and answers[4].score is not None
    assert len(answers[6].your_text) == 5000


def test_a_hit_in_a_header_is_no_hit(answers):
    r = answers[9]
    assert r.outcome == "NOT_LOCATABLE" or r.paper_id != "a"
    assert any(x.field == "header_location" for x in r.not_available)


def test_markers(answers):
    r = answers[11].citation_markers
    assert r.bracketed_in_located_characters == 1 and r.sentence.document_text.endswith("[12].")
    assert answers[11].reference_region.status == "REGION_UNKNOWN"


def test_an_empty_corpus(spark, papers):
    none = papers.limit(0)
    q = spark.createDataFrame([(1, "It rained in the spring of that year")], "quote_id int, quote string")
    assert verify.verify_quotes(none, q).first().outcome == "SOURCE_NOT_HELD"
    assert verify.find_passages(none, q).first().outcome == "SOURCE_UNKNOWN"


def test_passages(spark, papers):
    rows = [(1, "in the spring of that", None), (2, "in the spring of that", ["b", "nope"]), (3, "in the spring of that", ["nope"]), (4, "in the spring of that", []), (5, "never to be found here", None), (6, "in the spring of that", ["b", "b"])]
    q = spark.createDataFrame(rows, "quote_id int, quote string, paper_ids array<string>")
    got = {r.quote_id: r for r in verify.find_passages(papers, q).collect()}
    assert [h.paper_id for h in got[1].hits] == ["a", "b"] and got[1].searched_document_count == 2
    assert [h.paper_id for h in got[2].hits] == ["b"] and got[2].not_available[0].detail == "nope"
    assert got[3].outcome == "SOURCE_UNKNOWN" and got[4].hit_count == 2
    assert got[5].outcome == "OK" and got[5].hit_count == 0
    assert got[6].hit_count == 2
    one = verify.find_passages(papers, q.where("quote_id = 1"), max_hits=1).first()
    assert one.hit_count == 1 and one.not_available[0].field == "hits"


def test_contract_of_columns():
    good = T.StructType([T.StructField(n, T.StringType()) for n in ("outcome", "interpretation_notice", "not_available", "char_interval")] + [T.StructField("provenance", T.StructType([T.StructField(k, T.StringType()) for k in contract.PROVENANCE]))])
    assert contract.schema_faults(good) == []
    for extra in (T.StructField("ok", T.BooleanType()), T.StructField("quote", T.StringType()), T.StructField("attributed_to", T.StringType()), T.StructField("h", T.ArrayType(T.StructType([T.StructField("x", T.BooleanType())])))):
        assert len(contract.schema_faults(T.StructType([*good.fields, extra]))) == 1
    assert contract.schema_faults(T.StructType(good.fields[1:]))


def test_contract_of_rows(spark, papers):
    q = spark.createDataFrame([(1, "It rained in the spring of that year")], "quote_id int, quote string")
    r = verify.verify_quotes(papers, q)
    assert contract.faults(r).select(F.flatten(F.collect_list("faults"))).first()[0] == []
    with pytest.raises(Exception, match="breaks the contract"):
        contract.validate(r.withColumn("reason", F.lit("it proves that"))).select("outcome").collect()
