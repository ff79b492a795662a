"""Ladder plans, records, manifests, ingest, files, the library source, SQL functions, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import anchor, register, scalars
from quillspark.operators import locate as loc
from quillspark.operators import records
from quillspark.plans import ingest, verify
from quillspark.sources import corpus, files, library
from quillspark.streaming import verify as stream

DOCS = [("a", "Its long-term plan was sound, they wrote, and no one said a word."), ("b", "Quite another text: a long plan was made of it ﬁnally."), ("c", ""), ("d", "its longterm plan was SOUND, they wrote")]


def frames(spark, quotes):
    docs = loc.prepare(spark.createDataFrame(DOCS, "paper_id string, raw string"), "paper_id", "raw")
    asked = spark.createDataFrame([(i, q, 0.65) for i, q in enumerate(quotes)], "quote_id int, quote string, t_locate double")
    return docs, loc.prepare(asked, "quote_id", "quote")


QUOTES = ["long-term plan was sound, they", "Long-Term plan was sound, they", "made of it finally", "plan", "its long term plan is sound, they write", "zebras graze quietly"]


def test_plans_agree_with_the_ladder(spark):
    docs, quotes = frames(spark, QUOTES)
    got = {(r.paper_id, r.quote_id): r for r in loc.locate(docs, quotes, mode="exact").collect()}
    for d, raw in DOCS:
        for i, q in enumerate(QUOTES):
            want = anchor.locate(raw, q)
            if raw and want.tier != anchor.NOT_LOCATABLE:
                r = got.pop((d, i))
                assert (r.tier, r.offset_norm, r.length_norm, r.diff) == (want.tier, want.offset, want.length, want.diff)
                assert r.score == pytest.approx(want.score)
    # Of what is not located, the best document of each quote is there.
    assert all(r.tier == anchor.NOT_LOCATABLE and r.score == pytest.approx(anchor.locate(dict(DOCS)[r.paper_id], QUOTES[r.quote_id]).score) for r in got.values())
    for i, q in enumerate(QUOTES):
        scores = [a.score for a in (anchor.locate(raw, q) for _, raw in DOCS if raw) if a.tier == anchor.NOT_LOCATABLE]
        assert not scores or max(r.score for r in got.values() if r.quote_id == i) == pytest.approx(max(scores))


def test_a_quote_asked_of_one_document(spark):
    docs, quotes = frames(spark, QUOTES[:5])
    asked = quotes.withColumn("paper_id", F.when(F.col("quote_id") < 4, "b"))
    for mode in ("exact", "blocked"):
        rows = loc.locate(docs, asked, mode=mode).collect()
        assert {r.paper_id for r in rows if r.quote_id < 4} == {"b"} and {r.quote_id for r in rows} >= {0, 1, 2, 3}
        assert any(r.paper_id == "a" and r.quote_id == 4 for r in rows)


def test_blocked_pairs_lose_no_identity(spark):
    docs, quotes = frames(spark, QUOTES)
    both = [loc.locate(docs, quotes, mode=m, tiers=(anchor.EXACT, anchor.RELAXED)).select("paper_id", "quote_id", "tier") for m in ("exact", "blocked")]
    assert sorted(both[0].collect()) == sorted(both[1].collect())
    with pytest.raises(ValueError):
        loc.locate(docs, quotes, mode="other")


def test_blocked_scores_find_changed_quotes(spark):
    """Recall of blocked pairs against all documents, for quotes with changed, lost and added words and letters."""
    import random

    rng = random.Random(8)
    vocab = ["".join(rng.choice("aeioubdgklmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    texts = [[rng.choice(vocab) for _ in range(120)] for _ in range(40)]
    quotes = ["results confirm earlier model predictions", "результаты подтверждают модель"]
    for _ in range(120):
        text = rng.choice(texts)
        a, n = rng.randrange(90), rng.randrange(4, 30)
        words = text[a : a + n]
        for _ in range(max(1, n // 5)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [words[k], rng.choice(vocab)], [words[k][:-1] + "x"]])
        quotes.append(" ".join(words))
    papers = [(str(i), " ".join(t)) for i, t in enumerate(texts)] + [("m", "the results confirm other model predictions, so they say"), ("r", "и результаты подтверждали модель снова")]
    docs = loc.prepare(spark.createDataFrame(papers, "paper_id string, raw string"), "paper_id", "raw")
    asked = loc.prepare(spark.createDataFrame([(i, q, 0.65) for i, q in enumerate(quotes)], "quote_id int, quote string, t_locate double"), "quote_id", "quote")
    best = [{r.quote_id: r.paper_id for r in loc.rank(loc.locate(docs, asked, mode=m, tiers=(anchor.LOCATED,))).where("place = 1").collect()} for m in ("exact", "blocked")]
    assert best[0][0] == best[1][0] == "m" and best[0][1] == best[1][1] == "r"
    found = sum(best[1].get(q) == d for q, d in best[0].items())
    assert found >= 0.98 * len(best[0]), (found, len(best[0]))


def test_no_cartesian_product(spark):
    docs, quotes = frames(spark, ["a quote of many words here", "one"])
    plan = loc.candidates(docs, quotes, "norm")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_rank(spark):
    rows = [("b", 1, anchor.EXACT, 1.0), ("a", 1, anchor.EXACT, 1.0), ("c", 1, anchor.LOCATED, 0.9), ("a", 2, anchor.LOCATED, 0.7), ("b", 2, anchor.LOCATED, 0.8)]
    v = spark.createDataFrame(rows, "paper_id string, quote_id int, tier string, score double")
    got = {r.quote_id: (r.paper_id, list(r.also_occurs_in)) for r in loc.best_with_others(loc.rank(v)).collect()}
    assert got == {1: ("a", ["b"]), 2: ("b", ["a"])}


def test_records(spark):
    pairs = spark.createDataFrame([(1, "s", DOCS[0][1], "Its longterm plan"), (2, "s", DOCS[0][1], "zebras graze under umbrellas")], "record_id int, source string, raw string, quote string")
    made = records.annotate(pairs)
    a, b = (json.loads(r.json) for r in records.as_json(made).orderBy("record_id").collect())
    text, place = a["target"]["selector"]
    assert text["prefix"] + text["exact"] + text["suffix"] in DOCS[0][1] and DOCS[0][1][place["start"] : place["end"]] == text["exact"]
    assert len(b["target"]["selector"]) == 1 and b["refs"]["located_text"] is None and "diff" in b["refs"]
    assert {r[0] for r in made.select(records.status(F.col("refs"))).collect()} == {"FRESH"}
    other = anchor.Versions(verifier="verify/0")
    assert {r[0] for r in made.select(records.status(F.col("refs"), other)).collect()} == {"STALE"}
    lost = made.withColumn("refs", F.col("refs").withField("quote_raw", F.lit(None).cast("string")).withField("matchform", F.lit("x")))
    with pytest.raises(Exception, match="quote_raw"):
        records.renew(lost, pairs.select("source", "raw").distinct()).collect()


def entry(**more):
    return {"paper_id": "p", "pdf_path": "p.pdf", "pdf_sha256": "0" * 64} | more


def manifest(tmp_path, papers, **more):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"manifest_version": "1", "extractor": "x", "papers": papers} | more))
    return str(path)


@pytest.mark.parametrize(
    "more",
    [{"paper_id": None}, {"paper_id": " "}, {"pdf_sha256": "0"}, {"year": "1999"}, {"year": True}, {"authors": "Smith"}, {"authors": [1]}, {"held": "yes"}, {"unknown": 1}, {"pdf_path": "../x"}, {"pdf_path": "/x"}, {"text_path": "a\nb"}, {"title": 5}],
)
def test_manifest_faults(spark, tmp_path, more):
    with pytest.raises(corpus.ManifestError, match=r"papers\[0\]"):
        corpus.read_manifest(spark, manifest(tmp_path, [entry(**more)]))


def test_manifest(spark, tmp_path):
    rows = corpus.read_manifest(spark, manifest(tmp_path, [entry(authors=[" A ", ""], held=True, title=" "), entry(paper_id="q", year=1999)])).collect()
    assert rows[0].authors == ["A"] and rows[0].held and rows[0].title is None and rows[1].year == 1999 and rows[1].held is False
    for papers, more in (([entry(), entry()], {}), ([], {"manifest_version": "9"}), ([], {"more": 1})):
        with pytest.raises(corpus.ManifestError):
            corpus.read_manifest(spark, manifest(tmp_path, papers, **more))
    (tmp_path / "bad.json").write_text("{\n oh")
    with pytest.raises(corpus.ManifestError, match="line 2"):
        corpus.read_manifest(spark, str(tmp_path / "bad.json"))


def test_manifest_round_trip(spark, tmp_path):
    papers = corpus.read_manifest(spark, manifest(tmp_path, [entry(title="Ünï", note="n"), entry(paper_id="q")]))
    paths = [tmp_path / n for n in ("again.json", "once_more.json", "none.json")]
    corpus.write_manifest(papers, paths[0], "x")
    again = corpus.read_manifest(spark, str(paths[0]))
    corpus.write_manifest(again, paths[1], "x")
    corpus.write_manifest(papers.limit(0), paths[2], "x")
    text = paths[0].read_text()
    assert sorted(map(str, again.collect())) == sorted(map(str, papers.collect())) and paths[1].read_text() == text and text.count('"note"') == 1
    assert all(p.read_text() == json.dumps(json.loads(p.read_text()), indent=2, ensure_ascii=False) + "\n" for p in paths)


def test_documents_keep_their_pages(spark):
    df = spark.createDataFrame([(["one", "", "three"], "A  thing")], "p array<string>, t string")
    doc = corpus.document_text(F.col("p"), {"Title": F.col("t"), "DOI": F.lit(None).cast("string")})
    row = df.select(doc.alias("d"), corpus.pages_intact(doc, F.col("p")).alias("ok"), scalars.header_fields(doc).alias("h")).first()
    assert row.ok and row.h == {"Title": "A thing"}


def test_stale(spark):
    papers = spark.createDataFrame([("a", "a.pdf", "a.txt", "1", "2", True), ("b", "b.pdf", None, "1", None, True), ("c", "c.pdf", "c.txt", "1", None, False), ("d", "d.pdf", "d.txt", "1", "2", True)], "paper_id string, pdf_path string, text_path string, pdf_sha256 string, text_sha256 string, held boolean")
    now = spark.createDataFrame([("a.pdf", "9"), ("a.txt", None), ("b.pdf", "1"), ("c.pdf", "1"), ("c.txt", "x"), ("d.txt", "2")], "path string, sha256 string")
    assert sorted(tuple(r) for r in corpus.stale(papers, now).collect()) == [("a", "PDF_CHANGED"), ("a", "TEXT_CHANGED"), ("b", "TEXT_NOT_RECORDED"), ("c", "TEXT_UNEXPECTED"), ("d", "PDF_MISSING")]


def one_after_another(candidates, taken):
    """Ids as files take them, one after another."""
    used, out = set(taken), []
    for c in candidates:
        k, name = 2, c
        while name in used:
            name, k = f"{c}-{k}", k + 1
        used.add(name)
        out.append(name)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_ids(spark, seed):
    rng = random.Random(seed)
    names = ["x", "x", "x", "x-2", "x-3", "x-2-2", "x-2-2-2", "x-02", "x-1", "x-12", "y", "y-2", "-2", "z-2-3"]
    candidates = [rng.choice(names[: 6 if seed == 0 else None]) for _ in range(120)]
    taken = ["x-4", "x-2-3", "q", "y"] if seed else []
    rows = spark.createDataFrame([(f"{i:04}", c) for i, c in enumerate(candidates)], "path string, candidate string").repartition(3)
    got = corpus.unique_ids(rows, spark.createDataFrame([(t,) for t in taken], "paper_id string")).orderBy("path").collect()
    assert [r.paper_id for r in got] == one_after_another(candidates, taken) and [r.candidate for r in got] == candidates


def test_numbers_of_numbers(spark):
    rows = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x-2")], "path string, candidate string")
    none = spark.createDataFrame([], "paper_id string")
    assert [r.paper_id for r in corpus.unique_ids(rows, none).orderBy("path").collect()] == ["x", "x-2", "x-2-2"]
    assert corpus.unique_ids(rows.limit(0), none).collect() == []


def test_index(spark):
    prior = spark.createDataFrame([("old", "Kept title", ["A"], 1999, None, None, "old.pdf", "old.txt", "h1", "t", 1, True, None), ("gone", None, [], None, None, None, "gone.pdf", None, "h9", None, 1, False, None)], corpus.PAPERS)
    page = ["x" * 300]
    rows = [("moved/old.pdf", "h1", page, None, None), ("new.pdf", "h2", page, None, None), ("New.pdf", "h3", ["x" * 500, " "], None, None), ("scan.pdf", "h4", ["x"], None, None), ("bad.pdf", "h5", None, "broken", None), ("new.PDF", "h6", page, None, None), ("there.pdf", "h7", page, None, "other")]
    now = spark.createDataFrame(rows, "path string, sha256 string, pages array<string>, error string, text_now string")
    plan = {r.pdf_path: r for r in ingest.index_plan(now, prior).collect()}
    assert plan["moved/old.pdf"].paper_id == "old" and plan["moved/old.pdf"].title == "Kept title" and plan["moved/old.pdf"].status == "WRITTEN"
    assert {p: r.status for p, r in plan.items() if p != "moved/old.pdf"} == {"new.pdf": "COLLISION", "new.PDF": "WRITTEN", "New.pdf": "WRITTEN", "scan.pdf": "NO_TEXT_LAYER", "bad.pdf": "FAILED", "there.pdf": "REFUSED", "gone.pdf": "MISSING_PDF"}
    assert plan["New.pdf"].note == "no text on page(s) 2 of 2" and plan["bad.pdf"].note.endswith("broken") and not plan["there.pdf"].held
    again = now.withColumn("text_now", F.lit(None).cast("string")).where("path = 'New.pdf'")
    doc = ingest.index_plan(again, prior.limit(0)).first().document
    assert ingest.index_plan(again.withColumn("text_now", F.lit(doc)), prior.limit(0)).first().status == "UNCHANGED"
    assert ingest.index_plan(now.where("path = 'there.pdf'"), prior.limit(0), force=True).first().status == "WRITTEN"


def test_files(spark, tmp_path):
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "sub").mkdir()
    for p in (".hidden/a.pdf", "sub/b.PDF", "c.pdf", "d.txt"):
        (tmp_path / p).write_bytes(b"x\x0cy")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    assert sorted(r.relative for r in files.scan_pdfs(spark, str(tmp_path)).collect()) == ["c.pdf", "sub/b.PDF"]
    assert sorted((r.path.split("/")[-1], r.raw) for r in files.scan_texts(spark, str(tmp_path)).collect()) == [("bad.txt", None), ("d.txt", "x\fy")]
    assert files.safe_write(tmp_path / "n", "a") and not files.safe_write(tmp_path / "n", "a")
    with pytest.raises(files.WriteRefused):
        files.safe_write(tmp_path / "n", "b")
    assert files.safe_write(tmp_path / "n", "b", overwrite=True)
    (tmp_path / "l").symlink_to(tmp_path / "n")
    with pytest.raises(files.WriteRefused):
        files.safe_write(tmp_path / "l", "c", overwrite=True)
    assert files.inside(tmp_path, tmp_path / "n") and not files.inside(tmp_path / "sub", tmp_path / "n") and not files.inside(tmp_path, tmp_path / "none")
    with pytest.raises(files.ExtractError):
        files.extract_pages(b"", ("-layout",))
    assert files.split_pages("a\fb\f") == ["a", "b"]
    raw = spark.read.format("binaryFile").load(str(tmp_path / "c.pdf"))
    assert files.extract_texts(raw, lambda c: files.split_pages(c.decode())).first().pages == ["x", "y"]


def test_library(spark, tmp_path):
    rows = [{"key": "I1", "data": {"itemType": "journalArticle", "title": "T", "tags": [{"tag": "go"}]}}, {"key": "A1", "data": {"itemType": "attachment", "parentItem": "I1", "contentType": "application/pdf", "linkMode": "imported_file", "filename": "f.pdf"}}, {"key": "N1", "data": {"itemType": "annotation", "parentItem": "A1", "annotationType": "highlight", "annotationText": "words", "annotationPageLabel": "3", "annotationComment": ""}}]
    (tmp_path / "0.json").write_text(json.dumps(rows[:2]))
    (tmp_path / "1.json").write_text(json.dumps(rows[2:]))
    spark.dataSource.register(library.LibraryPages)
    table = library.parse(spark.read.format("library_pages").load(str(tmp_path)))
    items, atts = library.tagged(table, "go"), library.pdf_attachments(table)
    assert library.tagged(table, "no").isEmpty()
    got = library.highlights(items, atts, table.where("item_type = 'annotation'")).collect()
    assert [tuple(r) for r in got] == [("I1", "T", "3", "words", None)]
    there = spark.createDataFrame([("/z/storage/A1/f.pdf",)], "path string")
    r = library.resolve(atts, there, "/z").first()
    assert (r.kind, r.source_path) == ("stored", "/z/storage/A1/f.pdf")
    pages = [[{"n": i} for i in range(100)], [{"n": 100}]]
    assert len(list(library.walk_pages(lambda start, limit: pages[start // limit]))) == 101


def test_sql_functions(spark):
    register.register(spark)
    r = spark.sql("SELECT normalise_text('a  ﬁ') n, match_form('Long-Term') m, locate_quote('see it here, all of it', 'it here, all').tier t").first()
    assert tuple(r) == ("a fi", "longterm", "ANCHOR_EXACT")
    assert [tuple(x) for x in spark.sql("SELECT m.* FROM (SELECT 'see [1] and [2]' AS t), LATERAL marker_spans(t) m").collect()] == [(4, 7, "[1]"), (12, 15, "[2]")]


def test_streams(spark, tmp_path):
    papers = spark.createDataFrame([("a", "It rained in the spring of that year.")], "paper_id string, raw string")
    quotes = spark.createDataFrame([(1, "rained in the spring"), (2, "never to be found at all")], "quote_id int, quote string")
    quotes.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(quotes.schema).parquet(str(tmp_path / "in"))
    prepared = verify.prepare_corpus(papers)
    stream.verify_stream(live, papers, prepared, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = verify.verify_quotes(papers, quotes)
    assert sorted(tuple(r) for r in got.select("quote_id", "outcome").collect()) == sorted(tuple(r) for r in want.select("quote_id", "outcome").collect())
