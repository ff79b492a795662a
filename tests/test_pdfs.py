"""PDF files as a data source: one read a file, filters before reading, partitions by bytes."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from quillspark.sources import files, pdfs


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "corpus" / "sub").mkdir(parents=True)
    (tmp_path / "corpus" / ".hidden").mkdir()
    for name, text in (("a.pdf", "one\ftwo\f"), ("b.PDF", "bad"), ("sub/c.pdf", "three"), ("sub/d.pdf", ""), (".hidden/e.pdf", "no"), (".f.pdf", "no"), ("g.txt", "no")):
        (tmp_path / "corpus" / name).write_text(text)
    (tmp_path / "outside.pdf").write_text("out")
    os.symlink(tmp_path / "outside.pdf", tmp_path / "corpus" / "link.pdf")
    os.link(tmp_path / "outside.pdf", tmp_path / "corpus" / "second.pdf")
    return tmp_path / "corpus"


def logged(log):
    """An extractor that notes each call."""

    def extract(content):
        with open(log, "a") as f:
            f.write(f"{content.decode()!r}\n")
        if content == b"bad":
            raise files.ExtractError("no pages in it")
        return files.split_pages(content.decode())

    return extract


def test_rows_and_one_read_a_file(spark, folder, tmp_path):
    log = tmp_path / "log"
    got = sorted(map(tuple, pdfs.scan(spark, folder, logged(str(log))).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == [("a.pdf", sha(b"one\ftwo\f"), ["one", "two"], None), ("b.PDF", sha(b"bad"), None, "no pages in it"), ("sub/c.pdf", sha(b"three"), ["three"], None), ("sub/d.pdf", sha(b""), [], None)]
    assert len(log.read_text().splitlines()) == 4


@pytest.mark.parametrize(("where", "reads"), [("path = 'sub/c.pdf'", 1), ("path LIKE 'sub/%'", 2), ("path IN ('a.pdf', 'zz')", 1), ("path LIKE '%.pdf' AND error IS NULL", 3), ("contains(path, 'PDF')", 1), ("path = 'link.pdf'", 0), ("length(path) > 100", 4)])
def test_filters_leave_files_unread(spark, folder, tmp_path, where, reads):
    log = tmp_path / "log"
    log.touch()
    all_ = [tuple(r) for r in pdfs.scan(spark, folder, logged(str(tmp_path / "other"))).collect()]
    got = pdfs.scan(spark, folder, logged(str(log))).where(where)
    plain = spark.createDataFrame(all_, pdfs.SCHEMA).where(where)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert len(log.read_text().splitlines()) == reads


def test_partitions_by_bytes(spark, folder):
    big = pdfs.PdfReader(str(folder), files.extract_pages, 1 << 30).partitions()
    small = pdfs.PdfReader(str(folder), files.extract_pages, 1).partitions()
    assert len(big) == 1 and len(small) == 4 and [p for x in small for p in x.paths] == list(big[0].paths) == ["a.pdf", "b.PDF", "sub/c.pdf", "sub/d.pdf"]


def test_one_scan_in_the_plan(spark, folder):
    plan = files.extract_scanned(spark, str(folder), files.split_pages).where(F.col("path") == "a.pdf")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Join" not in plan and "binaryFile" not in plan


def test_empty_and_gone(spark, tmp_path):
    assert pdfs.scan(spark, tmp_path, files.split_pages).collect() == []
    reader = pdfs.PdfReader(str(tmp_path), files.extract_pages, 1)
    ((path, sha, pages, error),) = reader.read(pdfs.Part(("gone.pdf",)))
    assert (path, sha, pages) == ("gone.pdf", None, None) and "gone.pdf" in error
