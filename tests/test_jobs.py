"""Folders from end to end: index, status, the command line, the guarded corpus, JSON, the library's interface."""

import http.server
import json
import threading
import urllib.parse

import pytest

from quillspark import cli
from quillspark.functions.scalars import SENTINEL
from quillspark.plans import contract, job, served
from quillspark.sources import corpus, files, library
from quillspark.sources.tables import NoSharedFolder, checkpoint_dir, materialise, scratch

PAGE = "It rained in the spring of that year and the mill stood by the river for long. " * 8


def _tool():
    def pages(content):
        """Stands for the external tool: a file's text, or a failure."""
        if content.startswith(b"bad"):
            raise files.ExtractError("broken")
        return files.split_pages(content.decode())

    return pages


#: Made within a function, so that it goes to workers by value.
pages = _tool()


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "papers"
    (root / "sub").mkdir(parents=True)
    (root / "one.pdf").write_text(PAGE + "\f" + PAGE)
    (root / "sub" / "two.PDF").write_text("Another text about barley and rye. " * 20)
    return root


def test_index_and_status(spark, folder):
    done = job.index(spark, folder, extract=pages)
    assert done.code == job.OK and "2 paper(s), 2 held" in done.lines[-1], done.lines
    text = (folder / "one.txt").read_text()
    assert SENTINEL in text and text.endswith(PAGE) and "Paper ID: one" in text
    manifest = (folder / job.MANIFEST).read_bytes()
    assert [p["paper_id"] for p in json.loads(manifest)["papers"]] == ["one", "two"]
    again = job.index(spark, folder, extract=pages)
    assert again.code == job.OK and "manifest unchanged" in again.lines[-1] and "2 unchanged" in again.lines[-1]
    assert (folder / job.MANIFEST).read_bytes() == manifest
    assert job.status(spark, folder).code == job.OK
    # A changed text is refused and reported; --force replaces it.
    (folder / "one.txt").write_text("edited by hand")
    assert job.status(spark, folder).code == job.PROBLEMS
    refused = job.index(spark, folder, extract=pages)
    assert refused.code == job.PROBLEMS and any("REFUSED" in x for x in refused.lines) and (folder / "one.txt").read_text() == "edited by hand"
    assert not {p["paper_id"]: p["held"] for p in json.loads((folder / job.MANIFEST).read_text())["papers"]}["one"]
    assert job.index(spark, folder, force=True, extract=pages).code == job.OK and (folder / "one.txt").read_text() == text


def test_index_of_a_folder_with_faults(spark, folder):
    (folder / "bad.pdf").write_text("bad")
    (folder / "thin.pdf").write_text("x")
    (folder / "gaps.pdf").write_text(PAGE + PAGE + "\f \f" + PAGE)
    job_report = job.index(spark, folder, extract=pages)
    assert job_report.code == job.PROBLEMS and any("FAILED" in x and "broken" in x for x in job_report.lines) and any("NO_TEXT_LAYER" in x for x in job_report.lines) and any("page(s) 2 of 3" in x for x in job_report.lines)
    # What people wrote stays, also when the file is gone.
    entries = json.loads((folder / job.MANIFEST).read_text())
    entries["papers"][0]["title"] = "By hand"
    (folder / job.MANIFEST).write_text(json.dumps(entries))
    (folder / (entries["papers"][0]["paper_id"] + ".pdf")).unlink()
    gone = job.index(spark, folder, extract=pages)
    assert gone.code == job.PROBLEMS and any("MISSING_PDF" in x for x in gone.lines)
    assert json.loads((folder / job.MANIFEST).read_text())["papers"][0]["title"] == "By hand"
    # A file with a second name, or one that leads outside, is nobody's.
    (folder.parent / "away.pdf").write_text(PAGE)
    (folder / "hard.pdf").hardlink_to(folder.parent / "away.pdf")
    assert "hard.pdf" not in {r.path for r in files.extract_scanned(spark, str(folder), pages).collect()}


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(files, "extract_pages", pages)
    monkeypatch.setattr(job.index, "__defaults__", (*job.index.__defaults__[:-1], pages))
    assert cli.main([], spark) == 2 and cli.main(["index", str(tmp_path / "none")], spark) == 2 and cli.main(["status", str(folder)], spark) == 2
    assert cli.main(["index", str(folder)], spark) == 0 and cli.main(["status", str(folder)], spark) == 0
    (folder / "new.pdf").write_text(PAGE)
    assert cli.main(["status", str(folder)], spark) == 1
    (folder / job.MANIFEST).write_text("{")
    assert cli.main(["status", str(folder)], spark) == 2 and "line 1" in capsys.readouterr().err


def test_served_corpus(spark, folder):
    job.index(spark, folder, extract=pages)
    quotes = spark.createDataFrame([("a", "It rained in the spring of that year"), ("b", "about barley and rye"), ("c", "nobody says a thing like this")], "quote_id string, quote string")
    fresh = {r.quote_id: r for r in served.verify_quotes(spark, quotes, str(folder)).collect()}
    assert fresh["a"].outcome == fresh["b"].outcome == "VERBATIM_EXACT" and fresh["c"].outcome == "NOT_LOCATABLE"
    assert not {n.field for r in fresh.values() for n in r.not_available} & {"corpus_freshness", "document_freshness"}
    (folder / "one.pdf").write_text("changed since")
    late = {r.quote_id: {n.field: n.detail for n in r.not_available} for r in served.verify_quotes(spark, quotes, str(folder)).collect()}
    assert all(n["corpus_freshness"] == "paper_ids: one" for n in late.values()) and late["a"]["document_freshness"] == "paper_id: one" and "document_freshness" not in late["b"]
    hits = served.find_passages(spark, quotes, str(folder)).where("quote_id = 'b'").first()
    assert hits.hit_count == 1 and {n.field for n in hits.not_available} == {"corpus_freshness"}
    for root in (str(folder / "none"), "~nobodyhere/x"):
        assert {(r.outcome, r.not_available[0].field) for r in served.verify_quotes(spark, quotes, root).collect()} == {("CORPUS_UNAVAILABLE", "corpus")}
    assert {r.outcome for r in served.find_passages(spark, quotes, "/no/such").collect()} == {"CORPUS_UNAVAILABLE"}


def test_tools_and_json(spark, folder, tmp_path):
    assert [t.name for t in served.TOOLS] == ["verify_quotes", "find_passages"] and all(len(line) <= 79 for t in served.TOOLS for line in t.about.split("\n"))
    quotes = spark.createDataFrame([(1, "x")], "quote_id int, quote string")
    answer = served.verify_quotes(spark, quotes, "/no/such")
    assert json.loads(contract.as_json(answer).first().response)["char_interval"] is None
    contract.write_json(answer, str(tmp_path / "out"))
    line = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert line["quote_id"] == 1 and line["response"]["outcome"] == "CORPUS_UNAVAILABLE"
    with pytest.raises(Exception, match="exist"):
        contract.write_json(answer, str(tmp_path / "out"))


@pytest.fixture
def shelf(tmp_path):
    """A library's interface on this machine, and its own folder."""
    own = tmp_path / "library"
    (own / "storage" / "A1").mkdir(parents=True)
    (own / "storage" / "A1" / "f.pdf").write_text(PAGE)
    (tmp_path / "linked.pdf").write_text(PAGE)
    items = [{"key": f"I{i}", "data": {"itemType": "book", "title": f"T{i}", "tags": [{"tag": "go"}]}} for i in range(1, 4)]
    attachment = {"itemType": "attachment", "contentType": "application/pdf"}
    attachments = [
        {"key": "A1", "data": attachment | {"parentItem": "I1", "linkMode": "imported_file", "filename": "f.pdf"}},
        {"key": "A2", "data": attachment | {"parentItem": "I2", "linkMode": "linked_file", "path": str(tmp_path / "linked.pdf")}},
        {"key": "A3", "data": attachment | {"parentItem": "I3", "linkMode": "imported_file", "filename": "lost.pdf"}},
    ]
    notes = [{"key": f"N{i}", "data": {"itemType": "annotation", "parentItem": "A1", "annotationType": "highlight", "annotationText": f"words {i}", "annotationPageLabel": "3"}} for i in range(230)]
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            query = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
            asked.append(self.command)
            rows = {"attachment": attachments, "annotation": notes}.get(query.get("itemType"), items)
            body = json.dumps(rows[int(query.get("start", 0)) :][: int(query.get("limit", 100))]).encode()
            self.send_response(200)
            self.send_header("Last-Modified-Version", "7")
            if query.get("itemType") == "annotation":
                self.send_header("Total-Results", str(len(rows)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", own, items
    server.shutdown()
    assert set(asked) == {"GET"}


def test_library_interface(spark, shelf, tmp_path, capsys):
    base, own, items = shelf
    assert library.check(base) == "7" and cli.main(["library", "--base", base, "check"]) == 0
    out = tmp_path / "mirror"
    dry = library.sync(spark, "go", out, own, dry_run=True, base=base)
    assert dry == {"items": 3, "symlink": 1, "copy": 1, "unresolved": 1} and not out.exists()
    assert library.sync(spark, "go", out, own, base=base) == dry
    assert (out / "I1.pdf").is_symlink() and not (out / "I2.pdf").is_symlink() and (out / "I2.pdf").is_file()
    (out / "mine.pdf").write_text("own")
    (out / "I2.txt").write_text("side")
    del items[1]
    assert library.sync(spark, "go", out, own, base=base) == {"items": 2, "keep": 1, "remove": 1, "unresolved": 1}
    assert sorted(p.name for p in out.glob("*.*") if not p.name.startswith(".")) == ["I1.pdf", "mine.pdf"]
    with pytest.raises(ValueError, match="own folder"):
        library.sync(spark, "go", own / "storage" / "x", own, base=base)
    rows = json.loads(library.annotations_json(spark, "go", base))
    assert len(rows) == 230 and rows[0] | {"text": ""} == {"item_key": "I1", "title": "T1", "page": "3", "text": "", "comment": None}
    assert cli.main(["library", "--base", base, "annotations", "--tag", "go", "--out", str(tmp_path / "a.json")], spark) == 0 and len(json.loads((tmp_path / "a.json").read_text())) == 230
    assert cli.main(["library", "--base", "http://127.0.0.1:9", "check"]) == 2 and "does not answer" in capsys.readouterr().err


def test_tables_between_steps(spark):
    with scratch():
        table = materialise(spark.range(5), "test-scratch")
        assert table.count() == 5
        folder = table.inputFiles()[0]
    with pytest.raises(Exception, match="(?i)exist|FAILED_READ"):
        spark.read.parquet(folder).count()

    class Cluster:
        sparkContext = type("C", (), {"master": "spark://x:1", "getConf": lambda self: type("D", (), {"get": lambda self, *a: None})(), "_jsc": type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()})()

    with pytest.raises(NoSharedFolder):
        checkpoint_dir(Cluster())
    assert corpus.MANIFEST_VERSION == "1"
