"""A read-only reference library as a source: items, attachments and annotations as tables.

Pages of a library's JSON listing come from its local interface (``LibraryApi``) or from files
(``LibraryPages``), one partition a page; the only request there is is a GET. Joins give the plan of
a folder mirror and the highlights; ``sync`` carries the plan out.
"""

from __future__ import annotations

import json
import os
import shutil
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.sources import files, sink

PAGE = 100
#: Address of the library's interface on its own machine, and seconds to wait for it.
BASE, TIMEOUT = "http://127.0.0.1:23119/api/users/0", 15
#: What an earlier mirror made, in the mirror's folder.
STATE = ".quillspark-library.json"
ITEM = "struct<key: string, data: struct<key: string, itemType: string, parentItem: string, title: string, tags: array<struct<tag: string>>, linkMode: string, filename: string, path: string, contentType: string, annotationType: string, annotationPageLabel: string, annotationText: string, annotationComment: string>>"


class _Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class LibraryReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_Page]:
        return [_Page(str(p)) for p in sorted(Path(self.folder).glob("*.json"))]

    def read(self, partition: _Page) -> Iterator[tuple[str]]:
        for row in json.loads(Path(partition.path).read_text("utf-8")):
            yield (json.dumps(row),)


class LibraryPages(DataSource):
    """``spark.read.format("library_pages").load(folder)``: the items of a listing, a JSON text a row."""

    @classmethod
    def name(cls) -> str:
        return "library_pages"

    def schema(self) -> str:
        return "item string"

    def reader(self, schema) -> LibraryReader:
        return LibraryReader(self.options["path"])


class LibraryUnavailable(RuntimeError):
    """The library does not answer, or not as it should."""


def get(base: str, path: str, params: dict[str, object]) -> tuple[object, dict[str, str]]:
    """(parsed body, headers) of one GET."""
    request = urllib.request.Request(f"{base}{path}?{urllib.parse.urlencode(params)}", method="GET", headers={"Zotero-API-Version": "3"})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            return json.loads(answer.read().decode("utf-8") or "[]"), {k.lower(): v for k, v in answer.headers.items()}
    except urllib.error.HTTPError as e:
        hint = ": allow other applications to communicate with it" if e.code == 403 else ""
        raise LibraryUnavailable(f"the library answers {e.code} for {path}{hint}") from e
    except (urllib.error.URLError, OSError, ValueError) as e:
        raise LibraryUnavailable(f"the library at {base} does not answer: {getattr(e, 'reason', e)}") from e


def check(base: str = BASE) -> str | None:
    """The library's version, or an error where it does not answer."""
    return get(base, "/items", {"limit": 1})[1].get("last-modified-version")


class _Slice(InputPartition):
    def __init__(self, start: int, last: bool):
        self.start, self.last = start, last


class ApiReader(DataSourceReader):
    def __init__(self, base: str, params: dict[str, str]):
        self.base, self.params = base, params

    def partitions(self) -> list[_Slice]:
        # Where the library says how many there are, pages are read side by side; else one task walks.
        total = get(self.base, "/items", self.params | {"limit": "1"})[1].get("total-results")
        starts = range(0, max(1, int(total or 0)), PAGE)
        return [_Slice(a, a == starts[-1]) for a in starts]

    def read(self, partition: _Slice) -> Iterator[tuple[str]]:
        fetch = lambda start, limit: get(self.base, "/items", self.params | {"start": str(partition.start + start), "limit": str(limit)})[0]
        for row in walk_pages(fetch) if partition.last else fetch(0, PAGE):
            yield (json.dumps(row),)


class LibraryApi(DataSource):
    """``spark.read.format("library_api").option("base", ..).option("params", "tag=..")``: items, a JSON text a row."""

    @classmethod
    def name(cls) -> str:
        return "library_api"

    def schema(self) -> str:
        return "item string"

    def reader(self, schema) -> ApiReader:
        return ApiReader(self.options.get("base", BASE), dict(urllib.parse.parse_qsl(self.options.get("params", ""))))


def listed(spark: SparkSession, base: str, **params: str) -> DataFrame:
    """The library's items that match, parsed."""
    spark.dataSource.register(LibraryApi)
    return parse(spark.read.format("library_api").option("base", base).option("params", urllib.parse.urlencode(params)).load())


def walk_pages(fetch, page: int = PAGE) -> Iterator[dict]:
    """All items of a paged listing: ``fetch(start, limit)`` until a page is short."""
    start = 0
    while True:
        rows = fetch(start, page)
        yield from rows
        if len(rows) < page:
            return
        start += page


def parse(items: DataFrame) -> DataFrame:
    """JSON texts as columns key, item_type, parent and those of attachments and annotations."""
    row = items.select(F.from_json("item", ITEM).alias("x")).select("x.key", "x.data")
    return row.select(
        F.coalesce("key", "data.key").alias("key"), F.col("data.itemType").alias("item_type"), F.col("data.parentItem").alias("parent"), F.col("data.title").alias("title"),
        F.transform("data.tags", lambda t: t["tag"]).alias("tags"), F.col("data.linkMode").alias("link_mode"), F.col("data.filename").alias("filename"), F.col("data.path").alias("path"),
        F.col("data.contentType").alias("content_type"), F.col("data.annotationType").alias("annotation_type"), F.col("data.annotationPageLabel").alias("page"), F.col("data.annotationText").alias("highlight"),
        F.col("data.annotationComment").alias("comment"),
    )


def tagged(rows: DataFrame, tag: str) -> DataFrame:
    return rows.where(F.array_contains("tags", tag) & ~F.col("item_type").isin("attachment", "annotation", "note"))


def pdf_attachments(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("item_type") == "attachment") & (F.col("content_type") == "application/pdf"))


def resolve(attachments: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Attachments with kind (``stored``, ``linked`` or null) and source_path, where that file is there."""
    stored = F.col("link_mode").isin("imported_file", "imported_url") & F.col("filename").isNotNull()
    linked = (F.col("link_mode") == "linked_file") & F.col("path").isNotNull()
    place = F.when(stored, F.concat(F.lit(f"{root}/storage/"), "key", F.lit("/"), "filename")).when(linked, F.col("path"))
    rows = attachments.withColumn("source_path", place).join(files.select(F.col("path").alias("source_path"), F.lit(1).alias("there")), "source_path", "left")
    kind = F.when(F.col("there").isNotNull(), F.when(stored, "stored").when(linked, "linked"))
    return rows.withColumn("kind", kind).withColumn("source_path", F.when(kind.isNotNull(), F.col("source_path"))).drop("there")


def sync_plan(items: DataFrame, attachments: DataFrame, present: DataFrame, state: DataFrame, copy_all: bool = False) -> DataFrame:
    """(stem, item_key, attachment_key, action, source_path) of a folder mirror.

    ``attachments``: resolved ones with parent; ``present``: stems in the folder; ``state``: stems
    that an earlier run made. action: symlink, copy, keep, unresolved or remove. Only what an
    earlier run made is removed.
    """
    own = items.select(F.col("key").alias("item_key")).join(attachments.withColumnRenamed("key", "attachment_key"), F.col("parent") == F.col("item_key"))
    many = F.count(F.lit(1)).over(Window.partitionBy("item_key")) > 1
    own = own.withColumn("stem", F.when(many, F.concat_ws("-", "item_key", "attachment_key")).otherwise(F.col("item_key")))
    wanted = own.join(present.select("stem", F.lit(1).alias("there")), "stem", "left")
    as_copy = F.lit(copy_all) | (F.col("kind") == "linked")
    action = F.when(F.col("kind").isNull(), "unresolved").when(F.col("there").isNotNull(), "keep").when(as_copy, "copy").otherwise("symlink")
    plan = wanted.select("stem", "item_key", "attachment_key", action.alias("action"), "source_path")
    none = F.lit(None).cast("string")
    kept = plan.where("action <> 'unresolved'").select("stem")
    gone = state.select("stem").join(kept, "stem", "left_anti").join(present.select("stem"), "stem", "left_semi")
    return plan.unionByName(gone.select("stem", none.alias("item_key"), none.alias("attachment_key"), F.lit("remove").alias("action"), none.alias("source_path")))


def highlights(items: DataFrame, attachments: DataFrame, annotations: DataFrame) -> DataFrame:
    """(item_key, title, page, highlight, comment) of highlights and underlines, as quotes to be checked."""
    marked = annotations.where(F.col("annotation_type").isin("highlight", "underline") & F.col("highlight").isNotNull() & (F.col("highlight") != ""))
    joined = items.select(F.col("key").alias("item_key"), "title").join(attachments.select(F.col("key").alias("att"), F.col("parent").alias("item_key")), "item_key")
    return joined.join(marked.select(F.col("parent").alias("att"), "page", "highlight", F.nullif("comment", F.lit("")).alias("comment")), "att").drop("att")


def grouped_by_parent(annotations: DataFrame) -> DataFrame:
    """(parent, annotations): annotations of each attachment, in order of key."""
    return annotations.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("key", "page", "highlight", "comment"))).alias("annotations"))


def outside(out: str | os.PathLike, data_dir: str | os.PathLike) -> Path:
    """The folder ``out``; an error where it lies in the library's own folder, which the library rules."""
    real, own = Path(out).resolve(), Path(data_dir).resolve()
    if real.is_relative_to(own):
        raise ValueError(f"{real} lies in the library's own folder {own}")
    return real


def _state(folder: Path) -> dict[str, dict]:
    try:
        return dict(json.loads((folder / STATE).read_text("utf-8"))["entries"])
    except (OSError, ValueError, KeyError, TypeError):
        return {}


def sync_counts(plan: DataFrame) -> dict[str, int]:
    """How many files of a plan there are for each action."""
    return {r.action: r.n for r in plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}


def apply_sync(plan: DataFrame, folder: Path) -> None:
    """Carry a plan out, file by file, and note what was made."""
    made = {}
    for r in plan.toLocalIterator():
        target = folder / f"{r.stem}.pdf"
        if r.action == "remove":
            target.unlink(missing_ok=True)
            (folder / f"{r.stem}.txt").unlink(missing_ok=True)
        elif r.action == "copy":
            shutil.copy2(r.source_path, target)
        elif r.action == "symlink":
            target.symlink_to(r.source_path)
        if r.action in ("copy", "symlink", "keep"):
            made[r.stem] = {"item_key": r.item_key, "attachment_key": r.attachment_key, "source": r.source_path}
    (folder / STATE).write_text(json.dumps({"entries": made}, indent=1) + "\n", "utf-8")


def sync(spark: SparkSession, tag: str, out: str | os.PathLike, data_dir: str | os.PathLike, copy_all: bool = False, dry_run: bool = False, base: str = BASE) -> dict[str, int]:
    """Make ``out`` mirror the PDFs of the items of a tag; how many files had which action."""
    folder = outside(out, data_dir)
    items = tagged(listed(spark, base, tag=tag), tag)
    attachments = pdf_attachments(listed(spark, base, itemType="attachment")).join(items.select(F.col("key").alias("parent")), "parent", "left_semi")
    storage = Path(data_dir).resolve()
    places = [r.p for r in attachments.select(F.when(F.col("link_mode") == "linked_file", F.col("path")).otherwise(F.concat(F.lit(f"{storage}/storage/"), "key", F.lit("/"), "filename")).alias("p")).where("p IS NOT NULL").distinct().toLocalIterator()]
    there = spark.createDataFrame([(p,) for p in places if Path(p).is_file()], "path string")
    present = spark.createDataFrame([(p.stem,) for p in folder.glob("*.pdf")] if folder.is_dir() else [], "stem string")
    state = spark.createDataFrame([(stem,) for stem in _state(folder)], "stem string")
    plan = sync_plan(items, resolve(attachments, there, str(storage)), present, state, copy_all)
    counts = {"items": items.count(), **sync_counts(plan)}
    if not dry_run:
        folder.mkdir(parents=True, exist_ok=True)
        apply_sync(plan, folder)
    return counts


def annotation_rows(spark: SparkSession, tag: str, base: str = BASE) -> DataFrame:
    """The highlights of a tag's papers in order, each as JSON; nulls are kept."""
    items = tagged(listed(spark, base, tag=tag), tag)
    found = highlights(items, pdf_attachments(listed(spark, base, itemType="attachment")), listed(spark, base, itemType="annotation"))
    rows = found.select("item_key", "title", "page", F.col("highlight").alias("text"), "comment").orderBy("item_key", "page", "text")
    return rows.select(F.concat(F.lit("\n "), F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("text"))


def annotations_json(spark: SparkSession, tag: str, base: str = BASE) -> str:
    """The highlights as one JSON list, to be shown; ``write_annotations`` writes any number of them."""
    return "[" + ",".join(line for (line,) in annotation_rows(spark, tag, base).toLocalIterator()) + "\n]"


def write_annotations(spark: SparkSession, tag: str, path: str | os.PathLike, base: str = BASE) -> None:
    """The list of ``annotations_json`` as a file, written by tasks."""
    if os.path.islink(path):
        raise files.WriteRefused(f"{os.path.basename(path)} is a link")
    sink.write_list(annotation_rows(spark, tag, base), path, "[", ",", "\n]\n")
