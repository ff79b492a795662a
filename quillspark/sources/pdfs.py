"""PDF files below a folder as a data source: one read a file, filters on the path before any file is read.

    spark.dataSource.register(pdf_source())
    spark.read.format("pdf_pages").option("root", folder).load().where("path = 'a/b.pdf'")

Rows: path (within the folder), sha256 of the file, pages, and the error where there are none. Hidden
files and folders are left out, as are files that are links, have a second name or lie elsewhere. A
folder is listed once, by names and sizes, and files are dealt out in the order of their paths, each
partition with about ``BYTES`` of them. The folder is one that all machines see under the same path.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from quillspark.sources import files

NAME = "pdf_pages"
SCHEMA = "path string, sha256 string, pages array<string>, error string"
BYTES = 64 << 20
#: What a file costs beside its bytes.
OPEN_BYTES = 1 << 20
#: Spark asks sources of this kind for filters only where this is set.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

_TESTS: dict[type, Callable[[Filter, str], bool]] = {
    EqualTo: lambda f, path: path == f.value,
    In: lambda f, path: path in f.value,
    StringStartsWith: lambda f, path: path.startswith(f.value),
    StringEndsWith: lambda f, path: path.endswith(f.value),
    StringContains: lambda f, path: f.value in path,
}


@dataclass
class Part(InputPartition):
    paths: tuple[str, ...]


class PdfReader(DataSourceReader):
    def __init__(self, root: str, extract: Callable[[bytes], list[str]], size: int):
        self.root, self.extract, self.size = root, extract, size
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keep those on the path; Spark applies the others itself."""
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("path",):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        return all(_TESTS[type(f)](f, path) for f in self.filters)

    def partitions(self) -> list[Part]:
        found = []
        for folder, below, names in os.walk(self.root):
            below[:] = sorted(d for d in below if not d.startswith("."))
            for name in names:
                whole = Path(folder, name)
                path = whole.relative_to(self.root).as_posix()
                if name.lower().endswith(".pdf") and not name.startswith(".") and self._wanted(path) and files.inside(self.root, whole):
                    found.append((path, whole.stat().st_size))
        parts: list[Part] = []
        now, size = [], 0
        for path, n in sorted(found):
            if now and size + n + OPEN_BYTES > self.size:
                parts.append(Part(tuple(now)))
                now, size = [], 0
            now.append(path)
            size += n + OPEN_BYTES
        return [*parts, Part(tuple(now))]

    def read(self, part: Part) -> Iterator[tuple]:
        for path in part.paths:
            try:
                content = Path(self.root, path).read_bytes()
            except OSError as e:  # it may be gone since the folder was listed
                yield path, None, None, str(e)
                continue
            sha = hashlib.sha256(content).hexdigest()
            try:
                yield path, sha, self.extract(content), None
            except files.ExtractError as e:
                yield path, sha, None, str(e)


def pdf_source(extract: Callable[[bytes], list[str]] = files.extract_pages) -> type[DataSource]:
    """The source with this function from a file's bytes to its pages. Options: root, and bytes of a partition."""

    class PdfPages(DataSource):
        @classmethod
        def name(cls) -> str:
            return NAME

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return PdfReader(os.path.realpath(self.options["root"]), extract, int(self.options.get("bytes", BYTES)))

    return PdfPages


def scan(spark: SparkSession, root: str | os.PathLike, extract: Callable[[bytes], list[str]] = files.extract_pages) -> DataFrame:
    """(path, sha256, pages, error) of the PDFs below ``root``; filters on the path leave files unread."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(pdf_source(extract))
    return spark.read.format(NAME).option("root", str(root)).load()
