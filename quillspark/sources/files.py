"""Files of a corpus folder: listing, containment, safe writes, PDF text."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Flags that lose the reading order.
LAYOUT_FLAGS = ("-layout", "-raw", "-fixed", "-tsv", "-htmlmeta", "-bbox", "-bbox-layout")
_BANNER = re.compile(r"pdftotext\s+version\s+(\S+)")


class WriteRefused(RuntimeError):
    """A file is there already and is not what would be written."""


class ExtractError(RuntimeError):
    """A PDF gave no pages."""


def relative(path: Column, root: str) -> Column:
    """A file's path within ``root``."""
    return F.split_part(path, F.lit(root.rstrip("/") + "/"), F.lit(-1))


def binary(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, relative, content): files below ``root`` by their names, hidden parts left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return rows.select("path", relative(F.col("path"), root).alias("relative"), "content").where(~F.col("relative").rlike(r"(^|/)\."))


def scan(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, relative, sha256) of files below ``root``."""
    return binary(spark, root, glob).select("path", "relative", F.sha2("content", 256).alias("sha256"))


def scan_pdfs(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative, sha256): the PDF files below ``root``, hidden parts left out."""
    return scan(spark, root, "*.[pP][dD][fF]")


def inside_udf(root: str):
    """Paths to whether their files lie below ``root``; see ``inside``."""

    @F.pandas_udf("boolean")
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: inside(root, local_path(p)))

    return run


def extract_scanned(spark: SparkSession, root: str, extract=None) -> DataFrame:
    """(path, sha256, pages, error) of the PDFs below ``root`` that lie there, by their path within it; each is read once."""
    from quillspark.sources import pdfs

    return pdfs.scan(spark, root, extract or extract_pages)


def scan_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw): whole text files, form feeds kept; raw is null where a file is no UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    return files.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("raw"))


def extractor_version(command: str = "pdftotext") -> str:
    if not shutil.which(command):
        return f"{command} unknown"
    said = subprocess.run([command, "-v"], capture_output=True, text=True, check=False)
    found = _BANNER.search(said.stderr + said.stdout)
    return f"{command} {found.group(1) if found else 'unknown'}"


def split_pages(text: str) -> list[str]:
    """Pages between form feeds, without the empty tail the last form feed leaves."""
    pages = text.split("\f")
    return pages[:-1] if pages[-1] == "" else pages


def extract_pages(content: bytes, flags: tuple[str, ...] = (), command: str = "pdftotext") -> list[str]:
    """The pages of a PDF by the external tool, in reading order."""
    wrong = [f for f in flags if f in LAYOUT_FLAGS]
    if wrong:
        raise ExtractError(f"flags that lose the reading order: {wrong}")
    if not shutil.which(command):
        raise ExtractError(f"{command} is not installed")
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(content)
        f.flush()
        said = subprocess.run([command, "-q", "-enc", "UTF-8", "-eol", "unix", *flags, f.name, "-"], capture_output=True, check=False)
    if said.returncode:
        raise ExtractError(said.stderr.decode("utf-8", "replace").strip() or f"exit status {said.returncode}")
    return split_pages(said.stdout.decode("utf-8"))


def extract_texts(pdfs: DataFrame, extract=extract_pages) -> DataFrame:
    """(path, pages, error) of binaryFile rows (path, content); a PDF that fails has null pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows.append((path, extract(content), None))
                except ExtractError as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "pages", "error"])

    return pdfs.select("path", "content").mapInPandas(run, "path string, pages array<string>, error string")


def local_path(path: str) -> str:
    """A path as Spark names it on the local file system, without its scheme."""
    return unquote(path[5:]).replace("//", "/") if path.startswith("file:") else path


def inside(root: str | os.PathLike, path: str | os.PathLike) -> bool:
    """Whether a file lies below ``root`` once links are followed, and has no second name."""
    try:
        real = Path(path).resolve(strict=True)
        return real.is_relative_to(Path(root).resolve(strict=True)) and real.stat().st_nlink <= 1
    except (OSError, RuntimeError):
        return False


def safe_write(path: str | os.PathLike, content: str, overwrite: bool = False) -> bool:
    """Write a text as a whole or not at all; False where it is there already.

    A link is never followed. Another content is replaced only with ``overwrite``.
    """
    path = Path(path)
    if path.is_symlink():
        raise WriteRefused(f"{path.name} is a link")
    if path.exists():
        if path.read_bytes() == content.encode():
            return False
        if not overwrite:
            raise WriteRefused(f"{path.name} is there and differs")
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(content)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise
    return True
