"""Indexing a folder and reporting on it: the plans of ``ingest`` carried out on files.

PDFs are read and texts written by executors, on a file system that all machines share; the manifest
is written by the driver, row by row. Nothing is ever deleted.
"""

from __future__ import annotations

import filecmp
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import scalars
from quillspark.plans import ingest
from quillspark.sources import corpus, files
from quillspark.sources.tables import materialise

MANIFEST = "manifest.json"
OK, PROBLEMS, CANNOT_RUN = 0, 1, 2


@dataclass
class Report:
    """What a job has to say, and its exit code."""

    lines: list[str] = field(default_factory=list)
    code: int = OK


def _papers(spark: SparkSession, root: Path) -> DataFrame | None:
    """The manifest's papers, or None where there is no manifest; a wrong one is an error."""
    path = root / MANIFEST
    return corpus.read_manifest(spark, str(path)) if path.is_file() else None


def listing(spark: SparkSession, root: Path) -> DataFrame:
    """(path, sha256) of the PDFs and texts below ``root``, by their path within it; others' files are left out."""
    rows = files.scan(spark, str(root), "*.{pdf,PDF,Pdf,txt}").where(files.inside_udf(str(root))("path"))
    return rows.select(F.col("relative").alias("path"), "sha256")


def _written(plan: DataFrame, root: Path, force: bool) -> DataFrame:
    """(paper_id, refused) of the documents that are to be written, each in one safe write."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for paper_id, path, document in batch.itertuples(index=False, name=None):
                try:
                    files.safe_write(root / path, document, overwrite=force)
                    rows.append((paper_id, None))
                except (files.WriteRefused, OSError) as e:
                    rows.append((paper_id, str(e)))
            yield pd.DataFrame(rows, columns=["paper_id", "refused"])

    return plan.where("document IS NOT NULL").select("paper_id", "text_path", "document").mapInPandas(run, "paper_id string, refused string")


def write_manifest(papers: DataFrame, path: Path, extractor: str) -> bool:
    """Write the manifest, by tasks and at once; False where it is there already."""
    fresh = path.parent / f".{path.name}.{uuid.uuid4().hex}"
    try:
        corpus.write_manifest(papers, fresh, extractor)
        if path.is_symlink():
            raise files.WriteRefused(f"{path.name} is a link")
        if path.exists() and filecmp.cmp(path, fresh, shallow=False):
            return False
        os.replace(fresh, path)
        return True
    finally:
        fresh.unlink(missing_ok=True)


def index(spark: SparkSession, folder: str | os.PathLike, floor: int = scalars.CHARS_PER_PAGE, force: bool = False, extract: Callable[[bytes], list[str]] = files.extract_pages) -> Report:
    """Extract every PDF of a folder and write its manifest.

    A text file that differs from a fresh extraction is left as it is, unless ``force``. Entries
    keep what people wrote in them, also where their PDF is gone.
    """
    root = Path(folder).expanduser()
    if not root.is_dir():
        return Report([f"no folder: {root}"], CANNOT_RUN)
    root = root.resolve()
    prior = _papers(spark, root)
    if prior is None:
        prior = spark.createDataFrame([], corpus.PAPERS)
    pdfs = materialise(files.extract_scanned(spark, str(root), extract), "index-pages")
    texts = files.scan_texts(spark, str(root)).select(files.relative(F.col("path"), str(root)).alias("text_path"), F.coalesce("raw", F.lit("")).alias("text_now"))
    found = pdfs.withColumn("text_path", ingest.text_path(F.col("path"))).join(texts, "text_path", "left").drop("text_path")
    plan = materialise(ingest.index_plan(found, prior, floor, force), "index-plan")
    written = materialise(_written(plan, root, force), "index-written")
    refused = F.col("refused").isNotNull()
    done = plan.join(written, "paper_id", "left").withColumn("status", F.when(refused, "REFUSED").otherwise(F.col("status")))
    done = done.withColumn("held", F.coalesce("held", F.lit(False)) & ~refused).withColumn("text_sha256", F.when(~refused, F.col("text_sha256"))).withColumn("note", F.coalesce("refused", "note"))
    done = materialise(done, "index-done")
    changed = write_manifest(done.select(*corpus.FIELDS), root / MANIFEST, files.extractor_version())
    counts = {r.status: r.n for r in ingest.counters(done).collect()}
    partial = done.where(F.col("status").isin("WRITTEN", "UNCHANGED") & F.col("note").isNotNull()).count()
    problems = sum(counts.get(s, 0) for s in ingest.PROBLEMS) + partial
    n, held = sum(counts.values()), done.where("held").count()
    lines = [f"{root}: {found.count()} PDF(s), extractor {files.extractor_version()}"]
    # What needs a person is listed; a listing, not a collected corpus.
    for r in done.where(F.col("status").isin(*ingest.PROBLEMS, "NO_TEXT_LAYER") | F.col("note").isNotNull()).orderBy("paper_id").toLocalIterator():
        lines.append(f"  {r.status:<14} {r.paper_id}: {r.note or r.pdf_path}")
    lines.append(f"  manifest {'updated' if changed else 'unchanged'}; {n} paper(s), {held} held; " + ", ".join(f"{counts.get(s, 0)} {s.lower()}" for s in ingest.STATUSES))
    return Report(lines, PROBLEMS if problems else OK)


def status(spark: SparkSession, folder: str | os.PathLike) -> Report:
    """What is held, what has changed since, and what has no entry."""
    root = Path(folder).expanduser()
    if not root.is_dir():
        return Report([f"no folder: {root}"], CANNOT_RUN)
    root = root.resolve()
    papers = _papers(spark, root)
    if papers is None:
        return Report([f"no {MANIFEST} in {root}"], CANNOT_RUN)
    papers = materialise(papers, "status-papers")
    report = materialise(ingest.status_report(papers, listing(spark, root)), "status-report")
    sums = papers.agg(F.count(F.lit(1)).alias("n"), F.count_if("held").alias("held")).first()
    lines = [f"{root}: {sums.n} paper(s), {sums.held} held"]
    lines += [f"  {r.kind:<10} {r['name']}" + (f": {r.detail}" if r.detail else "") for r in report.orderBy("kind", "name", "detail").toLocalIterator()]
    return Report(lines if len(lines) > 1 else [*lines, "  all is held and as it was"], ingest.exit_code(report))
