"""Indexing a folder of documents, and the status of an index, as plans over tables.

``index_plan`` decides for all files at once what becomes of each: no file is touched by it. The
rows that say so are written afterwards, one safe write a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import scalars
from quillspark.sources import corpus

STATUSES = ["FAILED", "NO_TEXT_LAYER", "COLLISION", "REFUSED", "WRITTEN", "UNCHANGED", "MISSING_PDF"]
#: Statuses that need a person.
PROBLEMS = ["FAILED", "COLLISION", "REFUSED", "MISSING_PDF"]
CARRIED = ["title", "authors", "year", "venue", "doi"]


def text_path(pdf: Column) -> Column:
    return F.concat(F.regexp_replace(pdf, r"\.[^./]*\z", ""), F.lit(".txt"))


def match_prior(files: DataFrame, prior: DataFrame) -> DataFrame:
    """``files`` (path, sha256) with the earlier entry of their path, or else of their content."""
    keep = ["paper_id", *CARRIED]
    by_path = prior.groupBy(F.col("pdf_path").alias("path")).agg(F.min_by(F.struct(*keep), "paper_id").alias("p1"))
    by_sha = prior.groupBy(F.col("pdf_sha256").alias("sha256")).agg(F.min_by(F.struct(*keep), "paper_id").alias("p2"))
    rows = files.join(by_path, "path", "left").join(by_sha, "sha256", "left").withColumn("prior", F.coalesce("p1", "p2")).drop("p1", "p2")
    # Two files of one entry: the first in order of path keeps its id.
    nth = Window.partitionBy(F.coalesce("prior.paper_id", "path")).orderBy("path")
    return rows.withColumn("keeps_id", F.when(F.col("prior").isNotNull() & (F.row_number().over(nth) == 1), 1).otherwise(0))


def index_plan(files: DataFrame, prior: DataFrame, floor: int = scalars.CHARS_PER_PAGE, force: bool = False) -> DataFrame:
    """One row per paper of the new manifest, with status and note.

    ``files``: path, sha256, pages (null where extraction failed), error, text_now (the text file's
    content that is there, or null). ``prior``: entries of the manifest as it is.
    """
    rows = match_prior(files, prior)
    kept = rows.where("keeps_id = 1").withColumn("paper_id", F.col("prior.paper_id"))
    fresh = rows.where("keeps_id = 0").withColumn("candidate", scalars.paper_id(F.col("path")))
    fresh = corpus.unique_ids(fresh, prior.select("paper_id")).drop("candidate")
    rows = kept.unionByName(fresh.select(kept.columns)).withColumn("text_path", text_path(F.col("path"))).withColumn("size", scalars.measure(F.col("pages")))
    thin = F.col("size.per_page") < floor
    usable = F.col("pages").isNotNull() & ~thin
    # The first usable file of a text path has it.
    order = Window.partitionBy("text_path").orderBy(F.when(usable, 0).otherwise(1), "path")
    rows = rows.withColumn("claim", F.row_number().over(order))
    document = corpus.document_text(
        F.col("pages"),
        {"Title": F.col("prior.title"), "Authors": F.array_join("prior.authors", "; "), "Date": F.col("prior.year"), "Venue": F.col("prior.venue"), "DOI": F.col("prior.doi"), "Paper ID": F.col("paper_id"), "Source PDF": F.element_at(F.split("path", "/"), -1), "Source SHA256": F.col("sha256"), "Pages": F.size("pages")},
    )
    rows = rows.withColumn("document", F.when(usable & (F.col("claim") == 1), document))
    status = (
        F.when(F.col("pages").isNull(), "FAILED")
        .when(thin, "NO_TEXT_LAYER")
        .when(F.col("claim") > 1, "COLLISION")
        .when(F.col("text_now").eqNullSafe(F.col("document")), "UNCHANGED")
        .when(F.col("text_now").isNotNull() & ~F.lit(force), "REFUSED")
        .otherwise("WRITTEN")
    )
    blank = scalars.blank_pages(F.col("pages"))
    n = F.size("pages").cast("string")
    note = (
        F.when(status == "FAILED", F.concat(F.lit("extraction failed: "), F.coalesce("error", F.lit("no pages"))))
        .when(status == "NO_TEXT_LAYER", F.concat(F.col("size.per_page").cast("string"), F.lit(" characters a page over "), n, F.lit(f" page(s), the floor is {floor}")))
        .when(status == "COLLISION", "another file has this text file")
        .when(status == "REFUSED", "the text file that is there differs from a fresh extraction")
        .when(F.size(blank) > 0, F.concat(F.lit("no text on page(s) "), scalars.page_list(blank), F.lit(" of "), n))
    )
    held = status.isin("WRITTEN", "UNCHANGED")
    found = rows.select(
        "paper_id",
        *[(F.coalesce("prior.authors", F.array().cast("array<string>")) if c == "authors" else F.col(f"prior.{c}")).alias(c) for c in CARRIED],
        F.col("path").alias("pdf_path"),
        F.when(held | (status == "REFUSED"), F.col("text_path")).alias("text_path"),
        F.col("sha256").alias("pdf_sha256"),
        F.when(held, F.sha2("document", 256)).alias("text_sha256"),
        F.when(F.col("pages").isNotNull(), F.size("pages")).alias("pages"),
        held.alias("held"),
        note.alias("note"),
        status.alias("status"),
        F.when(status == "WRITTEN", F.col("document")).alias("document"),
    )
    gone = prior.join(files.select(F.col("path").alias("pdf_path")), "pdf_path", "left_anti")
    missing = gone.select(*corpus.FIELDS, F.lit("MISSING_PDF").alias("status"), F.lit(None).cast("string").alias("document"))
    # An entry that another path has taken over by its content is not missing.
    taken = found.select("paper_id")
    return found.unionByName(missing.join(taken, "paper_id", "left_anti").select(found.columns))


def counters(plan: DataFrame) -> DataFrame:
    """(status, n) of an index plan."""
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def status_report(papers: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, name, detail): unheld papers, notes of held ones, stale ones, and PDFs without an entry."""
    none = F.lit(None).cast("string")
    unheld = papers.where(~F.col("held")).select(F.lit("UNHELD").alias("kind"), F.col("paper_id").alias("name"), F.col("note").alias("detail"))
    caveat = papers.where(F.col("held") & F.col("note").isNotNull()).select(F.lit("CAVEAT").alias("kind"), F.col("paper_id").alias("name"), F.col("note").alias("detail"))
    stale = corpus.stale(papers, files).select(F.lit("STALE").alias("kind"), F.col("paper_id").alias("name"), F.col("reason").alias("detail"))
    pdfs = files.where(F.lower("path").endswith(".pdf"))
    new = pdfs.join(papers.select(F.col("pdf_path").alias("path")), "path", "left_anti").select(F.lit("UNINDEXED").alias("kind"), F.col("path").alias("name"), none.alias("detail"))
    return unheld.unionByName(caveat).unionByName(stale).unionByName(new)


def exit_code(report: DataFrame) -> int:
    """1 where something is stale or not indexed, else 0."""
    return int(not report.where(F.col("kind").isin("STALE", "UNINDEXED")).isEmpty())
