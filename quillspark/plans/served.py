"""Answers over a folder: the corpus is opened behind a guard, and what has changed is said.

Whatever goes wrong in opening gives CORPUS_UNAVAILABLE for every question. Documents whose files are
not what the manifest says are served with a note on each answer that comes from them.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans import contract, job, store, verify
from quillspark.sources import corpus, files
from quillspark.sources.tables import materialise

#: The setting, and the variable behind it, that name the corpus folder.
SETTING, VARIABLE, DEFAULT = "spark.quillspark.corpus", "QUILLSPARK_CORPUS", "~/papers"


@dataclass
class Opened:
    """A corpus: its papers (paper_id, raw), the ids of stale ones, and how many faults there are."""

    papers: DataFrame
    stale: DataFrame
    n_stale: int


@dataclass
class NotOpened:
    reason: str
    detail: str


def open_corpus(spark: SparkSession, root: str | None = None) -> Opened | NotOpened:
    """The corpus at ``root``, or at the folder that is set; never an error."""
    folder: Path | None = None
    try:
        folder = Path(root or spark.conf.get(SETTING, os.environ.get(VARIABLE, DEFAULT))).expanduser().resolve()
        papers = materialise(corpus.read_manifest(spark, str(folder / job.MANIFEST)), "served-manifest")
        texts = files.scan_texts(spark, str(folder)).where(files.inside_udf(str(folder))("path"))
        texts = texts.select(files.relative(F.col("path"), str(folder)).alias("text_path"), "raw")
        held = papers.where("held").join(texts, "text_path", "left").select("paper_id", "raw")
        served = held.unionByName(papers.where("NOT held").select("paper_id", F.lit(None).cast("string").alias("raw")))
        faults = materialise(corpus.stale(papers, job.listing(spark, folder)), "served-stale")
        return Opened(materialise(served, "served-papers"), faults.select("paper_id").distinct(), faults.count())
    except Exception as e:  # a corpus that is missing or wrong is a boundary, and has its outcome
        what = "the corpus folder can't be told" if folder is None else "the corpus in this folder can't be read"
        return NotOpened(what, f"{folder or SETTING}: {e}")


def _noted(answers: DataFrame, opened: Opened) -> DataFrame:
    """Answers with the notes on what has changed since the corpus was indexed."""
    if not opened.n_stale:
        return answers
    ids = ", ".join(sorted(r.paper_id for r in opened.stale.limit(50).collect()))
    whole = F.struct(F.lit("corpus_freshness").alias("field"), F.lit(f"files and manifest disagree in {opened.n_stale} place(s); index again before relying on offsets").alias("reason"), F.lit(f"paper_ids: {ids}").alias("detail"))
    notes = F.concat("not_available", F.array(whole))
    if "paper_id" in answers.columns:
        stale = opened.stale.select("paper_id", F.lit(1).alias("__stale"))
        own = F.struct(F.lit("document_freshness").alias("field"), F.lit("this document is not what it was when it was indexed").alias("reason"), F.concat(F.lit("paper_id: "), F.col("paper_id").cast("string")).alias("detail"))
        located = F.col("outcome").isin(contract.OUTCOMES[:3]) & F.col("__stale").isNotNull()
        answers = answers.join(stale, "paper_id", "left")
        notes = F.concat(notes, F.array_compact(F.array(F.when(located, own))))
        answers = answers.withColumn("not_available", notes).drop("__stale")
        return contract.validate(answers)
    return contract.validate(answers.withColumn("not_available", notes))


def _prepared(spark: SparkSession, opened: Opened) -> DataFrame | None:
    """The corpus from the store that is set, so a second call over a folder prepares only what has changed."""
    folder = spark.conf.get(store.SETTING, None)
    return store.Store(spark, folder).prepare(opened.papers) if folder else None


def verify_quotes(spark: SparkSession, quotes: DataFrame, root: str | None = None, mode: str = "blocked") -> DataFrame:
    """Whether quotes stand in the documents of a folder; see ``plans.verify``."""
    opened = open_corpus(spark, root)
    if isinstance(opened, NotOpened):
        return contract.unavailable(quotes, opened.reason, opened.detail)
    return _noted(verify.verify_quotes(opened.papers, quotes, mode, _prepared(spark, opened)), opened)


def find_passages(spark: SparkSession, queries: DataFrame, root: str | None = None, max_hits: int | None = None) -> DataFrame:
    """Where phrases occur in the documents of a folder; see ``plans.verify``."""
    opened = open_corpus(spark, root)
    if isinstance(opened, NotOpened):
        return contract.unavailable(queries, opened.reason, opened.detail)
    return _noted(verify.find_passages(opened.papers, queries, max_hits, _prepared(spark, opened)), opened)


@dataclass(frozen=True)
class Tool:
    """A query as it is offered to callers."""

    name: str
    run: Callable[..., DataFrame]
    about: str


#: The two queries, always in this order.
TOOLS = (
    Tool("verify_quotes", verify_quotes, contract.wrapped("Tells for each quote whether it stands in a held document, where, and if not how close it gets. The answer is one of a closed set of outcomes and says nothing of what the document means by it. " + contract.NOTICE)),
    Tool("find_passages", find_passages, contract.wrapped("Lists the held documents in which a phrase stands, in the order of their ids, with the place of each hit. Nothing is scored: a document that says the same in other words is not found. " + contract.NOTICE)),
)
