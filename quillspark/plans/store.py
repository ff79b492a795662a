"""Prepared documents by content: what has been prepared once is not prepared again.

A store is a folder of Parquet tables, one for each set of versions of what makes the forms (the
normaliser, the match form, regions and markers, and a fingerprint of their code). Rows are keyed by
the SHA-256 of the raw text. ``prepare`` hashes the texts it is given, leaves out those that the table of
its own versions has, prepares each different text of the rest once and appends it. Tables of
other versions are never read; ``forget_others`` removes them.

What is new is found by hashes and keys. Only texts that are prepared may move, once, and where few are new none does. Pages are
cut from the text at hand, so they are not stored. ``add`` fills a store without making a corpus, and ``forms`` takes from it what a
query asks for without a text.

An append that is cut short leaves whole files or none, and the next call prepares what is lacking.
One writer at a time; readers may be many.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import anchor, markers, scalars
from quillspark.functions.normalise import digest
from quillspark.operators import region
from quillspark.plans import verify
from quillspark.sources.tables import drop_table, materialise

#: The setting that names a store for corpora that are served.
SETTING = "spark.quillspark.store"
#: New texts that are picked where they lie, without a shuffle.
FEW = 200_000
STORED = ["text_sha256", "norm", "match", "header_end", "region", "marker_style"]


def versions() -> str:
    """A name for all that prepared forms depend on."""
    named = anchor.Versions().as_dict() | {"region": region.REGION_VERSION, "markers": markers.MARKERS_VERSION}
    code = [digest(m) for m in (region, markers, scalars)]
    return hashlib.sha256(repr((sorted(named.items()), code)).encode()).hexdigest()[:16]


class Store:
    """Prepared documents in ``folder``, which all machines share."""

    def __init__(self, spark: SparkSession, folder: str, version: str | None = None):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version or versions()
        #: Texts that the last call of ``prepare`` had to prepare.
        self.added = 0

    @property
    def _path(self) -> str:
        return f"{self.folder}/prepared-{self.version}"

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def held(self) -> DataFrame | None:
        """(text_sha256, norm, match, header_end, region, marker_style) of these versions; None where there are none."""
        fs, where = self._fs(self._path)
        return self.spark.read.parquet(self._path).select(*STORED) if fs.exists(where) and len(fs.globStatus(self._fs(f"{self._path}/*.parquet")[1])) else None

    def add(self, papers: DataFrame, key: str = "paper_id") -> None:
        """Prepare the texts of ``papers`` (key, raw) that are new, each once."""
        hashed = papers.select(key, "raw", F.sha2("raw", 256).alias("text_sha256"))
        rows = hashed.where("text_sha256 IS NOT NULL").groupBy(F.col("text_sha256").alias("sha"), F.col(key).alias("first")).agg(F.count(F.lit(1)).alias("times"))
        fresh = rows.groupBy("sha").agg(F.min(F.struct("first", "times")).alias("row")).select("sha", "row.first", "row.times")
        held = self.held()
        if held is not None:
            fresh = fresh.join(held.select(F.col("text_sha256").alias("sha")), "sha", "left_anti")
        fresh = materialise(fresh, "store-fresh")
        self.added, most = fresh.agg(F.count(F.lit(1)), F.max("times")).first()
        if not self.added:
            return
        # One row for each text. Texts that move are not sorted.
        picked = F.broadcast(fresh) if self.added <= FEW else fresh.hint("shuffle_hash")
        texts = hashed.join(picked, (F.col("text_sha256") == F.col("sha")) & F.col(key).eqNullSafe(F.col("first")), "left_semi")
        if most > 1:
            texts = texts.dropDuplicates(["text_sha256"])
        # Written until they are prepared: each kind of text reads its own rows, and none is picked or searched for a heading again.
        texts = materialise(texts.select(F.col("text_sha256").alias("paper_id"), "raw", region.has_hint(F.col("raw")).alias("hinted")), "store-texts", packed=True)
        made = verify.made_corpus(texts).withColumnRenamed("paper_id", "text_sha256")
        made.select(*STORED).write.mode("append").option("compression", "zstd").parquet(self._path)
        drop_table(texts)

    def forms(self, papers: DataFrame, key: str = "paper_id", **wanted: Column) -> DataFrame:
        """(key, text_sha256, *wanted) of ``papers`` (key, raw), null where a text is not held: ``wanted`` is computed from the stored columns where these lie, and no text moves."""
        hashed = papers.select(key, F.sha2("raw", 256).alias("text_sha256"))
        held = self.held()
        if held is None:
            held = verify.made_corpus(papers.limit(0).select(F.lit("").alias("paper_id"), "raw")).withColumnRenamed("paper_id", "text_sha256")
        return hashed.join(held.select("text_sha256", *[c.alias(name) for name, c in wanted.items()]), "text_sha256", "left").select(key, "text_sha256", *wanted)

    def prepare(self, papers: DataFrame, key: str = "paper_id") -> DataFrame:
        """The corpus of ``papers`` (key, raw), as ``verify.prepare_corpus`` gives it; only texts that are new are prepared.
        A null text is not held and has null forms."""
        self.add(papers, key)
        held = self.held()
        if held is None:
            return verify.prepare_corpus(papers, key)
        corpus = papers.select(key, "raw", F.sha2("raw", 256).alias("text_sha256")).join(held, "text_sha256", "left")
        corpus = corpus.withColumn("pages", F.when(F.col("text_sha256").isNotNull(), scalars.pages(F.col("raw"))))
        return materialise(corpus.select(key, "raw", "norm", "match", "header_end", "pages", "region", "marker_style"), "corpus", packed=True)

    def forget_others(self) -> int:
        """Remove the tables of other versions; how many there were."""
        fs, _ = self._fs(self.folder)
        gone = [s.getPath() for s in fs.globStatus(self._fs(f"{self.folder}/prepared-*")[1]) or [] if s.getPath().getName() != f"prepared-{self.version}"]
        for path in gone:
            fs.delete(path, True)
        return len(gone)
