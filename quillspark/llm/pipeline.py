"""Documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and its result is
written as Parquet before the next reads it; what a stage wrote in between is removed then, and its
input too once its own result is there.

An empty table passes every stage and gives no pieces. Columns beside those of ``documents`` are
passed on up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import fmindex, language, packing, pseudonyms, shingles
from quillspark.llm.common import checkpoint_dir, drop_table, read_table
from quillspark.llm.queries import pseudonym_key, vocabulary
from quillspark.sources.tables import scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a null lang becomes the one found. Null texts, texts without
    letters and texts in none of the languages learnt go; repeated rows are kept or go alike."""
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word shingle similarity of 0.8 or more, that of
    smallest id. Repeated rows are copies, null and empty texts one text; rows without an id stay."""
    return shingles.keep_one_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of benchmark items. Null and empty texts stay."""
    return fmindex.cut_spans(docs, read_table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal values. Null and empty texts stay."""
    return pseudonyms.protect(docs, pseudonym_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences. A null or empty text has its end token alone."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("pseudonyms", pseudonymise),
    ("packing", pack),
]

#: Models, 64-bit hashes, keyed permutations and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{name}")
        docs, done = spark.read.schema(out.schema).parquet(f"{folder}/{name}"), before
        before = docs
        if done is not None:
            drop_table(done)
    return docs
