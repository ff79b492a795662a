"""The manifest of a corpus and the documents it names.

The manifest is validated as a relation of errors, each with the place and the reason; a corpus
with an error is not read at all.
"""

from __future__ import annotations

import json
import os
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import scalars
from quillspark.operators import intervals
from quillspark.sources import sink
from quillspark.sources.tables import materialise

MANIFEST_VERSION = "1"

# The fields of a manifest entry.
PAPERS = T.StructType(
    [
        T.StructField("paper_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("year", T.IntegerType()),
        T.StructField("venue", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("pdf_path", T.StringType()),
        T.StructField("text_path", T.StringType()),
        T.StructField("pdf_sha256", T.StringType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("pages", T.IntegerType()),
        T.StructField("held", T.BooleanType()),
        T.StructField("note", T.StringType()),
    ]
)
FIELDS = PAPERS.names
TOP_FIELDS = ["manifest_version", "extractor", "papers"]


class ManifestError(ValueError):
    """A manifest that can't be used; the message names each place."""


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(place, entry): the entries of a manifest file as JSON texts, nothing yet believed."""
    text = spark.read.text(path, wholetext=True)
    top = text.select(F.try_parse_json("value").alias("v"))
    return top.select(
        F.expr("schema_of_variant(v)").alias("kind"),
        F.expr("map_keys(try_cast(v AS MAP<STRING, VARIANT>))").alias("keys"),
        F.expr("try_variant_get(v, '$.manifest_version', 'string')").alias("version"),
        F.expr("try_cast(try_variant_get(v, '$.papers', 'variant') AS ARRAY<VARIANT>)").alias("papers"),
    )


def _bad(test: Column, where: Column, message: str) -> Column:
    return F.when(test, F.struct(where.alias("place"), F.lit(message).alias("message")))


def entry_errors(papers: DataFrame) -> DataFrame:
    """(place, message) of wrong entries; ``papers``: place (from 0) and entry (a JSON text)."""
    at = papers.select("place", F.from_json("entry", "map<string,string>").alias("m"), F.expr("try_parse_json(entry)").alias("v"))
    kind = lambda f: F.expr(f"schema_of_variant(try_variant_get(v, '$.{f}', 'variant'))")
    value = lambda f: F.element_at("m", f)
    where = lambda f: F.concat(F.lit("papers["), F.col("place").cast("string"), F.lit(f"].{f}"))
    tests = []
    known = F.array(*map(F.lit, FIELDS))
    unknown = F.array_sort(F.array_except(F.map_keys("m"), known))
    tests.append(F.when(F.size(unknown) > 0, F.struct(where("").alias("place"), F.concat(F.lit("unknown field "), F.array_join(unknown, ", ")).alias("message"))))
    for f in ("paper_id", "pdf_path", "pdf_sha256"):
        tests.append(_bad(value(f).isNull() | (scalars.strip(value(f)) == ""), where(f), "is required"))
    for f in ("paper_id", "title", "venue", "doi", "pdf_path", "text_path", "pdf_sha256", "text_sha256", "note"):
        tests.append(_bad(value(f).isNotNull() & (kind(f) != "STRING"), where(f), "is no string"))
    for f in ("year", "pages"):
        tests.append(_bad(value(f).isNotNull() & ~kind(f).rlike("^(BIGINT|INT)"), where(f), "is no whole number"))
    tests.append(_bad(value("authors").isNotNull() & ~kind("authors").rlike("^ARRAY<(STRING|VOID)>$"), where("authors"), "is no list of strings"))
    tests.append(_bad(value("held").isNotNull() & (kind("held") != "BOOLEAN"), where("held"), "is neither true nor false"))
    for f in ("pdf_sha256", "text_sha256"):
        tests.append(_bad(value(f).isNotNull() & (value(f) != "") & ~scalars.is_sha256(scalars.strip(value(f))), where(f), "is no SHA-256 in lower-case hex"))
    for f in ("pdf_path", "text_path"):
        tests.append(_bad(value(f).rlike(r"[\x00-\x1f\x7f]"), where(f), "holds a control character"))
        tests.append(_bad(value(f).rlike(r"^(/|[A-Za-z]:)"), where(f), "is absolute"))
        tests.append(_bad(value(f).rlike(r"(^|/)\.\.(/|$)"), where(f), "leaves the corpus"))
    found = at.select(F.explode(F.array_compact(F.array(*tests))).alias("e")).select("e.*")
    twice = at.select("place", value("paper_id").alias("id")).where("id RLIKE '[^ ]'").groupBy("id").agg(F.array_sort(F.collect_list("place")).alias("at")).where(F.size("at") > 1)
    pairs = twice.select(F.concat(F.lit("papers["), F.element_at("at", 2).cast("string"), F.lit("].paper_id")).alias("place"), F.concat(F.lit("repeats papers["), F.element_at("at", 1).cast("string"), F.lit("]")).alias("message"))
    return found.unionByName(pairs)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The papers of a manifest; an error that names every fault where it has one."""
    one = entries(spark, path)
    top = one.first()
    if top is None or top.kind is None:
        text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
        try:
            json.loads(text)
        except ValueError as e:
            raise ManifestError(f"line {getattr(e, 'lineno', '?')} column {getattr(e, 'colno', '?')}: {getattr(e, 'msg', e)}") from e
        raise ManifestError("the manifest is empty")
    if not top.kind.startswith("OBJECT"):
        raise ManifestError("the manifest is no object")
    unknown = sorted(set(top["keys"] or []) - set(TOP_FIELDS))
    if unknown:
        raise ManifestError(f"unknown field {', '.join(unknown)}")
    if top.version != MANIFEST_VERSION:
        raise ManifestError(f"manifest_version: {top.version!r} is not {MANIFEST_VERSION!r}")
    rows = one.select(F.posexplode("papers").alias("place", "v")).select("place", F.expr("to_json(v)").alias("entry"))
    wrong = entry_errors(rows).orderBy("place", "message").limit(50).collect()
    if wrong:
        raise ManifestError("; ".join(f"{r.place}: {r.message}" for r in wrong))
    out = rows.select("place", F.from_json("entry", PAPERS).alias("p")).select("place", "p.*")
    for f in ("title", "venue", "doi", "note", "text_path", "text_sha256"):
        out = out.withColumn(f, F.nullif(scalars.strip(F.col(f)), F.lit("")))
    trimmed = F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), scalars.strip), lambda a: a != "")
    return out.withColumn("authors", trimmed).withColumn("held", F.coalesce("held", F.lit(False))).drop("place")


def entry_json(papers: DataFrame) -> DataFrame:
    """(paper_id, entry): manifest entries as JSON, nulls kept, a note only where there is one."""
    own = F.to_json(F.struct(*[c for c in FIELDS if c != "note"]), {"ignoreNullFields": "false"})
    noted = F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})
    return papers.select("paper_id", F.when(F.col("note").isNull(), own).otherwise(noted).alias("entry"))


@F.pandas_udf(T.StringType())
def _indented(entries: pd.Series) -> pd.Series:
    return entries.map(lambda e: "\n" + textwrap.indent(json.dumps(json.loads(e), indent=2, ensure_ascii=False), "    "))


def write_manifest(papers: DataFrame, path: str | os.PathLike, extractor: str) -> None:
    """The manifest, entries in the order of their ids: no times, so the same papers give the same bytes."""
    head = "{\n" + f'  "manifest_version": {json.dumps(MANIFEST_VERSION)},\n  "extractor": {json.dumps(extractor)},\n  "papers": ['
    entries = entry_json(papers).orderBy("paper_id").select(_indented("entry"))
    sink.write_list(entries, path, head, ",", "\n  ]\n}\n", "]\n}\n")


def document_text(pages: Column, fields: dict[str, Column]) -> Column:
    """A document: header lines in their order, the sentinel, and the pages after form feeds."""
    lines = [F.when(scalars.clean_value(fields[k].cast("string")).isNotNull(), F.concat(F.lit(f"{k}: "), scalars.clean_value(fields[k].cast("string")))) for k in scalars.HEADER_KEYS if k in fields]
    lines += [F.lit("Note: The text is as the extractor gave it."), F.lit(scalars.SENTINEL)]
    head = F.concat(F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n"))
    return F.concat(head, F.lit("\f"), F.array_join(pages, "\f"))


def pages_intact(document: Column, pages: Column) -> Column:
    """Whether a document gives back exactly the pages it was made of."""
    return scalars.pages(document) == pages


def stale(papers: DataFrame, files: DataFrame) -> DataFrame:
    """(paper_id, reason) of papers whose files are not what the manifest says.

    ``files``: path, sha256 (null where a file can't be read, which counts as changed).
    """
    pdf = files.select(F.col("path").alias("pdf_path"), F.lit(1).alias("pdf_there"), F.col("sha256").alias("pdf_now"))
    text = files.select(F.col("path").alias("text_path"), F.lit(1).alias("text_there"), F.col("sha256").alias("text_now"))
    rows = papers.join(pdf, "pdf_path", "left").join(text, "text_path", "left")
    held = F.coalesce("held", F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("pdf_there").isNull(), "PDF_MISSING"),
            F.when(F.col("pdf_there").isNotNull() & ~F.col("pdf_now").eqNullSafe(F.col("pdf_sha256")), "PDF_CHANGED"),
            F.when(held & F.col("text_path").isNull(), "TEXT_NOT_RECORDED"),
            F.when(held & F.col("text_path").isNotNull() & F.col("text_there").isNull(), "TEXT_MISSING"),
            F.when(held & F.col("text_there").isNotNull() & F.col("text_sha256").isNotNull() & ~F.col("text_now").eqNullSafe(F.col("text_sha256")), "TEXT_CHANGED"),
            F.when(~held & F.col("text_there").isNotNull(), "TEXT_UNEXPECTED"),
        )
    )
    return rows.select("paper_id", F.explode(reasons).alias("reason"))


#: A name that an earlier one may get by its number.
_NUMBERED = r"^(.+)-([2-9]|[1-9][0-9]{1,17})$"


def _passed_over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(parent, k, skipped, nth): which contested numbers of a candidate its files pass over. Rows by parent and k:
    parent, bare (1 where its first file has the plain name), k, gone, before (files of the parent before the
    first file whose own candidate is that name)."""
    parent, skipped = None, 0
    for rows in batches:
        out = []
        for name, bare, k, gone, before in rows.itertuples(index=False, name=None):
            if name != parent:
                parent, skipped = name, 0
            # So many files need a number before the name's own file comes, and so many numbers lie before k.
            skip = bool(gone) or k - 2 - skipped >= max(0, before - bare)
            out.append((name, k, skip, skipped))
            skipped += skip
        yield pd.DataFrame(out, columns=["parent", "k", "skipped", "nth"])


def unique_ids(files: DataFrame, taken: DataFrame, candidate: str = "candidate", order: str = "path") -> DataFrame:
    """``files`` with paper_id: the candidate, or with -2, -3.. the first number that is free when the file's turn comes.

    Files take their names in ``order``; a name may be taken from the start, or by a file before, be it
    as its candidate or by a number. Two candidates can only meet in a name where one is the other with a
    number, and then only the first file of the longer one asks for it. So candidates are settled from
    the shortest names up, in as many rounds as numbers follow each other in a name; in a round each
    candidate reads its contested numbers in order, and all its files get theirs by their rank.

    Of files alike in ``order`` that of the shorter candidate comes first. A null candidate is a name like others
    and gets no number.
    """
    rows = materialise(intervals.numbered(files, candidate, order, "__nth"), "ids-numbered")
    gone = taken.select(F.col("paper_id").alias("name"), F.lit(1).alias("gone")).where("name IS NOT NULL").distinct()
    own = rows.where(F.col(candidate).isNotNull()).groupBy(F.col(candidate).alias("name")).agg(F.min(order).alias("first"))
    names = own.join(gone, "name", "full").select("name", "first", F.coalesce("gone", F.lit(0)).alias("gone"))
    names = names.withColumn("parent", F.nullif(F.regexp_extract("name", _NUMBERED, 1), F.lit(""))).withColumn("k", F.expr(f"try_cast(nullif(regexp_extract(name, r'{_NUMBERED}', 2), '') AS BIGINT)"))
    parents = own.select(F.col("name").alias("parent"), F.lit(1).alias("held"))
    names = materialise(names.join(parents, "parent", "left"), "ids-names")
    settled = names.where("first IS NOT NULL AND held IS NULL").select("name", (1 - F.col("gone")).alias("bare"))
    contested = names.where("held IS NOT NULL")
    skipped = None
    if not contested.isEmpty():
        starts = rows.select(F.col(candidate).alias("parent"), F.col(order).alias("at"), "__nth")
        asked = contested.select("name", "parent", "k", "gone", "first")
        asked = materialise(intervals.as_of(asked, starts, "parent", "first", "at", "__nth").withColumn("before", F.coalesce("__nth", F.lit(0))), "ids-contested")
        settled = fresh = materialise(settled, "ids-settled")
        while not fresh.isEmpty():
            open_ = asked.join(fresh.select(F.col("name").alias("parent"), "bare"), "parent").select("parent", "bare", "k", "gone", "before")
            found = open_.repartition("parent").sortWithinPartitions("parent", "k").mapInPandas(_passed_over, "parent string, k long, skipped boolean, nth long")
            found = materialise(found, "ids-passed-over")
            fresh = asked.where("first IS NOT NULL").join(found, ["parent", "k"]).select("name", F.when(F.col("skipped") & (F.col("gone") == 0), 1).otherwise(0).alias("bare"))
            fresh = materialise(fresh, "ids-settled")
            settled = settled.unionByName(fresh)
            # A number n that the i-th name passed over lies behind is reached by the (n - 1 - i)-th file.
            passed = found.where("skipped").select(F.col("parent").alias("name"), (F.col("k") - 1 - F.col("nth")).alias("from"), (F.col("nth") + 1).alias("passed"))
            skipped = passed if skipped is None else skipped.unionByName(passed)
    out = rows.join(settled, rows[candidate] == settled["name"], "left").withColumn("__j", (F.col("__nth") - F.coalesce("bare", F.lit(1))).cast("long")).drop("name", "bare", "__nth")
    if skipped is None:
        out = out.withColumn("passed", F.lit(0))
    else:
        out = intervals.as_of(out, skipped.withColumnRenamed("name", candidate), candidate, "__j", "from", "passed").drop("from")
    number = F.col("__j") + 1 + F.coalesce("passed", F.lit(0))
    return out.withColumn("paper_id", F.when(F.col("__j") == 0, F.col(candidate)).otherwise(F.concat(F.col(candidate), F.lit("-"), number.cast("string")))).drop("__j", "passed")
