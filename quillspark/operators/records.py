"""Storable annotation records of located quotes, and their renewal after a version change.

A record holds a text selector, which decides, a position selector, which is a cache, and what it
was made with. A record whose versions differ from today's is stale: it is made anew from its
quote. Fresh records are passed through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.anchor import T_LOCATE, Ladder, Prepared, Versions

CONTEXT = "http://www.w3.org/ns/anno.jsonld"
AROUND = 32
FRESH, STALE = "FRESH", "STALE"

_REFS = "quote_raw string, tier string, is_verbatim boolean, score double, diff string, located_text string, authoritative_selector string, position_selector_is_cache boolean, normaliser string, normaliser_fingerprint string, matchform string, verifier string, verifier_fingerprint string, scorer string"
_FLAT = f"{_REFS}, exact string, prefix string, suffix string, start int, stop int"


def _flat(raw: str, quote: str, least: float, scorer: str, versions: Versions, around: int) -> dict:
    ladder, document = Ladder(quote, least, scorer), Prepared(raw or "")
    found = ladder(document)
    a = found.offset
    b = None if a is None else a + found.length
    located = None if a is None else document.norm[a:b]
    return {
        "quote_raw": quote,
        "tier": found.tier,
        "is_verbatim": found.is_verbatim,
        "score": found.score,
        "diff": found.diff,
        "located_text": located,
        "authoritative_selector": "TextQuoteSelector",
        "position_selector_is_cache": True,
        **versions.as_dict(),
        "scorer": found.scorer,
        "exact": ladder.norm if a is None else located,
        "prefix": "" if a is None else document.norm[max(0, a - around) : a],
        "suffix": "" if a is None else document.norm[b : b + around],
        "start": a,
        "stop": b,
    }


def annotate(pairs: DataFrame, versions: Versions | None = None, around: int = AROUND) -> DataFrame:
    """Records of pairs (record_id, source, raw, quote, optionally t_locate and scorer): record_id, target, refs."""
    versions = versions or Versions()
    columns = pairs.columns
    pairs = pairs.select(
        "record_id", "source", "raw", "quote", F.col("t_locate") if "t_locate" in columns else F.lit(T_LOCATE).alias("t_locate"), F.col("scorer") if "scorer" in columns else F.lit("difflib").alias("scorer")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"record_id": i, "source": source} | _flat(raw, quote, least, scorer, versions, around) for i, source, raw, quote, least, scorer in batch.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=["record_id", "source", *(x.split()[0] for x in _FLAT.split(", "))]).astype({"start": "Int32", "stop": "Int32"})

    kinds = dict(pairs.dtypes)
    return assemble(pairs.mapInPandas(run, f"record_id {kinds['record_id']}, source {kinds['source']}, {_FLAT}"))


def assemble(flat: DataFrame) -> DataFrame:
    """Flat columns as the nested record."""
    text = F.struct(F.lit("TextQuoteSelector").alias("type"), "exact", "prefix", "suffix", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    none = F.lit(None).cast("string")
    place = F.struct(F.lit("TextPositionSelector").alias("type"), none.alias("exact"), none.alias("prefix"), none.alias("suffix"), F.col("start"), F.col("stop").alias("end"))
    selectors = F.when(F.col("start").isNull(), F.array(text)).otherwise(F.array(text, place))
    refs = F.struct(*(x.split()[0] for x in _REFS.split(", ")))
    return flat.select("record_id", F.lit(CONTEXT).alias("context"), F.lit("Annotation").alias("type"), F.struct("source", selectors.alias("selector")).alias("target"), refs.alias("refs"))


def as_json(records: DataFrame) -> DataFrame:
    """(record_id, json): records in the annotation data model; nulls of refs are kept."""
    # Selectors drop what they don't have; refs say null.
    target = F.to_json(F.col("target"))
    refs = F.to_json(F.col("refs"), {"ignoreNullFields": "false"})
    return records.select("record_id", F.concat(F.lit('{"@context":"'), "context", F.lit('","type":"Annotation","target":'), target, F.lit(',"refs":'), refs, F.lit("}")).alias("json"))


def status(refs: Column, versions: Versions | None = None) -> Column:
    """``FRESH`` where all five versions are today's; a version that is missing makes a record stale."""
    same = F.lit(True)
    for name, value in (versions or Versions()).as_dict().items():
        same = same & refs[name].eqNullSafe(F.lit(value))
    return F.when(same, FRESH).otherwise(STALE)


def renew(records: DataFrame, documents: DataFrame, versions: Versions | None = None) -> DataFrame:
    """Records with the stale ones made anew from ``documents`` (source, raw); other columns are kept.

    A stale record without a quote is an error: it can't be made again.
    """
    now = status(F.col("refs"), versions)
    stale = records.where(now == STALE)
    quote = F.col("refs.quote_raw")
    checked = F.when(quote.isNull() | (quote == ""), F.raise_error(F.lit("a record without refs.quote_raw can't be anchored again"))).otherwise(quote)
    pairs = stale.select("record_id", F.col("target.source").alias("source"), checked.alias("quote"), F.coalesce("refs.scorer", F.lit("difflib")).alias("scorer")).join(documents.select("source", "raw"), "source", "left")
    fresh = annotate(pairs, versions).select("record_id", "context", "type", "target", "refs")
    own = [c for c in records.columns if c not in ("context", "type", "target", "refs")]
    renewed = stale.select(own).join(fresh, "record_id").select(records.columns)
    return records.where(now == FRESH).unionByName(renewed)
