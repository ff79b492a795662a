"""The two queries: whether quotes stand in documents, and where phrases occur.

``prepare_corpus`` makes a document's forms, region, style and pages once. ``verify_quotes``
answers each quote from its best document; ``find_passages`` lists the documents where a phrase
stands, and never runs the fuzzy tier.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import anchor, markers, scalars
from quillspark.functions.normalise import normalise
from quillspark.operators import locate as loc
from quillspark.operators import region
from quillspark.plans import contract
from quillspark.sources.tables import materialise

INTERVAL = "struct<start_pos:int,end_pos:int,basis:string>"
BASIS = "normalised_document"


def prepare_corpus(papers: DataFrame, key: str = "paper_id") -> DataFrame:
    """(paper_id, raw, norm, match, header_end, pages, region, marker_style), as a written table.

    A document that is null or blank is not held; it has null forms.
    """
    return materialise(made_corpus(papers, key), "corpus", packed=True)


def made_corpus(papers: DataFrame, key: str = "paper_id") -> DataFrame:
    """The rows of ``prepare_corpus``, not written. ``papers`` may say by ``hinted`` which texts hold the words of a heading, so that no text is searched for them again."""
    # Only documents that may have a list are joined with its bounds, before their forms are made.
    hinted = F.col("hinted") if "hinted" in papers.columns else region.has_hint(F.col("raw"))
    none = papers.where(~hinted).select(key, "raw")
    nowhere = F.struct(*region.unknown(F.col(key))[1:]).alias("region")
    some = papers.where(hinted).select(key, "raw")
    bounds = region.detect_hinted(some, key)
    some = some.join(bounds.select(key, F.struct(*[c for c in bounds.columns if c != key]).alias("region")), key, "left")
    docs = loc.prepare(none.select(key, "raw", nowhere).unionByName(some), key, "raw")
    docs = docs.withColumn("header_end", scalars.header_end(F.col("raw"))).withColumn("pages", scalars.pages(F.col("raw")))
    before = F.when(F.col("region.start_char").isNull(), F.col("raw")).otherwise(F.substring("raw", F.lit(1), F.col("region.start_char").cast("int")))
    docs = docs.withColumn("__body", before).withColumn("__years", F.size(markers.author_year_udf("__body")).cast("long"))
    style = markers.style_column(markers.count_bracketed(F.col("__body")), F.col("__years"), F.col("region.start_char").isNotNull())
    return docs.withColumn("marker_style", style).select(key, "raw", "norm", "match", "header_end", "pages", "region", "marker_style")


def prepare_quotes(quotes: DataFrame, key: str = "quote_id") -> DataFrame:
    """Quotes (key, quote, optionally t_locate and paper_id) with forms, threshold and guard."""
    asked = quotes.columns
    quotes = quotes.withColumn("quote", F.coalesce("quote", F.lit("")))
    clamp = scalars.threshold(F.col("t_locate") if "t_locate" in asked else F.lit(anchor.T_LOCATE))
    quotes = quotes.withColumn("__clamp", clamp).withColumn("t_locate", F.col("__clamp.t")).withColumn("threshold_noted", F.when(F.col("__clamp.noted"), 1).otherwise(0)).drop("__clamp")
    out = loc.prepare(quotes, key, "quote")
    return materialise(out.withColumn("guard", scalars.guard(F.col("quote"), F.col("norm"))), "quotes")


def _decorate(rows: DataFrame, docs: DataFrame, doc_key: str) -> DataFrame:
    """What a response says around a location: characters, page, markers, sentence, region, block.

    ``rows``: doc_key, offset_norm, length_norm and more. The map of a document is made here, for
    the few documents with a location, and leaves the task as offsets only.
    """
    joined = rows.join(docs.select(doc_key, "raw", "header_end", "pages", "region", "marker_style"), doc_key)
    names = ["raw_offset", "document_text", "floor", *_COUNTS, "sentence_start", "sentence_stop", "sentence_text"]
    schema = "raw_offset int, document_text string, floor int, " + ", ".join(f"{c} long" for c in _COUNTS) + ", sentence_start int, sentence_stop int, sentence_text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            # A document's map is made once for all its locations in a batch.
            prepared = {raw: anchor.Prepared(raw) for raw in batch["raw"].unique()}
            for raw, offset, length, head in zip(batch["raw"], batch["offset_norm"], batch["length_norm"], batch["header_end"]):
                doc = prepared[raw]
                norm, at = doc.norm, doc.norm_map
                floor = bisect.bisect_left(at, head)
                around = markers.counts_around(norm, int(offset), int(length), floor)
                a, b = markers.sentence_span(norm, int(offset), int(offset + length), min(floor, int(offset))) or (None, None)
                place = at[int(offset)] if offset < len(at) else None
                out.append((place, doc.raw_span(int(offset), int(length)), floor, *(around[c] for c in _COUNTS), a, b, None if a is None else norm[a:b]))
            extra = pd.DataFrame(out, columns=names, index=batch.index).astype({"raw_offset": "Int32", "sentence_start": "Int32", "sentence_stop": "Int32"})
            yield pd.concat([batch[keys], extra], axis=1)

    keys = [c for c in rows.columns]
    kinds = dict(joined.dtypes)
    spans = joined.select(*keys, "raw", "header_end").mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", " + schema)
    full = spans.join(docs.select(doc_key, F.col("raw").alias("__raw"), "pages", "region", "marker_style", "header_end"), doc_key)
    block = scalars.local_block(F.col("__raw"), F.col("raw_offset"))
    return (
        full.withColumn("page", scalars.page_of(F.col("pages"), F.col("document_text")))
        .withColumn("region_status", region.classify(F.col("raw_offset"), F.col("region")))
        .withColumn("local_signals", scalars.block_signals(block))
        .withColumn("local_block", scalars.block_label(block))
        .drop("__raw", "pages", "region")
    )


_COUNTS = [f"{k}{w}" for w in ("in_located_characters", "in_surrounding_characters") for k in ("", "bracketed_", "author_year_")]


def _interval() -> Column:
    return F.when(F.col("start_pos").isNotNull(), F.struct("start_pos", "end_pos", F.lit(BASIS).alias("basis")))


def _marker_block() -> Column:
    sentence = F.when(F.col("sentence_text").isNotNull(), F.struct(F.col("sentence_text").alias("document_text"), F.struct(F.col("sentence_start").alias("start_pos"), F.col("sentence_stop").alias("end_pos"), F.lit(BASIS).alias("basis")).alias("char_interval")))
    return F.struct(*_COUNTS, F.lit(markers.CONTEXT).alias("context_chars"), "marker_style", sentence.alias("sentence"), F.lit(markers.MARKERS_VERSION).alias("markers_version"))


def _region_block() -> Column:
    local = F.struct(F.col("local_block").alias("signal"), F.size("local_signals").alias("signals_found"), F.col("local_signals").alias("signals_named"), F.lit(scalars.BLOCK_CHARS).alias("block_chars"), F.lit(scalars.BLOCK_SIGNALS).alias("signals_required"))
    return F.struct(F.col("region_status").alias("status"), F.lit(region.REGION_VERSION).alias("region_version"), F.lit(region.RULE).alias("rule"), local.alias("local_block"))


def _provenance(scorer: str = "difflib") -> Column:
    v = anchor.Versions()
    return F.struct(F.lit(v.normaliser).alias("normaliser"), F.lit(v.verifier).alias("verifier"), F.lit(scorer).alias("scorer"), F.lit(contract.SERVER).alias("server"))


def _outside_header(found: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Verdicts without the locations that lie in a document's header; those count as absences."""
    heads = docs.where("header_end > 0").select(key, "header_end", "raw")
    if heads.isEmpty():
        return found.withColumn("in_header", F.lit(0))
    joined = found.join(heads, key, "left")

    @F.pandas_udf("int")
    def place(raws: pd.Series, offsets: pd.Series) -> pd.Series:
        maps = {raw: normalise(raw)[1] for raw in raws.dropna().unique()}
        return pd.Series([None if raw is None or pd.isna(o) else maps[raw][int(o)] for raw, o in zip(raws, offsets)], dtype="Int32")

    headed = joined.where("header_end IS NOT NULL AND offset_norm IS NOT NULL").withColumn("__at", place("raw", "offset_norm"))
    headed = headed.withColumn("in_header", F.when(F.col("__at") < F.col("header_end"), 1).otherwise(0)).drop("__at")
    rest = joined.where("header_end IS NULL OR offset_norm IS NULL").withColumn("in_header", F.lit(0))
    return rest.unionByName(headed).drop("header_end", "raw")


def verify_quotes(papers: DataFrame, quotes: DataFrame, mode: str = "blocked", corpus: DataFrame | None = None, scorer: str = "difflib") -> DataFrame:
    """One response per quote.

    ``papers``: paper_id, raw. ``quotes``: quote_id, quote, optionally paper_id and t_locate. The
    response is flat: outcome, paper_id, document_text, your_text, char_diff, char_interval, score,
    scorer, page, also_occurs_in, citation_markers, reference_region, reason, provenance, notice and
    not_available, each null where an outcome has no such field.
    """
    docs = prepare_corpus(papers) if corpus is None else corpus
    asked = prepare_quotes(quotes)
    if "paper_id" not in asked.columns:
        asked = asked.withColumn("paper_id", F.lit(None).cast(papers.schema["paper_id"].dataType))
    held = docs.where(F.col("raw").isNotNull() & ~scalars.is_blank(F.col("raw")))
    known = asked.join(papers.select("paper_id", F.lit(1).alias("known")).distinct(), "paper_id", "left").join(held.select("paper_id", F.lit(1).alias("held")).distinct(), "paper_id", "left")
    some_held = not held.isEmpty()
    early = (
        F.when(F.col("guard").isNotNull(), "NOT_LOCATABLE")
        .when(F.col("paper_id").isNotNull() & F.col("known").isNull(), "SOURCE_UNKNOWN")
        .when(F.col("paper_id").isNotNull() & F.col("held").isNull(), "SOURCE_NOT_HELD")
        .when(F.lit(not some_held), "SOURCE_NOT_HELD")
    )
    known = known.withColumn("early", early)
    known = materialise(known, "asked")
    open_ = known.where("early IS NULL").select("quote_id", "quote", "norm", "match", "t_locate", "paper_id")
    # A quote that stands in a body needs no scores of other documents.
    identity = lambda found: _outside_header(found, held, "paper_id").where((F.col("in_header") == 0) & F.col("tier").isin(anchor.EXACT, anchor.RELAXED))
    found = materialise(_outside_header(loc.locate(held, open_, mode, scorer=scorer, settled=identity), held, "paper_id"), "found")
    shown = found.where("in_header = 0")
    ranked = loc.best_with_others(loc.rank(shown))
    hidden = found.where("in_header = 1").groupBy("quote_id").agg(F.array_sort(F.collect_set(F.col("paper_id").cast("string"))).alias("header_hits"))
    ranked = materialise(ranked, "ranked")
    best = open_.select("quote_id", F.col("paper_id").alias("asked_id")).join(ranked.withColumnRenamed("paper_id", "best_id"), "quote_id", "left").join(hidden, "quote_id", "left")
    located = best.where("offset_norm IS NOT NULL").withColumn("paper_id", F.col("best_id"))
    spans = _decorate(located.select("quote_id", "paper_id", "offset_norm", "length_norm"), held, "paper_id").drop("paper_id", "offset_norm", "length_norm", "header_end")
    rows = known.join(best.drop("asked_id"), "quote_id", "left").join(spans, "quote_id", "left")
    # A span without characters of its own is no location.
    lost = F.col("offset_norm").isNotNull() & F.col("document_text").isNull()
    tier = F.when(lost, anchor.NOT_LOCATABLE).otherwise(F.coalesce("tier", F.lit(anchor.NOT_LOCATABLE)))
    rows = rows.withColumn("outcome", F.coalesce("early", contract.outcome(tier)))
    is_located = F.col("outcome").isin(contract.OUTCOMES[:3])
    rows = rows.withColumn("start_pos", F.when(is_located, F.col("offset_norm"))).withColumn("end_pos", F.when(is_located, F.col("offset_norm") + F.col("length_norm")))
    reasons = (
        F.when(F.col("guard") == "TOO_LONG", f"the string is longer than {scalars.MOST_CHARS} characters")
        .when(F.col("guard") == "TOO_SHORT", f"the string has fewer than {scalars.FEWEST_CHARS} characters after normalisation")
        .when(F.col("outcome") == "SOURCE_UNKNOWN", "no document of this id is held")
        .when(F.col("outcome") == "SOURCE_NOT_HELD", "no usable characters are held")
    )
    notes = F.array_compact(
        F.array(
            F.when(F.col("threshold_noted") == 1, contract.absence("t_locate", "the threshold asked for is outside the advised range or was replaced by the usual one")),
            F.when(F.size("header_hits") > 0, F.struct(F.lit("header_location").alias("field"), F.lit("a location in a document's header is not reported").alias("reason"), F.array_join("header_hits", ",").alias("detail"))),
            F.when(is_located & F.col("page").isNull(), contract.absence("page", "the located characters lie on no single page")),
            F.when(F.col("guard").isNotNull(), contract.absence("search", "no document was searched for a string of this length")),
            F.when(F.col("marker_style") == markers.UNDETECTABLE, contract.absence("citation_markers", "this document cites in a way that the marker counts can't see")),
        )
    )
    relocated = F.col("outcome") == contract.OUTCOMES[2]
    out = rows.select(
        "quote_id",
        "outcome",
        F.lit(contract.NOTICE).alias("interpretation_notice"),
        F.coalesce(F.when(is_located, F.col("best_id")), F.col("paper_id")).alias("paper_id"),
        F.when(is_located, F.col("document_text")).alias("document_text"),
        F.when(~F.col("outcome").isin(contract.VERBATIM), scalars.echoed(F.col("quote"))).alias("your_text"),
        F.when(relocated, F.col("diff")).alias("char_diff"),
        _interval().alias("char_interval"),
        F.when(F.col("early").isNull(), F.col("score")).alias("score"),
        F.coalesce("scorer", F.lit(scorer)).alias("scorer"),
        F.when(is_located, F.col("page")).alias("page"),
        F.when(is_located & F.col("paper_id").isNull(), F.col("also_occurs_in")).alias("also_occurs_in"),
        F.when(is_located, _marker_block()).alias("citation_markers"),
        F.when(is_located, _region_block()).alias("reference_region"),
        reasons.alias("reason"),
        _provenance(scorer).alias("provenance"),
        notes.alias("not_available"),
    )
    return contract.validate(out)


def find_passages(papers: DataFrame, queries: DataFrame, max_hits: int | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """One response per query (quote_id, quote, optionally paper_ids): the documents where it stands.

    Hits are in the order of their ids. ``paper_ids`` null or empty means all documents; an id that
    stands twice gives its hits twice. Unknown ids are an absence; none known is SOURCE_UNKNOWN.
    """
    docs = prepare_corpus(papers) if corpus is None else corpus
    asked = prepare_quotes(queries)
    kind = papers.schema["paper_id"].dataType
    if "paper_ids" not in asked.columns:
        asked = asked.withColumn("paper_ids", F.lit(None).cast(f"array<{kind.simpleString()}>"))
    held = docs.where(F.col("raw").isNotNull() & ~scalars.is_blank(F.col("raw")))
    n_held = held.count()
    restricted = F.col("paper_ids").isNotNull() & (F.size("paper_ids") > 0)
    wanted = asked.where(restricted).select("quote_id", F.explode("paper_ids").alias("paper_id"))
    wanted = wanted.join(held.select("paper_id", F.lit(1).alias("known")), "paper_id", "left")
    sums = wanted.groupBy("quote_id").agg(F.count("known").alias("n_known"), F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("paper_id").cast("string")))).alias("missing"))
    rows = asked.join(sums, "quote_id", "left").withColumn("n_searched", F.when(restricted, F.coalesce("n_known", F.lit(0))).otherwise(n_held).cast("long"))
    rows = rows.withColumn("outcome", F.when(F.col("guard").isNotNull(), "NOT_LOCATABLE").when(F.col("n_searched") == 0, "SOURCE_UNKNOWN").otherwise("OK"))
    open_ = rows.where("outcome = 'OK'").select("quote_id", "quote", "norm", "match", "t_locate")
    found = loc.locate(held, open_, tiers=(anchor.EXACT, anchor.RELAXED))
    found = materialise(_outside_header(found, held, "paper_id").where("in_header = 0"), "found")
    free = found.join(rows.where(~restricted).select("quote_id"), "quote_id", "left_semi")
    bound = found.join(wanted.where("known IS NOT NULL").select("quote_id", "paper_id"), ["quote_id", "paper_id"])
    hits = free.unionByName(bound.select(free.columns))
    cap = int(max(1, min(50, 10 if max_hits is None else max_hits)))
    nth = Window.partitionBy("quote_id").orderBy("paper_id")
    hits = hits.withColumn("nth", F.row_number().over(nth)).withColumn("hit_count", F.count(F.lit(1)).over(Window.partitionBy("quote_id")))
    spans = _decorate(hits.where(F.col("nth") <= cap).select("quote_id", "paper_id", "tier", "offset_norm", "length_norm", "score", "nth", "hit_count"), held, "paper_id")
    spans = spans.withColumn("start_pos", F.col("offset_norm")).withColumn("end_pos", F.col("offset_norm") + F.col("length_norm"))
    hit = F.struct("nth", F.struct(contract.outcome(F.col("tier")).alias("outcome"), "paper_id", "document_text", _interval().alias("char_interval"), "score", "page", _marker_block().alias("citation_markers"), _region_block().alias("reference_region")).alias("hit"))
    listed = spans.where("document_text IS NOT NULL").groupBy("quote_id").agg(F.transform(F.array_sort(F.collect_list(hit)), lambda x: x["hit"]).alias("hits"), F.max("hit_count").alias("all_hits"))
    out = rows.join(listed, "quote_id", "left")
    empty = F.array().cast(listed.schema["hits"].dataType)
    left_out = F.col("all_hits") - cap
    notes = F.array_compact(
        F.array(
            F.when(left_out > 0, F.struct(F.lit("hits").alias("field"), F.lit("more hits than asked for are left out").alias("reason"), left_out.cast("string").alias("detail"))),
            F.when(F.size("missing") > 0, F.struct(F.lit("paper_ids").alias("field"), F.lit("no document of this id is held").alias("reason"), F.array_join("missing", ",").alias("detail"))),
        )
    )
    return contract.validate(
        out.select(
            "quote_id",
            "outcome",
            F.lit(contract.NOTICE).alias("interpretation_notice"),
            scalars.echoed(F.col("quote")).alias("query"),
            F.size(F.coalesce("hits", empty)).cast("long").alias("hit_count"),
            F.coalesce("hits", empty).alias("hits"),
            F.when(F.col("outcome") == "OK", F.col("n_searched")).otherwise(0).alias("searched_document_count"),
            _provenance().alias("provenance"),
            notes.alias("not_available"),
        )
    )
