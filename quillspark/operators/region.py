"""Where a document's reference list begins and ends, as window functions over its lines.

Lines are rows. Four kinds of features are counted on each; a line next to one with features
counts as well. A heading is accepted where enough of the lines after it look like references.
The end is the smaller of two estimates: where a sliding density stays low, and where the running
sum of log odds is greatest. All frames are partitioned by document, so documents spread over the
cluster; the lines of one document meet in one task.

Documents without the words of a heading have no list, and none of their lines is made. The others
are dealt out by their key once, before they are cut into lines, so that no line moves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import scalars

REGION_VERSION = "region/1"
#: What responses say of the label.
RULE = (
    "The list begins at its heading and ends where two models of its lines say; an offset before both ends is in the list, one before the later end alone is "
    "uncertain, and all others are outside of it."
)

# Fixed values of the model.
START_LINES, START_DENSITY = 22, 0.70
END_LINES, END_DENSITY, END_RUN = 25, 0.34, 3
PROBABILITIES = (0.10, 0.35, 0.62, 0.82, 0.93)
TABLE_MOST = 0.25
DIVERGENCE = 0.5
MANY_HEADINGS, MANY_SPREAD = 3, 0.5

HEADINGS = ["REFERENCES", "BIBLIOGRAPHY", "LITERATURE CITED", "WORKS CITED", "REFERENCE LIST"]
#: A letter-spaced heading has a space or tab between its letters.
_SPACED = "|".join("[ \\t]{1,8}".join("[ \\t]?".join(word) for word in h.split(" ")) for h in HEADINGS)
HEADING = rf"(?:^\f?|(?<=\s\s))(?:(?:[0-9]{{1,2}}(?:\.[0-9]{{1,2}})?|[IVXLC]{{1,6}}|[A-Z])[.)]?[ \t]{{1,8}})?(?i:{_SPACED})(?![A-Za-z])"
#: What a text with a heading holds somewhere.
HINT = rf"(?i:{_SPACED})(?![A-Za-z])"
# Lines that speak of references, and words that follow the word in a sentence.
LINE_REJECT = r"(?i)[\"“”‘’]references[\"“”‘’]|reference format|cross-references|\.{5,}|references (?:to|of|are|in|for|were|and)"
WORD_REJECT = r"(?is)^[^A-Za-z0-9]{0,3}(?:to|of|in|for|are|is|and|or|that|which|from|used|such|list|section|format|cited|were|have|can)\b"

STATUSES = ["IN_REFERENCE_REGION", "OUTSIDE_REFERENCE_REGION", "IN_REFERENCE_REGION_UNCERTAIN", "REGION_UNKNOWN", "REGION_END_UNCERTAIN", "REGION_MODEL_INAPPLICABLE"]


def lines_of(docs: DataFrame, key: str = "paper_id", raw: str = "raw") -> DataFrame:
    """(key, line_no, line, start_char, features, table): the lines of each document."""
    parts = docs.repartition(key).select(*[c for c in docs.columns if c != raw], F.posexplode(F.split(raw, "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long")
    blank = scalars.is_blank(F.col("line"))
    features = F.when(~blank, scalars.feature_count(F.col("line"))).otherwise(0)
    return parts.select("*", start.alias("start_char"), blank.alias("blank"), features.alias("features"))


def positions(lines: DataFrame, key: str = "paper_id") -> DataFrame:
    """Lines that hold text, with their place among those and whether they or a neighbour show features."""
    w = Window.partitionBy(key).orderBy("line_no")
    near = w.rowsBetween(-1, 1)
    filled = lines.where(~F.col("blank")).withColumn("pos", F.row_number().over(w) - 1)
    return filled.withColumn("dilated", F.max((F.col("features") > 0).cast("int")).over(near))


def _heads(lines: DataFrame, key: str) -> DataFrame:
    """``lines`` with the candidates of each line, in order: an array of heading_start, heading."""
    w = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("after", F.concat_ws("\n", "line", F.lead("line", 1).over(w), F.lead("line", 2).over(w)))
    pieces = F.split("line", HEADING, -1)
    matches = F.regexp_extract_all("line", F.lit(HEADING), F.lit(0))
    ends = F.transform(
        matches,
        lambda m, i: F.struct(
            (F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0), lambda s, p: s + F.length(p)) + F.aggregate(F.slice(matches, F.lit(1), i), F.lit(0), lambda s, p: s + F.length(p))).alias("at"),
            m.alias("text"),
        ),
    )
    spared = F.filter(ends, lambda m: ~F.substring("after", m["at"] + F.length(m["text"]) + 1, F.lit(24)).rlike(WORD_REJECT))
    heads = F.transform(spared, lambda m: F.struct((F.col("start_char") + m["at"]).alias("heading_start"), scalars.strip(m["text"]).alias("heading")))
    return lines.withColumn("heads", F.when(F.col("line").rlike(HEADING) & ~F.col("line").rlike(LINE_REJECT), heads)).drop("after")


def headings(lines: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, line_no, heading_start, heading): candidates that both rejections spare.

    A line is searched with the line before it in mind only through its own text: a gap before a
    heading lies in its line. The text after a match runs on into the next lines.
    """
    return _heads(lines, key).select(key, "line_no", F.inline("heads"))


def start_densities(pos: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, line_no, density): the share of reference-like lines after each line."""
    after = Window.partitionBy(key).orderBy("line_no").rowsBetween(1, START_LINES)
    return pos.withColumn("density", F.avg("dilated").over(after)).withColumn("next_pos", F.col("pos") + 1)


def _ends(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with density_at and map_at: what both estimates take their ends from, in the lines of ``tail``."""
    w = Window.partitionBy(key, "tail").orderBy("pos")
    rows = rows.withColumn("low", F.avg("dilated").over(w.rowsBetween(0, END_LINES - 1)) < END_DENSITY)
    stays = F.col("low")
    for k in range(1, END_RUN):
        stays = stays & F.lead("low", k).over(w)
    p = F.element_at(F.array(*map(F.lit, PROBABILITIES)), F.col("features") + 1)
    p = F.when(F.col("tail"), F.when(scalars.is_table_row(F.col("line")), F.least(p, F.lit(TABLE_MOST))).otherwise(p))
    rows = rows.withColumn("stays", stays).withColumn("p", p)
    rows = rows.withColumn("p", F.max("p").over(w.rowsBetween(-1, 1)))
    # The table's log odds are computed once, so that equal sums stay equal.
    odds = F.element_at(F.create_map(*[F.lit(x) for q in sorted({*PROBABILITIES, TABLE_MOST}) for x in (q, math.log(q / (1 - q)))]), F.col("p"))
    rows = rows.withColumn("odds", F.sum(odds).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.when(F.col("tail"), F.struct("odds", (-F.col("pos")).alias("p")))
    return rows.withColumn("density_at", F.when(F.col("tail") & F.col("stays"), F.col("start_char"))).withColumn("map_at", best)


def has_hint(raw: Column) -> Column:
    """Whether a text holds the words of a heading; never null."""
    return F.coalesce(raw.rlike(HINT), F.lit(False))


def unknown(key: Column) -> list[Column]:
    """The row of ``detect`` for a document without a heading."""
    return [key, *[F.lit(None).cast("long").alias(c) for c in ("start_char", "end_char", "density_end_char", "map_end_char")], F.lit(None).cast("string").alias("heading"), F.lit("REGION_UNKNOWN").alias("status")]


def detect(docs: DataFrame, key: str = "paper_id", raw: str = "raw") -> DataFrame:
    """One row per document: key, start_char, end_char, density_end_char, map_end_char, heading, status."""
    return detect_hinted(docs.where(has_hint(F.col(raw))), key, raw).unionByName(docs.where(~has_hint(F.col(raw))).select(*unknown(F.col(key))))


def detect_hinted(docs: DataFrame, key: str = "paper_id", raw: str = "raw") -> DataFrame:
    """``detect`` for documents that hold the words of a heading: all windows and sums over one order of lines."""
    size = docs.select(F.col(key), F.length(raw).alias("size"), F.col(raw).alias("__raw"))
    lines = _heads(lines_of(size, key, "__raw"), key)
    dense = start_densities(positions(lines, key), key)
    dense = dense.withColumn("heads", F.when((F.col("density") >= START_DENSITY) & (F.size("heads") > 0), F.col("heads")))
    one = Window.partitionBy(key)
    first = F.when(F.col("heads").isNotNull(), F.struct(F.col("heads")[0]["heading_start"].alias("heading_start"), F.col("heads")[0]["heading"].alias("heading"), F.col("next_pos").alias("next_pos")))
    dense = dense.withColumn("h", F.min(first).over(one)).withColumn("n", F.sum(F.when(F.col("heads").isNotNull(), F.size("heads"))).over(one))
    dense = dense.withColumn("spread", F.max(F.element_at("heads", -1)["heading_start"]).over(one) - F.col("h.heading_start"))
    many = (F.col("n") >= MANY_HEADINGS) & (F.col("spread") >= MANY_SPREAD * F.col("size"))
    dense = dense.withColumn("many", F.coalesce(many, F.lit(False)))
    dense = dense.withColumn("tail", F.coalesce(~F.col("many") & (F.col("pos") >= F.col("h.next_pos")), F.lit(False)))
    line_end = F.col("start_char") + F.length("line")
    found = _ends(dense, key).groupBy(key).agg(
        F.first("size").alias("size"), F.first("h").alias("h"), F.first("many").alias("many"), F.min("density_at").alias("density_end_char"), F.max_by(line_end, "map_at").alias("map_end_char")
    )
    start = F.when(~F.col("many"), F.col("h.heading_start"))
    by_density = F.when(start.isNotNull(), F.coalesce("density_end_char", "size"))
    by_map = F.when(start.isNotNull(), F.coalesce("map_end_char", "size"))
    end = F.greatest(F.least(by_density, by_map), start)
    apart = F.abs(by_density - by_map) > DIVERGENCE * F.greatest(F.lit(1), end - start)
    status = F.when(F.col("many"), "REGION_MODEL_INAPPLICABLE").when(start.isNull(), "REGION_UNKNOWN").when(apart, "REGION_END_UNCERTAIN").otherwise("IN_REFERENCE_REGION")
    return found.select(
        key,
        start.cast("long").alias("start_char"),
        F.when(start.isNotNull(), end).cast("long").alias("end_char"),
        F.greatest(by_density, start).cast("long").alias("density_end_char"),
        F.greatest(by_map, start).cast("long").alias("map_end_char"),
        F.when(start.isNotNull(), F.col("h.heading")).alias("heading"),
        status.alias("status"),
    )


def classify(offset: Column, region: Column) -> Column:
    """The label of a raw offset against a region (a struct as ``detect`` makes it)."""
    known = region["start_char"].isNotNull()
    furthest = F.greatest(region["density_end_char"], region["map_end_char"])
    return (
        F.when(region["status"].isin("REGION_UNKNOWN", "REGION_MODEL_INAPPLICABLE") | ~known, F.coalesce(region["status"], F.lit("REGION_UNKNOWN")))
        .when(offset.isNull(), region["status"])
        .when(offset < region["start_char"], "OUTSIDE_REFERENCE_REGION")
        .when(offset < region["end_char"], "IN_REFERENCE_REGION")
        .when(offset < furthest, "IN_REFERENCE_REGION_UNCERTAIN")
        .otherwise("OUTSIDE_REFERENCE_REGION")
    )
