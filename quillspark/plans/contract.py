"""The closed vocabulary and the shape of responses, and the check that a response keeps both."""

from __future__ import annotations

import textwrap
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Outcomes, and words that responses don't use.
OUTCOMES = ["VERBATIM_EXACT", "VERBATIM_RELAXED_EXTRACTOR_DAMAGE", "PASSAGE_RELOCATED_QUOTE_DIFFERS", "NOT_LOCATABLE", "SOURCE_NOT_HELD", "SOURCE_UNKNOWN", "CORPUS_UNAVAILABLE", "OK"]
VERBATIM = OUTCOMES[:2]
LIFTABLE = {"quote", "passage", "text", "excerpt"}
BANNED_WORDS = ["supports", "proves", "demonstrates", "confirms", "refutes", "shows that", "validates"]
OWNER_NAMES = ["attribut", "claim_owner", "claimed_by", "cited_work", "whose_claim", "source_of_claim", "belongs_to"]
#: Columns whose text is the document's, the caller's or a file's, and not this engine's.
FOREIGN = {"document_text", "your_text", "query", "char_diff", "paper_id", "also_occurs_in", "field", "detail"}
PROVENANCE = ["normaliser", "verifier", "scorer", "server"]

NOTICE = (
    "This engine tells whether a string stands at a place in a document that is held here. Whether a passage is evidence for anything, and whether a work that "
    "was never read matters, it can't tell. Only VERBATIM_EXACT and VERBATIM_RELAXED_EXTRACTOR_DAMAGE mean that the characters are the document's own."
)
SERVER = "quillspark/1"

TIER_OUTCOME = {"ANCHOR_EXACT": OUTCOMES[0], "ANCHOR_RELAXED": OUTCOMES[1], "ANCHOR_LOCATED": OUTCOMES[2], "ANCHOR_NOT_LOCATABLE": OUTCOMES[3]}


def outcome(tier: Column) -> Column:
    """The outcome of a tier; a tier without one is an error."""
    out = F.when(F.lit(False), "")
    for name, value in TIER_OUTCOME.items():
        out = out.when(tier == name, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("no outcome for tier "), tier)))


def absence(field: str, reason: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("detail"))


def _leaves(schema: T.DataType, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.DataType]]:
    if isinstance(schema, T.StructType):
        for f in schema:
            yield (*path, f.name), f.dataType
            yield from _leaves(f.dataType, (*path, f.name))
    elif isinstance(schema, T.ArrayType):
        yield from _leaves(schema.elementType, path)


def schema_faults(schema: T.StructType) -> list[str]:
    """What is wrong with the columns of a response: checked once a plan, not once a row."""
    faults = []
    for path, kind in _leaves(schema):
        name, at = path[-1], ".".join(path)
        element = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if isinstance(element, T.BooleanType):
            faults.append(f"{at} is a boolean")
        if name in LIFTABLE:
            faults.append(f"{at} could be taken for the document's words")
        if any(w in name.lower() for w in OWNER_NAMES):
            faults.append(f"{at} names the owner of a claim")
    for name in ("outcome", "interpretation_notice", "provenance", "not_available"):
        if name not in schema.names:
            faults.append(f"{name} is missing")
    if "provenance" in schema.names:
        have = schema["provenance"].dataType
        faults += [f"provenance.{k} is missing" for k in PROVENANCE if not (isinstance(have, T.StructType) and k in have.names)]
    if "char_interval" not in schema.names and "hits" not in schema.names:
        faults.append("char_interval is missing")
    return faults


def _own_texts(schema: T.StructType) -> list[Column]:
    """Expressions for the text columns that this engine wrote."""
    out = []
    for f in schema:
        if f.name in FOREIGN:
            continue
        if isinstance(f.dataType, T.StringType):
            out.append(F.col(f.name))
        elif isinstance(f.dataType, T.StructType):
            out += [F.col(f"{f.name}.{g.name}") for g in f.dataType if isinstance(g.dataType, T.StringType) and g.name not in FOREIGN]
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            names = [g.name for g in f.dataType.elementType if isinstance(g.dataType, T.StringType) and g.name not in FOREIGN]
            out += [F.array_join(F.col(f.name)[g], "\n") for g in names]
    return out


def faults(responses: DataFrame) -> DataFrame:
    """``responses`` with a column ``faults``: what is wrong with each row, an empty array if nothing."""
    written = F.concat_ws("\n", *_own_texts(responses.schema))
    bare = F.lower(F.regexp_replace(written, "|".join(sorted(VERBATIM, key=len, reverse=True)), ""))
    tests = [
        ("OUTCOME_NOT_KNOWN", ~F.coalesce(F.col("outcome").isin(OUTCOMES), F.lit(False))),
        ("NOTICE_CHANGED", ~F.col("interpretation_notice").eqNullSafe(F.lit(NOTICE))),
        ("VERBATIM_OUTSIDE_AN_OUTCOME", F.contains(bare, F.lit("verbatim"))),
        ("BANNED_WORD", F.lower(written).rlike("|".join(BANNED_WORDS))),
        ("PROVENANCE_MISSING", F.greatest(*[F.col(f"provenance.{k}").isNull() for k in PROVENANCE])),
    ]
    if "char_interval" in responses.columns:
        located = F.col("outcome").isin(OUTCOMES[:3])
        tests.append(("INTERVAL_WRONG", located != F.col("char_interval").isNotNull()))
    return responses.withColumn("faults", F.array_compact(F.array(*[F.when(test, name) for name, test in tests])))


def validate(responses: DataFrame) -> DataFrame:
    """``responses``, or an error where the contract is broken: now for columns, on reading for a row."""
    wrong = schema_faults(responses.schema)
    if wrong:
        raise ValueError("; ".join(wrong))
    checked = faults(responses)
    message = F.concat(F.lit("a response breaks the contract: "), F.array_join("faults", ", "))
    return checked.withColumn("outcome", F.when(F.size("faults") > 0, F.raise_error(message)).otherwise(F.col("outcome"))).drop("faults")


def as_json(responses: DataFrame, key: str = "quote_id") -> DataFrame:
    """(key, response): responses as JSON texts, nulls kept."""
    fields = [c for c in responses.columns if c != key]
    return responses.select(key, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("response"))


def write_json(responses: DataFrame, path: str, key: str = "quote_id") -> None:
    """Responses as a folder of JSON lines; a folder that is there already is an error."""
    responses.select(F.to_json(F.struct(key, F.struct(*[c for c in responses.columns if c != key]).alias("response")), {"ignoreNullFields": "false"})).write.mode("errorifexists").text(path)


def unavailable(asked: DataFrame, reason: str, detail: str | None, key: str = "quote_id") -> DataFrame:
    """One response per row of ``asked`` (key) that says that no corpus could be read."""
    interval = F.lit(None).cast("struct<start_pos:int,end_pos:int,basis:string>")
    provenance = F.struct(*[F.lit("not used" if k != "server" else SERVER).alias(k) for k in PROVENANCE])
    note = F.struct(F.lit("corpus").alias("field"), F.lit(reason).alias("reason"), F.lit(detail).cast("string").alias("detail"))
    out = asked.select(key, F.lit(OUTCOMES[6]).alias("outcome"), F.lit(NOTICE).alias("interpretation_notice"), interval.alias("char_interval"), F.lit(reason).alias("reason"), provenance.alias("provenance"), F.array(note).alias("not_available"))
    return validate(out)


def wrapped(text: str, width: int = 79) -> str:
    """A paragraph in lines of at most ``width`` characters."""
    return textwrap.fill(" ".join(text.split()), width)
