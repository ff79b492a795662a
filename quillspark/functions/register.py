"""The engine's functions for SQL: scalar functions over text, and a table function for markers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import anchor, markers, normalise

ANCHOR = T.StructType(
    [
        T.StructField("tier", T.StringType()),
        T.StructField("offset_norm", T.IntegerType()),
        T.StructField("length_norm", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("diff", T.StringType()),
        T.StructField("scorer", T.StringType()),
    ]
)


class MarkerSpans:
    """Rows (start, stop, marker) of the citation markers of a text."""

    def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
        for a, b in markers.marker_spans(text or ""):
            yield a, b, text[a:b]


def register(spark: SparkSession) -> None:
    """normalise_text, match_form, locate and marker_spans for ``spark.sql``."""

    @F.pandas_udf(T.StringType())
    def match_form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else normalise.match_form(t))

    @F.pandas_udf(ANCHOR)
    def locate(documents: pd.Series, quotes: pd.Series) -> pd.DataFrame:
        found = [anchor.locate(d or "", q or "") for d, q in zip(documents, quotes)]
        return pd.DataFrame([(a.tier, a.offset, a.length, a.score, a.diff, a.scorer) for a in found], columns=ANCHOR.names).astype({"offset_norm": "Int32", "length_norm": "Int32"})

    spark.udf.register("normalise_text", normalise.norm_text_udf())
    spark.udf.register("match_form", match_form)
    spark.udf.register("locate_quote", locate)
    spark.udtf.register("marker_spans", F.udtf(MarkerSpans, returnType="start int, stop int, marker string"))
