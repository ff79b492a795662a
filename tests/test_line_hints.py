"""Lines are searched for a feature only where they hold what its matches hold; features are the same."""

import random

from pyspark.sql import functions as F

from quillspark.functions import scalars
from quillspark.operators import region


def test_features_by_hints(spark):
    """Each token and its neighbours, and random lines of the same pieces, against the patterns alone."""
    rng = random.Random(4)
    parts = ["pp. 7", "pp.", "vol.", "no.", "no. 3", "et al.", "doi", "10.1234/", "10.12/", "In:", "In Proc", "Proceedings", "Journal", "arXiv", "LNCS", "http://", "https://", "http:/", "IEEE", "ACM", "Springer", "Ed.", "Eds.", "Ed", "Press", "Conference", "Workshop", "Symposium", "Trans.", "Trans", "pages 3", "pages"]
    parts += ["1899", "1799", "2049", "2050", "11999", "é1999", "1999é", "[12]", "[1234]", "12. A", "1. B", "1.b", "A. ", "A.,", "éA. ", "AB. ", " ", "  ", "  ", "\t", "word", "٣", "[1] Smith, J. Journal 1999.", "", None]
    lines = parts + ["".join(rng.choice(parts) or "" for _ in range(rng.randint(1, 4))) for _ in range(1500)]
    want = F.lit(0)
    for pattern in scalars.LINE_FEATURES:
        want = want + F.col("line").rlike("(?U)" + pattern).cast("int")
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", want.alias("want"), scalars.feature_count(F.col("line")).alias("got")).collect()
    assert [r for r in rows if r.got != r.want] == []
    assert {r.got for r in rows} > {0, 1, 2, 3, 4}


def test_long_patterns_wait(spark):
    """Every pattern of word bounds or branches stands behind a test for a literal or one run of classes."""
    docs = spark.createDataFrame([(1, "a\nb")], "paper_id long, raw string")
    plan = region.lines_of(docs).select("features")._jdf.queryExecution().optimizedPlan().toString()
    assert scalars.LINE_FEATURES[1] not in plan and all(hint in plan for hint in scalars.LINE_HINTS.values())
