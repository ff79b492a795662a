import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empties, repeats, very long words and columns whose names clash."""
    long_text = "the of and is " * 6000
    rows = [
        (1, "The harvest of the valley was good and the mill was still.", "en"),
        (2, "The harvest of the valley was good and the mill was still.", "en"),
        (2, "The harvest of the valley was good and the mill was still.", "en"),
        (3, None, "en"),
        (4, "", None),
        (5, "   \n\t ", "de"),
        (6, "12345 67890 !!", "de"),
        (7, long_text, "en"),
        (None, "Der Fluss und die Mühle sind an der Straße.", "de"),
        (9, "Der Fluss und die Mühle sind an der Straße nicht weit.", None),
        (10, "x" * 50_000, "fr"),
        (11, "le la les une dans avec pour", "fr"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = ("score", "fp", "key", "label", "hash", "words", "starts", "component_id", "n_words", "batch", "held_out", "c0", "ids", "part", "toxic", "__found")
    df = df.withColumns({n: F.lit("extra") for n in names})
    return df.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
