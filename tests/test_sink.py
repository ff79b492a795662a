"""One file of a list: order over partitions, bytes, and what a failed write leaves."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.sources import sink


def numbers(spark, n, parts):
    return spark.range(n).repartitionByRange(parts, "id").sortWithinPartitions("id").select(F.col("id").cast("string").alias("n"))


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_order_and_bytes(spark, tmp_path, parts):
    path = tmp_path / "list.json"
    sink.write_list(numbers(spark, 300, parts), path, "[", ",\n", "]\n")
    assert path.read_text() == "[" + ",\n".join(map(str, range(300))) + "]\n"
    assert os.listdir(tmp_path) == ["list.json"]
    sink.write_list(numbers(spark, 3, 2), path, "[", ", ", "]")
    assert json.loads(path.read_text()) == [0, 1, 2]


def test_no_rows(spark, tmp_path):
    path = tmp_path / "list.txt"
    sink.write_list(numbers(spark, 0, 2), path, "head ", ",", " tail", "nothing")
    assert path.read_text() == "head nothing"
    sink.write_list(numbers(spark, 1, 8).where("n <> '0'"), path, "head ", ",", " tail")
    assert path.read_text() == "head  tail"


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("as it was")
    broken = numbers(spark, 100, 4).withColumn("n", F.when(F.col("n") == "77", F.raise_error(F.lit("broken row"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="broken row|aborted"):
        sink.write_list(broken, path)
    assert path.read_text() == "as it was" and os.listdir(tmp_path) == ["list.txt"]


def test_texts_are_kept(spark, tmp_path):
    texts = ["é\nü", "", 'q"', "\r\n"]
    path = tmp_path / "odd [1].txt"
    sink.write_list(spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1), path, between="|")
    assert path.read_bytes().decode() == "|".join(texts)
