"""The reference-list model against a self-written loop over lines."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scalars
from quillspark.operators import region as r

BODY = "\n".join(["A plain line of the body without any mark of it"] * 30)
ENTRY = "[{k}] Smith, J., A title. Journal of Things, 1999.\nthat goes on over a second line\nand a third"
LIST = "\n".join(ENTRY.format(k=k) for k in range(1, 10))
TAIL = "\n".join(["and then the words of the appendix went on"] * 30)


def detect(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "paper_id int, raw string")
    return [x for x in r.detect(df).orderBy("paper_id").collect()]


def test_a_paper(spark):
    text = f"{BODY}\nReferences\n{LIST}\n{TAIL}"
    got = detect(spark, text)[0]
    assert got.start_char == text.index("References") and got.heading == "References"
    # The end is the smaller of two estimates; the other one takes in the last entry.
    assert got.start_char < got.end_char <= text.index(TAIL) + 200
    assert text.index("[9]") < max(got.density_end_char, got.map_end_char) <= text.index(TAIL) + 200


@pytest.mark.parametrize("heading", ["REFERENCES", "\fReferences", "R EFERENCES", "R E F E R E N C E S", "7. References", "IV References", "Bibliography", "Literature Cited", "Works Cited", "of a column  References"])
def test_headings(spark, heading):
    assert detect(spark, f"{BODY}\n{heading}\n{LIST}")[0].start_char is not None


@pytest.mark.parametrize("heading", ["see the “references” here", "References to the standard", "Reference format", "References ..... 12", "Referencesx", "the references", "References are numbered"])
def test_rejected(spark, heading):
    assert detect(spark, f"{BODY}\n{heading}\n{LIST}")[0].status == "REGION_UNKNOWN"


def test_no_list_and_no_text(spark):
    got = detect(spark, f"{BODY}\nReferences\n{BODY}", "", "\n\n", None)
    assert [g.status for g in got] == ["REGION_UNKNOWN"] * 4


def test_monograph(spark):
    chapter = f"{BODY}\nReferences\n{LIST}\n{TAIL}\n{BODY}\n"
    assert detect(spark, chapter * 3)[0].status == "REGION_MODEL_INAPPLICABLE"


def test_labels(spark):
    df = spark.createDataFrame([(10, 20, 20, 30, "REGION_END_UNCERTAIN"), (None, None, None, None, "REGION_UNKNOWN")], "start_char long, end_char long, density_end_char long, map_end_char long, status string")
    rows = df.select([r.classify(F.lit(x), F.struct(*df.columns)) for x in (5, 10, 20, 30)]).collect()
    assert list(rows[0]) == ["OUTSIDE_REFERENCE_REGION", "IN_REFERENCE_REGION", "IN_REFERENCE_REGION_UNCERTAIN", "OUTSIDE_REFERENCE_REGION"]
    assert set(rows[1]) == {"REGION_UNKNOWN"}
    assert df.select(r.classify(F.lit(None).cast("int"), F.struct(*df.columns))).collect()[0][0] == "REGION_END_UNCERTAIN"


def plain_ends(text, start_line):
    """The two ends by loops over lines, written apart from the plan."""
    lines, at = text.split("\n"), [0]
    for x in lines:
        at.append(at[-1] + len(x) + 1)
    rows = [i for i, x in enumerate(lines) if x.strip()]
    n = [sum(bool(re.search(p, lines[i])) for p in scalars.LINE_FEATURES) for i in rows]
    near = lambda v, k, f: f(v[max(0, k - 1) : k + 2])
    on = [near([x > 0 for x in n], k, max) for k in range(len(n))]
    first = rows.index(start_line) + 1
    low = [sum(on[k : k + 25]) / len(on[k : k + 25]) < 0.34 for k in range(first, len(rows))]
    run = next((first + k for k in range(len(low) - 2) if all(low[k : k + 3])), None)
    p = [r.PROBABILITIES[x] for x in n[first:]]
    total, sums = 0.0, []
    for k in range(len(p)):
        q = near(p, k, max)
        total += math.log(q / (1 - q))
        sums.append(total)
    best = first + sums.index(max(sums)) if sums else None
    return (at[rows[run]] if run is not None else len(text)), (at[rows[best]] + len(lines[rows[best]]) if best is not None else len(text))


def test_ends_against_loops(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        entries = "\n".join(ENTRY.format(k=k) if rng.random() < 0.9 else "a line that has nothing of it" for k in range(1, rng.randrange(10, 30)))
        tail = "\n".join(rng.choice(["plain words of it", "in 1999 there was", "", "12. Another of them"]) for _ in range(rng.randrange(0, 80)))
        texts.append(f"{BODY}\nReferences\n{entries}\n{tail}")
    for text, got in zip(texts, detect(spark, *texts)):
        if got.start_char is not None:
            assert plain_ends(text, text[: got.start_char].count("\n")) == (got.density_end_char, got.map_end_char)
