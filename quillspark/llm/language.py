"""Language identification by words first, then by ever shorter character n-grams.

The model holds, for each language, the log frequency of its most frequent words and of the
n-grams of its words. A word that the model knows is scored by its frequencies; a word it does
not know is scored by its longest n-grams of which one is known, down to single characters. A
text's language has the best mean over all its words.

Fitting reads a bounded sample: ``max_rows`` labelled rows at most, as many of each language, in
the order of a hash of the text, each text once. What the model keeps is the sample's words and
n-grams of a frequency of ``LEAST_WORD`` and ``LEAST_GRAM`` or more, so their number has a bound. Prediction reads whole texts.

An empty table gives no rows. A text that is null or has no letter gets ``und`` and the score 0, and so does every text when
no labelled row is there to learn from. Ties go to the language whose name sorts first. Repeated
rows are predicted alike. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.llm.common import arrow_task, bound_batches, held_out, materialise, pick, place_of

MAX_ROWS = 24_000
#: Share of a language's words, and of its n-grams of one length, below which one is left to backoff.
LEAST_WORD, LEAST_GRAM = 4e-6, 5e-5
LONGEST = 5
#: Minus log10 of the frequency that stands for what a language does not have.
ABSENT = 7.0
UNKNOWN = "und"
#: Mean cost from which on a text is in none of the languages: nearly all of it is what none of them has.
FOREIGN = 6.5
#: Words from which on more words no longer raise the score, and its steepness.
CERTAIN_WORDS, STEEPNESS = 24, 1.0
CACHE_BYTES = 12 << 20

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    words = _WORD.findall((text or "").lower())
    if not any(map(str.isalpha, words)):
        words = [w for w in words if any(map(str.isalpha, w))]
    return words


class Model:
    """Costs of words and n-grams: minus log10 of their frequency in each language."""

    def __init__(self, langs: list[str], words: dict[str, list[float]], grams: list[dict[str, list[float]]]):
        self.langs, self.grams = langs, grams
        # Words are many: their costs are rows of one array.
        self.words = {w: k for k, w in enumerate(words)}
        self.costs = np.array(list(words.values()), np.float32).reshape(len(words), len(langs))
        self.none = [ABSENT] * len(langs)

    def cost(self, word: str) -> list[float]:
        known = self.words.get(word)
        if known is not None:
            return self.costs[known].tolist()
        padded = f" {word} "
        for n in range(min(LONGEST, len(padded)), 0, -1):
            # The word's edges are part of longer n-grams; alone they say nothing.
            table, text = self.grams[n], padded if n > 1 else word
            found = [table.get(text[i : i + n]) for i in range(len(text) - n + 1)]
            if any(f is not None for f in found):
                rows = [f if f is not None else self.none for f in found]
                return [sum(costs) / len(rows) for costs in zip(*rows)]
        return self.none


class Scorer:
    """Applies a model; costs of words met before are kept, up to a bound of bytes."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.rows = np.empty((1024, max(1, len(model.langs))), np.float32)
        self.most = max(4096, CACHE_BYTES // (4 * self.rows.shape[1] + 120))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, mean cost of the words in it)."""
        words, langs = words_of(text), self.model.langs
        if not words or not langs:
            return UNKNOWN, 0.0, ABSENT
        new = set(words).difference(self.at)
        if len(self.at) + len(new) > self.most:
            self.at, new = {}, set(words)
        for w in new:
            k = self.at[w] = len(self.at)
            if k >= len(self.rows):
                self.rows = np.resize(self.rows, (2 * len(self.rows), self.rows.shape[1]))
            self.rows[k] = self.model.cost(w)
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        mean = np.zeros(len(langs))
        for a in range(0, len(at), 65536):
            mean += self.rows[at[a : a + 65536]].sum(axis=0, dtype=np.float64)
        mean /= len(at)
        best = int(np.argmin(mean))
        odds = np.exp(-(mean - mean[best]) * math.log(10) * STEEPNESS * min(len(at), CERTAIN_WORDS))
        return langs[best], float(1 / odds.sum()), float(mean[best])


def _sample(rows: DataFrame, max_rows: int) -> DataFrame | None:
    """(text, lang) of at most ``max_rows`` rows, as many of each language; a text of a language counts once."""
    # Of different texts: a text may have any number of copies, and the margin below covers the estimate.
    sizes = {r[0]: max(1, r[1]) for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02)).collect()}
    if not sizes:
        return None
    own = max(1, max_rows // len(sizes))
    # Few hashes of each language go through the choice: twice as many as are wanted, in expectation.
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2 * own / n))])
    hashed = rows.select("text", "lang", F.xxhash64("text").alias("h")).where(F.pmod("h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = hashed.select("lang", "h").distinct().withColumn("nth", nth).where(F.col("nth") <= own).select("lang", "h")
    # The choice has a bound, so it may be sent to every executor and the texts stay in place.
    chosen = materialise(chosen, "language-rows", max_rows)
    sample = hashed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    return materialise(sample.select("text", "lang"), "language-sample", max_rows)


def fit(docs: DataFrame, usable: Column | None = None, max_rows: int = MAX_ROWS) -> Model:
    """The model of the labelled rows (columns text, lang); ``usable`` says which may be learnt from."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows if usable is None else rows.where(usable)
    sample = _sample(rows, max_rows)
    langs = [] if sample is None else sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not langs:
        return Model([], {}, [{} for _ in range(LONGEST + 1)])
    counted = (
        sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
        .where("word <> ''")
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counted = materialise(counted, "language-words")
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    runs = [F.regexp_extract_all("word" if n == 1 else padded, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, LONGEST + 1)]
    grams = counted.select("lang", "n", F.explode(F.flatten(F.array(*runs))).alias("gram"))
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("size", F.length("gram"))
    totals = {r[0]: r[1] for r in counted.groupBy("lang").agg(F.sum("n")).collect()}
    grams = materialise(grams, "language-grams")
    gram_totals = {(r[0], r[1]): r[2] for r in grams.groupBy("lang", "size").agg(F.sum("n")).collect()}

    words: dict[str, list[float]] = {}
    least = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, n * LEAST_WORD)])[F.col("lang")]
    for lang, word, n in (counted.where(F.col("n") >= least).select("lang", "word", "n").collect() if totals else ()):
        words.setdefault(word, [ABSENT] * len(langs))[langs.index(lang)] = -math.log10(n / totals[lang])
    tables: list[dict[str, list[float]]] = [{} for _ in range(LONGEST + 1)]
    least = F.create_map(*[F.lit(x) for (k, z), n in gram_totals.items() for x in (f"{z} {k}", n * LEAST_GRAM)]) if gram_totals else None
    for lang, size, gram, n in (grams.where(F.col("n") >= least[F.concat_ws(" ", F.col("size").cast("string"), "lang")]).select("lang", "size", "gram", "n").collect() if gram_totals else ()):
        tables[size].setdefault(gram, [ABSENT] * len(langs))[langs.index(lang)] = -math.log10(n / gram_totals[lang, size])
    return Model(langs, words, tables)


def identify(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, by a model fitted on these documents."""
    bound_batches(docs.sparkSession)
    docs = pick(docs, "doc_id", "text", "lang")
    model = fit(docs, ~held_out(F.col("doc_id")), max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            found = [scorer.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(arrow_task(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5, max_rows: int = MAX_ROWS, languages: Collection[str] | None = None) -> DataFrame:
    """The rows of ``docs`` in a known language, with a score of ``least`` or more; same columns.

    Texts without letters, in doubt between languages, or in none of those learnt are left out, and
    so are all but ``languages`` where they are given. A kept row whose lang is null gets the one
    that was found. Null and empty texts go, repeated rows are kept or go alike, an empty table gives
    none, and other columns are passed on, whatever their names.
    """
    bound_batches(docs.sparkSession)
    own = pick(docs, "doc_id", "text", "lang")
    model = fit(own, ~held_out(F.col("doc_id")), max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at, label = place_of(docs, "text"), place_of(docs, "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            found = [scorer.judge(t.as_py()) for t in b.column(at)]
            good = [lang != UNKNOWN and score >= least and cost < FOREIGN and (languages is None or lang in languages) for lang, score, cost in found]
            columns = list(b.columns)
            columns[label] = pc.coalesce(b.column(label), pa.array([f[0] for f in found], b.column(label).type))
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(good, pa.bool_()))

    frame = docs.toDF(*names)
    return frame.mapInArrow(arrow_task(run), frame.schema).toDF(*docs.columns)
