"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read the words of a clause from left to right and are composed into one machine,
once for each worker; each reads a symbol with the marks of those before it. Reported speech marks
what follows a word of saying or stands in quotation marks; negation marks a few words after a
negating one; target marks a few words after a word for a person; threat marks a verb of harm near
a person, where neither is denied or reported; insult gives a word the weight of the longest
pattern of a lexicon that accepts it, a whole word or a stem. The marks of an arc say what its weight
counts as. A clause's score is the sum of its arcs' weights, and a logistic function of a document's
greatest clause score and of the sum of its clause scores is the document's.

Patterns and weights are fitted on a bounded sample of labelled rows: ``max_rows`` at most, toxic
ones up to half of it, chosen in the order of a hash of id and text, each text of an id once. A
pattern is kept where a likelihood-ratio test says that its documents are toxic more often. Without
toxic labels the fixed words below stand alone.

Null and empty texts have no clause and get the score of no match. Texts are read whole.
Repeated labels of an id count as toxic if one is. Repeated documents are scored alike. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_task, bound_batches, held_out, materialise, pick

MAX_ROWS = 12_000
THRESHOLD = 0.7
STEMS = (3, 4, 5, 6, 7)
CACHE = 200_000

# Words of the grammar.
INSULTS = "idiot idiots moron morons stupid imbecile loser scum trash worthless pathetic disgusting clown vermin"
THREATS = "kill hurt destroy beat stab shoot strangle burn töten verletzen tuer blesser matar herir"
PERSONS = "you your yours he she they them him her people du dich dir ihr sie er tu te toi vous il elle ils tú ti usted ustedes él ella ellos"
NEGATIONS = "not no never without isn't aren't wasn't don't nicht kein keine niemals ne pas jamais sans nunca jamás sin"
SAYING = "said says wrote called calls claimed quoted reported sagte schrieb nannte dit écrit appelé dijo escribió llamó"

INSULT_SET, THREAT_SET, PERSON_SET, NEGATION_SET, SAYING_SET = (frozenset(x.split()) for x in (INSULTS, THREATS, PERSONS, NEGATIONS, SAYING))
#: Words that a span of negation, of a target and of a threat reaches over after the word itself.
NEGATED, AIMED, NEAR = 3, 4, 3
#: Log odds of a fixed word that no label speaks of, and the most a pattern may weigh.
SEED_WEIGHT, MOST_WEIGHT = 4.0, 8.0

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(r"([^\W\d_]+(?:'[^\W\d_]+)?)|([.!?;:\n])|([\"“”„«»])")

#: bias, plain, aimed, negated, reported, threats
DEFAULT = np.array([-3.0, 1.2, 1.4, 0.3, 0.3, 2.0])
#: bias, greatest clause, sum of clauses; and the most such a sum counts
CLAUSES = np.array([-3.0, 0.5, 0.5])
MOST_SUM = 12.0


#: Classes of words as bits of an input symbol, and the symbols that are no words.
INSULT, THREAT, PERSON, NEGATION, SAYING = (1 << k for k in range(5))
QUOTE, STOP, LINE = 32, 33, 34
SYMBOLS = range(35)
#: Marks that transducers put on a symbol.
REPORTED, NEGATED_MARK, AIMED_MARK, THREATENED = (1 << k for k in range(4))
#: What a matched arc counts as.
NOTHING, PLAIN, AT_PERSON, DENIED, SAID = -1, 0, 1, 2, 3
THREATS_AT = 4


class Transducer:
    """A finite-state transducer: ``step`` maps (state, symbol, marks so far) to (state, marks it adds)."""

    def __init__(self, start: object, step: Callable[[object, int, int], tuple[object, int]]):
        self.start, self.step = start, step


def _is(symbol: int, kind: int) -> bool:
    return symbol < QUOTE and bool(symbol & kind)


def reported_speech() -> Transducer:
    """Marks what follows a word of saying up to the clause's end, and what stands in quotation marks of a line."""

    def step(state: tuple[bool, bool], symbol: int, marks: int) -> tuple[tuple[bool, bool], int]:
        said, quoted = state
        if symbol == QUOTE:
            return (said, not quoted), 0
        if symbol in (STOP, LINE):
            return (False, quoted and symbol == STOP), 0
        return (said or _is(symbol, SAYING), quoted), REPORTED if said or quoted else 0

    return Transducer((False, False), step)


def _reach(kind: int, words: int, mark: int) -> Transducer:
    """Marks the ``words`` words after one of a kind."""

    def step(left: int, symbol: int, marks: int) -> tuple[int, int]:
        if symbol == QUOTE:
            return left, 0
        if symbol in (STOP, LINE):
            return 0, 0
        return words if _is(symbol, kind) else max(0, left - 1), mark if left else 0

    return Transducer(0, step)


def negation() -> Transducer:
    return _reach(NEGATION, NEGATED, NEGATED_MARK)


def target() -> Transducer:
    return _reach(PERSON, AIMED, AIMED_MARK)


def threat() -> Transducer:
    """Marks a verb of harm near a person, where neither is denied or reported."""

    def step(state: tuple[int, int], symbol: int, marks: int) -> tuple[tuple[int, int], int]:
        verb, person = state
        if symbol == QUOTE:
            return state, 0
        if symbol in (STOP, LINE):
            return (0, 0), 0
        met = _is(symbol, THREAT) and person or _is(symbol, PERSON) and verb
        after = (NEAR if _is(symbol, THREAT) else max(0, verb - 1), NEAR if _is(symbol, PERSON) else max(0, person - 1))
        return after, THREATENED if met and not marks & (REPORTED | NEGATED_MARK) else 0

    return Transducer((0, 0), step)


def insult() -> Transducer:
    """The last of the chain: it has no state, and its arcs read a lexicon's weights."""
    return Transducer(None, lambda state, symbol, marks: (None, 0))


class Composed:
    """The composition of transducers as one table: each reads the symbol and the marks of those before it."""

    def __init__(self, *parts: Transducer):
        self.parts = parts
        start = tuple(p.start for p in parts)
        number, todo = {start: 0}, [start]
        self.next: list[list[int]] = []
        self.marks: list[list[int]] = []
        while todo:
            state = todo.pop(0)
            arcs, marks = [], []
            for symbol in SYMBOLS:
                after, found = [], 0
                for part, own in zip(parts, state):
                    to, mark = part.step(own, symbol, found)
                    after.append(to)
                    found |= mark
                to = tuple(after)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                arcs.append(number[to])
                marks.append(found)
            self.next.append(arcs)
            self.marks.append(marks)
        #: What an insult counts as under each set of marks.
        self.kind = [SAID if m & REPORTED else DENIED if m & NEGATED_MARK else AT_PERSON if m & AIMED_MARK else PLAIN for m in range(16)]


def grammar_machine() -> Composed:
    return Composed(reported_speech(), negation(), target(), threat(), insult())


class Grammar:
    """The lexicon of the insult transducer, the weights of arcs, and those of clauses in a document.

    A clause's score is the sum of its arcs' weights; a document's is a logistic function of its
    greatest clause score and of the sum of all that are above 0.
    """

    def __init__(self, patterns: dict[str, float] | None = None, weights: np.ndarray = DEFAULT, clauses: np.ndarray = CLAUSES):
        #: "word$" accepts the word alone, "stem" accepts what begins with it.
        self.patterns = {f"{w}$": SEED_WEIGHT for w in sorted(INSULT_SET)} | (patterns or {})
        self.weights, self.clauses = weights, clauses
        self.sizes = sorted({len(p) for p in self.patterns if p[-1] != "$"}, reverse=True)


class Machine:
    """The composed grammar of one worker; weights and symbols of words met before are kept."""

    def __init__(self, grammar: Grammar, composed: Composed | None = None):
        self.grammar, self.composed, self.known = grammar, composed or grammar_machine(), {}

    def lexicon(self, word: str) -> tuple[int, float]:
        """(symbol, weight) of a word."""
        found = self.known.get(word)
        if found is None:
            own = self.grammar.patterns
            weight = own.get(word + "$")
            if weight is None:
                weight = next((own[word[:n]] for n in self.grammar.sizes if len(word) >= n and word[:n] in own), 0.0)
            symbol = sum(bit for bit, words in ((THREAT, THREAT_SET), (PERSON, PERSON_SET), (NEGATION, NEGATION_SET), (SAYING, SAYING_SET)) if word in words)
            found = (symbol | (INSULT if weight else 0), weight)
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = found
        return found

    def insult(self, word: str) -> float:
        return self.lexicon(word)[1]

    def clauses(self, text: str | None) -> list[list[float]]:
        """For each clause with a match, the sums of its insults' weights by kind, and its threats."""
        text = (text or "").lower()
        if not any(self.lexicon(w)[0] & (INSULT | THREAT) for w in set(_WORD.findall(text))):
            return []
        arcs, marks, kinds = self.composed.next, self.composed.marks, self.composed.kind
        out: list[list[float]] = []
        state, clause = 0, None
        for m in _TOKEN.finditer(text):
            word, stop, quote = m.groups()
            if word:
                symbol, weight = self.lexicon(word)
                found = marks[state][symbol]
                if weight or found & THREATENED:
                    if clause is None:
                        clause = [0.0] * 5
                        out.append(clause)
                    if weight:
                        clause[kinds[found]] += min(weight, MOST_WEIGHT) / MOST_WEIGHT
                    if found & THREATENED:
                        clause[THREATS_AT] += 1
            elif quote:
                symbol = QUOTE
            else:
                symbol, clause = LINE if stop == "\n" else STOP, None
            state = arcs[state][symbol]
        return out

    def features(self, text: str | None) -> np.ndarray:
        """The sums over a document's clauses."""
        return np.sum(self.clauses(text), axis=0) if self.clauses(text) else np.zeros(5)

    def summary(self, clauses: list[list[float]]) -> tuple[float, float]:
        """The greatest clause score, and the sum of all that are above 0."""
        w = self.grammar.weights[1:].tolist()
        scores = [sum(a * b for a, b in zip(w, x)) for x in clauses]
        return max(scores, default=0.0), min(sum(s for s in scores if s > 0), MOST_SUM)

    def score(self, text: str | None) -> float:
        most, total = self.summary(self.clauses(text))
        bias, of_most, of_sum = self.grammar.clauses
        return _logistic(float(bias + of_most * most + of_sum * total))


def _logistic(z: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def choose(rows: list[tuple[str, int, int]], toxic: int, clean: int, tried: int | None = None) -> dict[str, float]:
    """Patterns with weights from (pattern, toxic documents, clean documents)."""

    def ratio(a: int, b: int) -> float:
        n, p = a + b, toxic / (toxic + clean)
        return 2 * sum(x * math.log(x / (n * q)) for x, q in ((a, p), (b, 1 - p)) if x)

    # The level grows with the number of patterns tried, so that chance finds next to none.
    level = 2 * math.log(max(tried or len(rows), 2)) + 4
    good = {r[0]: (r[1], r[2]) for r in rows if r[1] / toxic > 4 * r[2] / clean and ratio(r[1], r[2]) > level}
    longer: dict[str, int] = {}  # the most toxic documents of a pattern that a stem begins
    for q, (a, _) in good.items():
        for n in STEMS:
            if n < len(q):
                longer[q[:n]] = max(a, longer.get(q[:n], 0))
    kept: dict[str, float] = {}
    for p in sorted(good, key=lambda p: (-ratio(*good[p]), -len(p), p)):
        a, b = good[p]
        stem = p.rstrip("$")
        wider = [stem[:n] for n in STEMS if n < len(p) and stem[:n] in good]
        # A stem speaks for its words where it finds clearly more and is as pure.
        if any(good[w][0] > 1.15 * a and good[w][1] * a <= 1.5 * (b + 0.2) * good[w][0] for w in wider):
            continue
        # A longer pattern that finds nearly as much is the more careful one.
        if p[-1] != "$" and longer.get(p, 0) >= 0.87 * a:
            continue
        kept[p] = min(MOST_WEIGHT, math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)))
    return kept


def _regress(x: np.ndarray, y: np.ndarray, towards: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards the default weights."""
    a = np.hstack([np.ones((len(x), 1)), x])
    pull = np.full(a.shape[1], ridge)
    pull[0] = 0.01
    w = towards.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull), a.T @ (y - p) - pull * (w - towards))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    # None weighs below 0.
    w[1:] = np.maximum(w[1:], 0)
    return w


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame | None:
    """(text, toxic) of at most ``max_rows`` labelled rows that are not held out."""
    marks = pick(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    n_toxic = sizes.get(1, 0)
    n_clean = sum(sizes.values()) - n_toxic
    if not n_toxic or not n_clean:
        return None
    take = {True: min(n_toxic, max_rows // 2)}
    take[False] = min(n_clean, max_rows - take[True])

    def first(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
        """The first hashes of each class, as many as are taken; of large classes twice as many, in expectation, are put in order."""
        parts = []
        for toxic, n in sizes.items():
            own = rows.where(F.col("toxic") == toxic).where(F.pmod("h", F.lit(1_000_003)) < min(1.0, 2 * take[bool(toxic)] / max(1, n)) * 1_000_003)
            parts.append(own.orderBy("h").limit(take[bool(toxic)]))
        return parts[0].unionByName(parts[1])

    # The sample has a bound, so it may be sent to every executor and the texts stay in place. An id
    # may have many rows, so their hashes are chosen before any text moves.
    marks = marks.select("doc_id", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"), F.xxhash64("doc_id").alias("h"))
    marks = materialise(first(marks, {1: n_toxic, 0: n_clean}).drop("h"), "toxicity-ids")
    rows = pick(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(marks), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "text", "toxic")
    hashes = materialise(rows.select("h", "toxic").distinct(), "toxicity-hashes")
    sizes = {0: 0, 1: 0} | {r[0]: r[1] for r in hashes.groupBy("toxic").count().collect()}
    chosen = materialise(first(hashes, sizes), "toxicity-rows")
    sample = rows.join(F.broadcast(chosen.select("h")), "h").groupBy("h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return materialise(sample.select("text", "toxic"), "toxicity-sample")


def stem_counts(sample: DataFrame) -> DataFrame:
    """(term, a, b): in how many toxic and other rows (text, toxic) a word or stem stands. It counts once
    in a row, however many of its words are there."""
    # The words that the machine reads, apostrophes inside of them included.
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:'\p{L}+)?"), F.lit(0)))
    stems = ", ".join(f"CASE WHEN length(w) > {n} THEN substring(w, 1, {n}) END" for n in STEMS)
    terms = F.expr(f"array_compact(array_distinct(flatten(transform(filter(words, w -> length(w) >= 3), w -> array(concat(w, '$'), {stems})))))")
    one = sample.select("toxic", words.alias("words")).select("toxic", F.explode(terms).alias("term"))
    return one.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") != 1).alias("b"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Grammar:
    """The grammar learnt from rows that are not held out; see the module's text for the bound."""
    bound_batches(docs.sparkSession)
    sample = _sample(docs, labels, max_rows)
    sizes = {} if sample is None else {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Grammar()
    counts = stem_counts(sample)
    counts = materialise(counts.where("a >= 3").where(F.col("a") / n_toxic > 4 * F.col("b") / n_clean), "toxicity-terms")
    # What no test could keep stays where it is: the ratio is at most that of no clean document.
    least = 2 * math.log((n_toxic + n_clean) / n_toxic)
    tried = counts.count()
    rows = [tuple(r) for r in counts.where(F.col("a") * least > 2 * math.log(max(tried, 2)) + 4).collect()]
    shared = docs.sparkSession.sparkContext.broadcast(Grammar(choose(rows, n_toxic, n_clean, tried)))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(shared.value)
        for b in batches:
            found = [machine.clauses(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([np.ravel(x) for x in found], pa.list_(pa.float64()))], ["y", "clauses"])

    # As many rows as the sample has, of numbers for clauses with a match.
    found = sample.mapInArrow(arrow_task(matched), "y int, clauses array<double>").collect()
    y = np.array([r.y == 1 for r in found], float)
    clauses = [np.array(r.clauses, float).reshape(-1, 5) for r in found]
    grammar = shared.value
    w = _regress(np.array([np.minimum(c.sum(axis=0), 6.0) for c in clauses]).reshape(-1, 5), y, DEFAULT)
    # Marks that excuse a word never weigh more than none.
    w[3:5] = np.minimum(w[3:5], w[1])
    grammar.weights = w
    machine = Machine(grammar)
    grammar.clauses = _regress(np.array([machine.summary(c.tolist()) for c in clauses]).reshape(-1, 2), y, CLAUSES, ridge=0.05)
    return grammar


def score(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    bound_batches(docs.sparkSession)
    docs = pick(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(shared.value)
        for b in batches:
            scores = np.array([machine.score(t.as_py()) for t in b.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(arrow_task(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def detect(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, by a grammar fitted on these labels."""
    return score(docs, fit(docs, labels, max_rows), threshold)
