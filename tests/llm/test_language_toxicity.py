"""Language identification and toxicity: held-out accuracy, and defined results for odd rows."""

import collections
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from quillspark.llm import language, toxicity
from quillspark.llm.common import held_out, read_table


def test_held_out_rows(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_backoff():
    cost = [[1.0, 5.0], [5.0, 1.0]]
    grams = [{} for _ in range(6)]
    grams[2] = {" t": cost[0], " q": cost[1]}
    grams[1] = {"z": cost[1]}
    m = language.Model(["a", "b"], {"the": cost[0]}, grams)
    assert m.cost("the") == cost[0]
    assert m.cost("tx")[0] < m.cost("tx")[1] and m.cost("z")[1] < m.cost("z")[0]
    assert m.cost("ö") == [language.ABSENT] * 2
    s = language.Scorer(m)
    assert s.predict("The the") == ("a", s.predict("the the")[1]) and s.predict("12 !")[0] == "und"


def test_language_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_against_plain_counts(spark, small):
    docs = read_table(spark, small, "documents")
    learnt = language._sample(docs.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id"))), language.MAX_ROWS).collect()
    langs = sorted({r.lang for r in learnt})
    words, grams = ({x: collections.Counter() for x in langs} for _ in range(2))
    for r in learnt:
        words[r.lang].update(w for w in re.split(r"[\W\d_]+", r.text.lower()) if w)
    for x in langs:
        for w, n in words[x].items():
            for k in range(1, 6):
                t = w if k == 1 else f" {w} "
                for i in range(len(t) - k + 1):
                    grams[x][t[i : i + k]] += n
    totals = {(x, k): sum(n for g, n in grams[x].items() if len(g) == k) for x in langs for k in range(1, 6)}
    keep_w = {x: {w: -math.log10(n / sum(words[x].values())) for w, n in words[x].items() if n >= language.LEAST_WORD * sum(words[x].values())} for x in langs}
    keep_g = {x: {g: -math.log10(n / totals[x, len(g)]) for g, n in grams[x].items() if n >= language.LEAST_GRAM * totals[x, len(g)]} for x in langs}

    def cost(w):
        if any(w in keep_w[x] for x in langs):
            return [keep_w[x].get(w, language.ABSENT) for x in langs]
        for k in range(5, 0, -1):
            t = w if k == 1 else f" {w} "
            some = [t[i : i + k] for i in range(len(t) - k + 1) if any(t[i : i + k] in keep_g[x] for x in langs)]
            if some:
                return [sum(keep_g[x].get(g, language.ABSENT) for g in some) / len(some) for x in langs]
        return [language.ABSENT] * len(langs)

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in language.identify(docs).collect():
        own = [w for w in re.split(r"[\W\d_]+", (texts[r.doc_id] or "").lower()) if w]
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        mean = [sum(c) / len(own) for c in zip(*map(cost, own))]
        best = min(range(len(langs)), key=lambda i: (mean[i], langs[i]))
        odds = sum(10 ** (-(m - mean[best]) * min(len(own), language.CERTAIN_WORDS)) for m in mean)
        assert r.lang_pred == langs[best] or min(abs(mean[best] - m) for i, m in enumerate(mean) if i != best) < 1e-5
        assert abs(r.score - 1 / odds) < 1e-3


def test_language_of_odd_rows(spark, odd_docs):
    rows = language.identify(odd_docs).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5, 6))
    assert by[7].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows)
    assert language.identify(odd_docs.limit(0)).collect() == []
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_language_does_not_read_ids_or_labels(spark, odd_docs):
    other = odd_docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, language.identify(d).where("doc_id IS NOT NULL").collect()), key=str) for d in (odd_docs, other))
    assert a == b


def test_keep_identified(spark, odd_docs):
    kept = language.keep_identified(odd_docs)
    rows = kept.collect()
    assert kept.columns == odd_docs.columns and {3, 4, 5, 6}.isdisjoint({r.doc_id for r in rows}) and all(r.lang for r in rows)
    # What no language learnt here has: another script, held out of learning by its null lang.
    greek = odd_docs.where("doc_id = 9").withColumn("doc_id", F.lit(77).cast("long")).withColumn("text", F.lit("Στην αρχή ήταν ο λόγος και ο λόγος"))
    assert 77 not in {r.doc_id for r in language.keep_identified(odd_docs.unionByName(greek)).collect()}
    only = language.keep_identified(odd_docs, languages={"de"}).collect()
    assert only and {r.lang for r in only} == {"de"} and language.keep_identified(odd_docs.limit(0)).collect() == []


def test_grammar():
    m = toxicity.Machine(toxicity.Grammar({"lowei": 5.0}))
    assert m.insult("loweiung") == 5.0 and m.insult("idiot") > 0 and m.insult("idiotic") == 0
    plain, aimed, negated, said = (m.features(t) for t in ("what an idiot", "you are an idiot", "he is not an idiot", 'they said the man is an idiot'))
    assert plain[0] and aimed[1] and negated[2] and said[3]
    assert m.features("I will kill you")[4] == 1 and m.features("he said I will kill you")[4] == 0 and m.features("kill the lights")[4] == 0
    assert m.score("you idiot, you moron, you scum") > m.score("a calm day") and m.score(None) == m.score("")


def plain_clauses(grammar, text):
    """What the grammar says, read off the words without states."""
    out = []
    quoted = False
    for line in (text or "").lower().split("\n"):
        quoted = False
        for part in re.split(r"[.!?;:]", line):
            words, within = [], []
            for m in re.finditer(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]", part):
                if m.group() in "\"“”„«»":
                    quoted = not quoted
                else:
                    words.append(m.group())
                    within.append(quoted)
            x = [0.0] * 5
            match = False
            for i, w in enumerate(words):
                near = lambda kind, n: any(v in kind for v in words[max(0, i - n) : i])  # noqa: E731, B023
                said, no = any(v in toxicity.SAYING_SET for v in words[:i]) or within[i], near(toxicity.NEGATION_SET, toxicity.NEGATED)
                own = grammar.patterns.get(w + "$", next((grammar.patterns[w[:n]] for n in range(len(w), 0, -1) if w[:n] in grammar.patterns), 0.0))
                if own:
                    x[3 if said else 2 if no else 1 if near(toxicity.PERSON_SET, toxicity.AIMED) else 0] += min(own, toxicity.MOST_WEIGHT) / toxicity.MOST_WEIGHT
                met = w in toxicity.THREAT_SET and near(toxicity.PERSON_SET, toxicity.NEAR) or w in toxicity.PERSON_SET and near(toxicity.THREAT_SET, toxicity.NEAR)
                x[4] += bool(met and not said and not no)
                match = match or bool(own) or bool(met and not said and not no)
            if match:
                out.append(x)
    return out


def test_composition_against_plain_reading():
    rng = random.Random(6)
    grammar = toxicity.Grammar({"lowei": 5.0, "kil": 2.0, "mud$": 3.0})
    machine = toxicity.Machine(grammar)
    words = ["idiot", "loweiung", "kill", "you", "he", "not", "never", "said", "wrote", "mud", "the", "day", "was", "don't", "hurt", '"', '"', ".", ";", "\n"]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))
        got, want = machine.clauses(text), plain_clauses(grammar, text)
        assert len(got) == len(want) and all(abs(a - b) < 1e-9 for x, y in zip(got, want) for a, b in zip(x, y)), text
        w, best, total = grammar.weights[1:], 0.0, 0.0
        scores = [float(w @ x) for x in want]
        best, total = max(scores, default=0.0), min(sum(s for s in scores if s > 0), toxicity.MOST_SUM)
        z = grammar.clauses @ [1, best, total]
        assert abs(machine.score(text) - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_against_plain_reading(spark, small):
    docs, labels = read_table(spark, small, "documents"), read_table(spark, small, "labels")
    grammar = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = toxicity.detect(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        scores = [float(grammar.weights[1:] @ x) for x in plain_clauses(grammar, texts[r.doc_id])]
        z = grammar.clauses @ [1, max(scores, default=0.0), min(sum(s for s in scores if s > 0), toxicity.MOST_SUM)]
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.7), r.doc_id


def test_patterns_against_plain_counts(spark):
    toxic = [f"they are zorgling zorglish zorgles number {i} and blarg" for i in range(40)]
    clean = [f"a calm day number {i} by the river" for i in range(200)]
    texts = list(enumerate(toxic + clean))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i < 40)) for i, _ in texts], "doc_id long, quality int, toxic int")
    learnt = [(t, i < 40) for i, t in texts if zlib.crc32(str(i).encode()) % 3 != 1]
    counts = {}
    for t, bad in learnt:
        own = {x for w in set(re.findall(r"[a-z]+", t)) if len(w) >= 3 for x in (w + "$", *(w[:n] for n in toxicity.STEMS if len(w) > n))}
        for x in own:
            counts.setdefault(x, [0, 0])[0 if bad else 1] += 1
    n_bad, n_good = sum(b for _, b in learnt), sum(not b for _, b in learnt)
    rows = [(x, a, b) for x, (a, b) in counts.items() if a >= 3 and a / n_bad > 4 * b / n_good]
    want = toxicity.choose(rows, n_bad, n_good)
    grammar = toxicity.fit(docs, labels)
    assert want and {k: v for k, v in grammar.patterns.items() if k in want} == want and set(grammar.patterns) == set(want) | {f"{w}$" for w in toxicity.INSULT_SET}


def test_stems_count_once_in_a_text(spark):
    texts = [(" ".join(f"grumble{c}" for c in "abcdefgh"), 1)] * 29 + [("grumbles grumbling calmly", 0)] * 7 + [("", 0), (None, 0)]
    counts = {r.term: (r.a, r.b) for r in toxicity.stem_counts(spark.createDataFrame(texts, "text string, toxic int")).collect()}
    assert counts["grum"] == counts["grumbl"] == (29, 7) and counts["grumblea$"] == (29, 0) and counts["calmly$"] == (0, 7)
    assert all(a <= 29 and b <= 9 for a, b in counts.values())


def test_the_sample_has_a_bound(spark):
    hot = next(k for k in range(5, 50) if zlib.crc32(str(k).encode()) % 3 != 1)
    docs = spark.createDataFrame([(hot, f"text number {i}") for i in range(500)] + [(k, "same text") for k in range(50, 300)] + [(hot, "same text")] * 400, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, int(k == hot)) for k in range(5, 300)], "doc_id long, quality int, toxic int")
    rows = toxicity._sample(docs, labels, 40).collect()
    assert len(rows) <= 40 and {r.toxic for r in rows} == {0, 1} and len({r.text for r in rows if r.toxic}) == sum(r.toxic for r in rows)
    model = language._sample(docs.withColumn("lang", F.lit("en")), 30).collect()
    assert 0 < len(model) <= 30 and len({r.text for r in model}) == len(model)


def test_copies_do_not_empty_the_sample(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 400, F.concat(F.lit("text "), F.col("id").cast("string"))).otherwise("one text").alias("text"), F.lit("en").alias("lang"))
    assert language._sample(rows, 150).count() == 150


def test_patterns():
    rows = [("lowei", 60, 0), ("loweiung", 20, 0), ("loweiung$", 20, 0), ("low", 60, 0), ("the$", 90, 880), ("idiot$", 50, 0), ("idiot", 51, 0), ("rare$", 1, 0)]
    kept = toxicity.choose(rows, 100, 1000)
    assert "lowei" in kept and "the$" not in kept and "rare$" not in kept and "loweiung" not in kept and "low" not in kept


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    got = toxicity.detect(docs, labels).join(labels, "doc_id").where("held_out")
    r = got.agg(F.sum("predicted").alias("p"), F.sum("toxic").alias("t"), F.sum(F.col("predicted") * F.col("toxic")).alias("b")).first()
    assert r.b / r.p > 0.95 and r.b / r.t > 0.8


def test_toxicity_of_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 1, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.detect(odd_docs, labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert toxicity.detect(odd_docs.limit(0), labels).collect() == []
    assert len(toxicity.detect(odd_docs, labels.limit(0)).collect()) == 12
