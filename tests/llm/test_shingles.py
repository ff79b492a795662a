"""Near duplicates of the pipeline against all pairs of five-word shingle sets."""

import random

from quillspark.llm import pipeline, shingles, simhash


def kept(spark, texts):
    df = spark.createDataFrame(list(texts), "doc_id long, text string")
    return sorted((r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, df, "").collect())


def plain(texts):
    """One of each group that all pairs of 0.8 or more link."""
    sets = [shingles.shingle_set(t) for _, t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and shingles.similarity(sets[i], sets[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    groups = {}
    for (i, t), k in zip(texts, label):
        groups[k] = min(groups.get(k, (i, t)), (i, t))
    return sorted(groups.values())


def test_scattered_changes(spark):
    rng = random.Random(3)
    texts = []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts.append((2 * k, " ".join(words)))
        for at in rng.sample(range(300), 5):
            words[at] = "other"
        texts.append((2 * k + 1, " ".join(words)))
    far = [(simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 5 for (_, a), (_, b) in zip(texts[::2], texts[1::2])]
    assert any(far)
    got = kept(spark, texts)
    assert got == plain(texts) and len(got) == 60


def test_a_repeated_line_links_nothing(spark):
    line = "this one line is said over again in each text now\n" * 40
    texts = [(i, line + " ".join(f"own{i}x{k}" for k in range(60))) for i in range(5)]
    a, b = (simhash.fingerprint(t) for _, t in texts[:2])
    assert (a ^ b).bit_count() <= 5
    assert kept(spark, texts) == texts


def test_rows_that_share_an_id(spark):
    texts = [(1, "one text of this id that stands here alone"), (1, "quite another text has the same id as it"), (1, "quite another text has the same id as it"), (2, "one text, of this id that stands here ALONE")]
    assert kept(spark, texts) == texts[:2]


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert kept(spark, texts) == plain(texts)


def test_recall_just_above_the_threshold(spark):
    """Long texts at a similarity of 0.80 to 0.83, each with one partner, against plain comparison."""
    rng = random.Random(7)
    texts, want = [], 0
    for k in range(150):
        n = rng.randint(300, 1200)
        words = [f"v{rng.randrange(9000)}" for _ in range(n)]
        other = list(words)
        for at in range(n // 90, n, 46 + k % 5):
            other[at] = f"other{k}"
        pair = [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        want += 0.8 <= shingles.similarity(*(shingles.shingle_set(t) for _, t in pair)) < 0.84
        texts += pair
    got = {i for i, _ in kept(spark, texts)}
    assert want > 120 and sum(2 * k + 1 not in got for k in range(150)) >= 0.99 * want
    assert all(2 * k in got for k in range(150))


def one_group_and_others(rng, k, others):
    """``k`` near copies in one group, and texts that are each just less than near copies of all of these."""
    base = [f"u{rng.randrange(9000)}" for _ in range(300)]

    def changed(i, places):
        words = list(base)
        for at in places:
            words[at] = f"x{i}y{at}"
        return i, " ".join(words)

    texts = [changed(i, [195 + i]) for i in range(k)]
    return texts + [changed(k + j, range((6 + 7 * j) % 31, 186, 31)) for j in range(others)]


def joined_by_key(spark, after):
    """Rows that joins by a bucket's key have made in executions later than ``after``, and the last execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, rows, last = store.executionsList(), 0, after
    for i in range(runs.size()):
        run = runs.apply(i).executionId()
        last = max(last, run)
        if run <= after:
            continue
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            if "Join" in node.name() and "[key#" in node.desc():
                for m in range(node.metrics().size()):
                    metric = node.metrics().apply(m)
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        rows += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return rows, last


def test_a_large_group_is_not_met_with_itself(spark, monkeypatch):
    texts = one_group_and_others(random.Random(11), 100, 4)
    sizes, real = [], shingles.materialise

    def counted(df, name, *more):
        out = real(df, name, *more)
        if name == "shingle-apart":
            sizes.append([out.count(), out.select("key").distinct().count()])
        if name == "shingle-candidates":
            sizes[-1].append(out.where("a IS NOT NULL").count())
        return out

    monkeypatch.setattr(shingles, "materialise", counted)
    _, before = joined_by_key(spark, -1)
    assert kept(spark, texts) == plain(texts) == texts[:1] + texts[100:]
    joined, _ = joined_by_key(spark, before)
    # A bucket's rows are joined by its key once a round, beside one row for each of its keys.
    assert len(sizes) > 1 and 0 < joined <= sum(rows + keys for rows, keys, _ in sizes)
    # Only the four others look for candidates: one, then eight times as many a round.
    assert all(found <= keys * 4 * 8**i for i, (_, keys, found) in enumerate(sizes))


def test_large_buckets_in_parts(spark, monkeypatch):
    rng = random.Random(12)
    texts = one_group_and_others(rng, 60, 20) + [(100 + i, t) for i, t in one_group_and_others(rng, 30, 1)]
    want = plain(texts)
    for part in (7, 16):
        monkeypatch.setattr(shingles, "PART", part)
        assert kept(spark, texts) == want


def test_parts_of_buckets_meet_all_pairs(spark, monkeypatch):
    """Each node beside the largest group meets each other node of its bucket in one cell, or its own part's for hubs."""
    monkeypatch.setattr(shingles, "PART", 5)
    rows = [(1, n, 0 if n < 23 else n, 35, 0, 12, None, b"") for n in range(35)]
    buckets = spark.createDataFrame(rows, "key long, node long, label long, nodes long, main long, others long, failed array<long>, sketch binary")
    cells = {}
    for r in shingles._dealt(buckets, False).collect():
        cells.setdefault(r.cell, ([], []))
        cells[r.cell][0].extend([r.node] * r.asks)
        cells[r.cell][1].extend([r.node] * r.held)
    met = sorted((a, b) for asks, held in cells.values() for a in asks for b in held)
    assert met == [(a, b) for a in range(23, 35) for b in range(35)]
    assert all(len(asks) < 12 and len(held) < 35 for asks, held in cells.values())
    hubs = shingles._dealt(buckets, True).collect()
    assert sorted(r.node for r in hubs if r.held) == list(range(35)) and [r.node for r in sorted(hubs, key=lambda r: r.node) if r.asks] == list(range(23, 35))
