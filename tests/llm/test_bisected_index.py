import math
import random
import re

import numpy as np

from rubicost.llm import bisected_index as bi
from tests.llm.data import odd_documents, words


def brute(rows, items, k=10):
    def terms(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"(?:[0-9a-zA-Z]|[^\x00-\x7f])+", text)

    docs = [(i, terms(t)) for i, t in rows]
    count, total = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, asked in wanted.items():
        scores = []
        for doc_id, t in docs:
            m = 10 + 90 * len(t) * count // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in asked & set(t))
            if s and doc_id is not None:
                scores.append((-s, doc_id))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def check(spark, rows, items, k=10, shard=20, width=1, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in bi.search(bi.build(docs, shard=shard, **options), asked, k, width).collect())
    assert got == brute(rows, items, k)


def corpus(seed):
    rng = random.Random(seed)
    topics = [words(rng, 40, 3000) for _ in range(6)]
    common = [f"the{i}" for i in range(5)]
    rows = [(i, " ".join(rng.choice(topics[i % 6] if rng.random() < 0.6 else common) for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(60)]
    return rows, [(i, " ".join(rng.sample(topics[i % 6], 5) + ["the1", "absent"])) for i in range(12)]


def test_against_brute_force(spark):
    rows, items = corpus(1)
    check(spark, rows, items)
    check(spark, rows, items, k=3, sample=50, depth=5)
    check(spark, rows[:7], items)


def test_shards_are_left_out_by_proof(spark, monkeypatch):
    rows, items = corpus(2)
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    seen = []
    whole = bi.visit
    monkeypatch.setattr(bi, "visit", lambda blocks, queries, k: seen.append((queries.count(), blocks.count())) or whole(blocks, queries, k))
    got = sorted(tuple(r) for r in bi.search(bi.build(docs, shard=20), asked, 3, 1).collect())
    assert got == brute(rows, items, 3)
    assert sum(n for n, _ in seen) < 0.8 * len(items) * seen[0][1]


def test_bisection_puts_alike_documents_together():
    rng = random.Random(3)
    topics = [words(rng, 30, 10**6) for _ in range(4)]
    sample = [sorted(set(rng.choice(topics[i % 4]) for _ in range(25))) for i in range(400)]
    features = {t: i for i, t in enumerate(sorted({t for terms in sample for t in terms}))}
    known = [np.array([features[t] for t in terms]) for terms in sample]
    tree = bi.fit(known, features, 2)
    cluster = tree.route(np.concatenate(known), np.repeat(np.arange(400), [len(x) for x in known]), 400)
    pure = sum(max(np.bincount(np.arange(400)[cluster == c] % 4)) for c in set(cluster.tolist()))
    assert pure >= 380


def test_odd_rows(spark):
    items = [(1, "Words that one w1 w2 Ünïcode ünïcode"), (1, "mail w3"), (2, None), (3, ""), (4, "absent"), (None, "w1"), (5, "w5"), (5, "w5")]
    for extra in (False, True):
        docs = odd_documents(spark, extra)
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS shard", "'x' AS t")
        got = sorted(tuple(r) for r in bi.search(bi.build(docs, shard=3), asked).collect())
        assert got == brute(rows, items)
    assert bi.search(bi.build(docs.limit(0)), asked).count() == 0
    assert bi.search(bi.build(docs), asked.limit(0)).count() == 0


def test_repeated_rows_and_ties(spark):
    check(spark, [(5, "one two")] * 50 + [(i, "two one") for i in range(30)] + [(None, "one")], [(1, "one"), (2, "two")], shard=4)
