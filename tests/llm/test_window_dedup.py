import hashlib
import random

from rubicost.llm import window_dedup as wd
from rubicost.llm.common import words_of
from tests.llm.data import odd_documents, words


def brute(rows, width):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(i, first.get(g, i))
    out = set()
    for i, t in rows:
        w = words_of(t)
        gone = {p for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.add((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    passages = [words(rng, n, 9000) for n in (49, 50, 51, 80, 130)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randrange(0, 60), 9000)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), words(rng, rng.randrange(0, 30), 9000)]
        rows.append((i, " ".join(x for p in parts for x in p)))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, " ".join(passages[4] * 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in wd.removal(df).collect()} == brute(rows, 50)
    assert {tuple(r) for r in wd.removal(df, 6).collect()} == brute(rows, 6)


def test_intervals_are_maximal():
    assert wd.intervals([3, 0, 1, 10], 5) == [(0, 8), (10, 15)]
    assert wd.intervals([], 5) == []


def test_odd_rows(spark):
    for extra in (False, True):
        docs = odd_documents(spark, extra)
        got = wd.removal(docs)
        assert got.count() == docs.count()
        rows = {r["doc_id"]: r for r in got.where("doc_id IS NOT NULL").collect()}
        assert rows[1]["n_removed"] == 120 and rows[0]["n_removed"] == 0 and rows[3]["n_words"] == 0
        assert {r["n_removed"] for r in got.where("doc_id IS NULL").collect()} == {0, 120}
    assert wd.removal(docs.limit(0)).count() == 0
