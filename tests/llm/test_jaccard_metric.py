import random

import numpy as np

from rubicost.llm import jaccard_metric as jm
from tests.llm.data import odd_documents, untouched, words


def brute(rows, size, percent):
    sets = {i: jm.shingles(t, size) for i, t in rows}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and jm.linked(sets[a], sets[b], percent):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {(i, len(s), root(i)) for i, s in sets.items()}


def edited(rng, text, n):
    out = text[:]
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def corpus(rng, groups, passage):
    rows = []
    for n in groups:
        base = words(rng, n, 5000)
        for edits in (0, 0, 1, 1, 2, 3, 4):
            rows.append(edited(rng, base, edits))
        rows.append(passage + words(rng, n, 5000))
    return list(enumerate(map(" ".join, rows)))


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = corpus(rng, [1, 2, 5, 9, 12, 15, 20, 30, 45, 60, 90, 150, 300], words(rng, 30, 5000))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jm.join(df).collect()} == brute(rows, 3, 90)
    assert {tuple(r) for r in jm.join(df, size=5, percent=80).collect()} == brute(rows, 5, 80)
    assert {tuple(r) for r in jm.join(df, size=2, percent=60).collect()} == brute(rows, 2, 60)


def test_chains_and_large_groups_meet_block_by_block(spark):
    rng = random.Random(6)
    base = words(rng, 60, 5000)
    rows = [(i, " ".join(edited(rng, base, i % 4))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jm.join(df).collect()} == brute(rows, 3, 90)
    assert {tuple(r) for r in jm.join(df, region=8, bundle=0).collect()} == brute(rows, 3, 90)
    assert {tuple(r) for r in jm.join(df, size=5, percent=80, region=8, bundle=2000).collect()} == brute(rows, 5, 80)


def test_signatures_miss_no_linked_pair():
    rng = random.Random(7)
    classes = jm.SizeClasses(90)
    for n in list(range(3, 40)) + [60, 100, 200, 400]:
        for _ in range(15):
            a = words(rng, n, 10**6)
            b = edited(rng, a, rng.randrange(3)) + words(rng, rng.randrange(3), 10**6)
            if jm.linked(jm.shingles(" ".join(a)), jm.shingles(" ".join(b)), 90):
                keys = [set(int(k) for c, x in jm.signatures(jm.shingle_hashes(" ".join(w), 3), classes) for k in jm.cell_keys(c, x, classes.slices(c)[1])) for w in (a, b)]
                assert keys[0] & keys[1] or jm.shingles(" ".join(a)) == jm.shingles(" ".join(b))


def test_odd_rows(spark):
    for extra in (False, True):
        docs = odd_documents(spark, extra)
        got = jm.join(docs)
        assert got.count() == docs.count()
        rows = {r["doc_id"]: r for r in got.where("doc_id IS NOT NULL").collect()}
        assert rows[1]["component_id"] == 0 and rows[3]["n_shingles"] == 0 and rows[3]["component_id"] == 3
        assert rows[6]["n_shingles"] == 1 and rows[4]["component_id"] == 4
        assert all(r["component_id"] is None for r in got.where("doc_id IS NULL").collect())
        kept = jm.one_of_each(docs)
        left = [r["doc_id"] for r in kept.collect()]
        assert untouched(docs, kept) and 1 not in left and left.count(0) == left.count(3) == 1 and left.count(None) == 2
    assert jm.join(docs.limit(0)).count() == 0


def test_linked_sets_name_a_cell_in_common():
    """Each names one more than linked sets of its size can differ in, at the sizes' bounds too."""
    rng = random.Random(8)
    for percent in (60, 80, 90):
        classes, shared = jm.SizeClasses(percent), 0
        for n in list(range(1, 60)) + [100, 156, 195, 400, 1000]:
            for _ in range(12):
                a = np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64)
                lost = rng.randrange(n * (100 - percent) // 100 + 1)
                more = rng.randrange(max(0, (n - lost) * 100 // percent - n) + 1)
                b = np.concatenate([a[lost:], np.array([rng.getrandbits(64) for _ in range(more)], dtype=np.uint64)])
                keys = []
                for h in (a, b):
                    keys.append({})
                    for c, x in jm.signatures(h, classes):
                        own = jm.cell_keys(c, x, classes.spare(c, len(h)))
                        assert len(own) == (len(h) + min(classes.tops[c], len(h) * 100 // percent)) * (100 - percent) // (100 + percent) + 1
                        keys[-1][c] = set(own.tolist())
                if jm.linked(set(a.tolist()), set(b.tolist()), percent) and max(len(a), len(b)) >= classes.least and (lost or more):
                    c = classes.at(max(len(a), len(b)))
                    assert keys[0][c] & keys[1][c], (percent, n, lost, more)
                    shared += 1
        assert shared > 300


def test_a_phrase_that_many_share_makes_no_cells(spark):
    """As many cells as that makes grow with the square of the documents."""
    rng = random.Random(9)
    phrase = words(rng, 7, 5000)
    rows = [(i, " ".join(phrase + [f"w{rng.getrandbits(60)}" for _ in range(rng.randrange(150, 400))])) for i in range(400)]
    scanned = jm.scan(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    # the phrase has three shingles; a slice with one of them alone was a cell of all documents where it is alone
    assert jm.with_pivots(jm.postings(scanned, 80)).count() <= 20
