import random

from rubicost.llm import cube_mix as cm
from rubicost.llm.queries import op9_cube_mix
from tests.llm.data import odd_documents, untouched


def test_targets():
    assert cm.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = cm.targets([10, 100, 100], [5, 2, 1])
    assert got[0] == 30 and abs(sum(got) - 210) < 1e-9 and abs(got[1] - 120) < 1e-9
    assert cm.targets([0, 10], [5, 2]) == [0.0, 10.0] and cm.targets([], []) == []


def shared_out(sizes, weights, cap=3.0):
    """Targets found another way: the level at which weighted shares, each up to its cap, sum to all words."""
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (low, level) if sum(min(cap * s, level * w) for s, w in zip(sizes, weights)) > sum(sizes) else (level, high)
    return [min(cap * s, low * w) for s, w in zip(sizes, weights)]


def test_targets_by_bisection():
    rng = random.Random(22)
    for _ in range(200):
        sizes = [rng.choice((0, 1, 10, 500, 90_000)) for _ in range(rng.randrange(1, 9))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert all(abs(a - b) <= 1e-6 * max(1, b) for a, b in zip(cm.targets(sizes, weights), shared_out(sizes, weights)))


def test_equal_rows_are_parted(spark):
    rows = [(5, "a b c", "s0")] * 3000 + [(i, "w " * (i % 50 + 1), f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = cm.mix(docs, block=64).collect()
    assert len(got) == 3600 and len({r["nth"] for r in cm.sizes_of(docs).where("doc_id = 5").collect()}) >= 3000
    for s in ("s0", "s1", "s2"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 50
    blocks = cm.sizes_of(docs).selectExpr("pmod(xxhash64(doc_id, tk, nth, 0), 57) AS b").groupBy("b").count()
    assert max(r["count"] for r in blocks.collect()) < 200


def test_flight_keeps_both_totals():
    rng = random.Random(0)
    sizes = [float(rng.randrange(1, 500)) for _ in range(2000)]
    probs = [rng.random() for _ in sizes]
    out = cm.flight(sizes, probs, rng, False)
    assert sum(0 < p < 1 for p in out) <= 2
    assert abs(sum(out) - sum(probs)) < 1e-6
    assert abs(sum(p * s for p, s in zip(out, sizes)) - sum(p * s for p, s in zip(probs, sizes))) < 1e-3
    assert all(p in (0, 1) for p in cm.flight(sizes, probs, rng, True))


def test_inclusion_probabilities_hold():
    sizes, probs = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0], [0.2, 0.5, 0.7, 0.4, 0.6, 0.3]
    hits = [0.0] * 6
    for seed in range(4000):
        for i, p in enumerate(cm.flight(sizes, probs, random.Random(seed), False)):
            hits[i] += p / 4000
    assert all(abs(h - p) < 0.04 for h, p in zip(hits, probs))


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 400), f"s{i % 5}" if i % 3 else "s0") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = cm.mix(docs, block=64).collect()
    again = cm.mix(docs.repartition(7), block=64).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == 900
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 400
        assert sum(r["size"] for r in own) == own[0]["source_size"]
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    mixed = cm.mixed_documents(docs)
    assert sum(len(r["text"].split()) for r in mixed.collect()) == sum(r["taken"] for r in cm.mix(docs).collect())


def test_odd_rows(spark):
    for extra in (False, True):
        docs = odd_documents(spark, extra)
        got = cm.mix(docs)
        assert got.count() == docs.count() and {r["size"] for r in got.where("doc_id = 3").collect()} == {0}
        mixed = cm.mixed_documents(docs)
        assert untouched(docs, mixed) and mixed.schema == docs.schema
    assert cm.mix(docs.limit(0)).count() == 0


def test_contract_on_a_corpus(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = lambda i: len((docs[i]["text"] or "").encode().split())
    got = op9_cube_mix(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    names = sorted({d["source"] for d in docs.values() if d["source"] is not None}) + [None] * any(d["source"] is None for d in docs.values())
    total = {n: sum(size(i) for i, d in docs.items() if d["source"] == n) for n in names}
    want = dict(zip(names, shared_out([total[n] for n in names], [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    taken = dict.fromkeys(names, 0)
    for r in got:
        n = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size(r["doc_id"]), total[n]) and abs(r["target"] - want[n]) < 1e-6 * max(1, want[n])
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[n] += r["taken"]
    assert all(abs(taken[n] - want[n]) <= max(0.02 * want[n], max(map(size, docs))) for n in names)
