import random

import numpy as np
from pyspark.sql import functions as F

from rubicost.llm import jaccard_metric as jm
from rubicost.llm import minhash_dedup as mh
from tests.llm.data import odd_documents, words
from tests.llm.test_jaccard_metric import brute, corpus, edited


def check(spark, texts, size=5, percent=85, **options):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = mh.join(df, size=size, percent=percent, **options).collect()
    assert {tuple(r)[:3] for r in got} == brute(texts, size, percent) and len(got) == len(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = corpus(rng, [1, 2, 5, 6, 9, 12, 15, 20, 30, 45, 60, 90, 150, 300, 900], words(rng, 30, 5000))
    check(spark, rows)
    check(spark, rows, size=3, percent=90)


def test_members_far_from_their_hub_are_met(spark):
    """Families in one bucket of which few members are near its hub: stars alone would lose links."""
    rng = random.Random(6)
    base = words(rng, 120, 5000)
    families = [edited(rng, base, 6) for _ in range(12)]
    texts = list(enumerate(" ".join(edited(rng, rng.choice(families), rng.randrange(3))) for _ in range(120)))
    check(spark, texts)
    check(spark, texts, block=8)
    # many wide buckets
    check(spark, texts, bands=125, rows=2)


def test_signatures_estimate_similarity():
    lenders = mh.densification(mh.BANDS * mh.ROWS)
    rng = random.Random(7)
    for n in (6, 12, 40, 200, 2000, 20_000):
        a = words(rng, n, 10**6)
        b = a[:-1] + ["other"] if n < 200 else edited(rng, a, n // 100)
        sets = [jm.shingles(" ".join(x), 5) for x in (a, b)]
        x, y = (mh.signature(jm.shingle_hashes(" ".join(t), 5), lenders) for t in (a, b))
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert abs((x == y).mean() - true) < 0.15, n
    assert (mh.signature(np.array([7], dtype=np.uint64), lenders) == mh.signature(np.array([7], dtype=np.uint64), lenders)[0]).all()


def test_candidates_of_a_bucket_are_a_star(spark):
    posted = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7), (3, 4), (3, 5)], "key long, s1 long")
    met = mh.buckets(posted)
    assert met.where("s1 <> hub").count() == 49 + 1 and {r["hub"] for r in met.collect()} == {0, 4}


def test_odd_rows(spark):
    for extra in (False, True):
        docs = odd_documents(spark, extra)
        got = mh.join(docs)
        assert got.count() == docs.count()
        rows = {r["doc_id"]: r for r in got.where("doc_id IS NOT NULL").collect()}
        assert rows[1]["component_id"] == 0 and not rows[1]["kept"] and rows[3]["n_shingles"] == 0 and rows[3]["kept"]
        assert rows[6]["n_shingles"] == 1 and rows[4]["component_id"] == 4
        assert all(r["component_id"] is None and r["kept"] for r in got.where("doc_id IS NULL").collect())
    assert mh.join(docs.limit(0)).count() == 0


def test_rows_of_a_large_open_bucket_grow_with_its_members(spark):
    """Members of a bucket are one row each while two blocks hold it; sets of many bytes make more blocks, whatever their number."""
    cells = spark.range(3000).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("s1"), F.col("id").alias("label"), F.lit(0).cast("long").alias("top"), F.lit(10).alias("n"), F.lit(b"").alias("signature"))
    few = mh.met_in_blocks(mh.with_blocks(cells, F.lit(2000), mh.BLOCK))
    assert few.count() == 3000 and few.select("lo", "hi").distinct().count() == 1
    wide = mh.with_blocks(cells, F.lit(160_000), mh.BLOCK)
    blocks = -(-160_000 * 2999 // mh.VOLUME)
    assert wide.select("many", "rest").distinct().collect() == [(1, blocks)]
    met = mh.met_in_blocks(wide)
    assert met.count() == 2999 * (1 + blocks) + blocks
    # every pair of which not both are of the largest component meets
    assert met.select("lo", "hi").distinct().count() == blocks * (blocks + 1) // 2 + blocks
    assert mh.with_blocks(cells, F.lit(1), 500).select("rest").distinct().collect() == [(6,)]
