import math
import random

from pyspark.sql import functions as F

from rubicost.llm import impact_index


def brute(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def check(spark, rows, k=10, **options):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = {tuple(r) for r in impact_index.top_k(df, F.col("vec_id") % 100 == 0, k, shards=3, **options).collect()}
    rounded = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert got == brute(rounded, k)


def test_against_brute_force(spark):
    rng = random.Random(1)
    check(spark, [(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(600)])


def test_clustered_ties_and_repeats(spark):
    rng = random.Random(2)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(3)]
    rows = [(i, [x + rng.choice((0, 0.25)) for x in centre[i % 3]]) for i in range(350)]
    check(spark, rows)
    check(spark, [(i, [0.5, -0.5]) for i in range(205)])


def test_odd_vectors(spark):
    rows = [(0, [0.1, 0.2]), (1, None), (2, [None, 0.3]), (3, [float("nan"), 0.1]), (4, [float("inf"), 0.1]), (100, [0.0, 0.0]), (5, [-0.3, 0.9]), (None, [0.1, 0.1])]
    check(spark, rows)
    # empty vectors score 0, alone and among others
    check(spark, [(0, []), (1, []), (100, [])])
    check(spark, [(0, []), (1, [0.5]), (2, [-0.5, 0.25]), (100, [0.25])])
    assert impact_index.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0
