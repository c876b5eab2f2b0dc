import random

from pyspark.sql import functions as F

from rubicost.operators.dyadic import contained, pieces
from rubicost.operators.links import followed


def brute(links):
    to = {}
    for s, t in links:
        if s is not None and t is not None:
            to[s] = min(t, to.get(s, t))
    out = set()
    for s in to:
        at, n, seen = s, 0, {s}
        while at in to:
            at, n = to[at], n + 1
            if at in seen:
                at = n = None
                break
            seen.add(at)
        out.add((s, at, n))
    return out


def check(spark, links):
    got = [tuple(r) for r in followed(spark.createDataFrame(links, "source string, target string")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(links)


def test_chains_of_a_thousand_and_cycles(spark):
    chain = [(f"a{i}", f"a{i + 1}") for i in range(1000)]
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [(f"into{i}", f"into{i - 1}" if i else "r3") for i in range(20)] + [("self", "self")]
    check(spark, chain + ring + [("a5", "a2000"), (None, "x"), ("x", None), ("y", "x"), ("y", "x")])


def test_random_links(spark):
    rng = random.Random(15)
    check(spark, [(f"n{i}", f"n{rng.randrange(300)}") for i in range(200)])
    check(spark, [("a", "b")])
    assert followed(spark.createDataFrame([], "source string, target string")).count() == 0


def test_pieces_cover_a_range_once(spark):
    rng = random.Random(16)
    spans = [(a, a + rng.randrange(200)) for a in (rng.randrange(500) for _ in range(60))] + [(5, 4), (0, 0), (0, 2**31 - 1), (7, 7)]
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", pieces(F.col("a"), F.col("b")).alias("p"))
    for r in df.collect():
        held = sorted((p["node"] << p["level"], (p["node"] + 1) << p["level"]) for p in r["p"])
        assert len(held) <= 62
        assert (not held) == (r["a"] > r["b"])
        if held:
            assert held[0][0] == r["a"] and held[-1][1] == r["b"] + 1 and all(x[1] == y[0] for x, y in zip(held, held[1:], strict=False))


def test_cells_in_ranges_against_brute_force(spark):
    rng = random.Random(17)
    ranges = [(s, f"r{i}", a, a + rng.choice((0, 3, 400)), b, b + rng.randrange(6)) for i in range(150) for s, a, b in [(rng.randrange(2), rng.randrange(500), rng.randrange(12))]] + [(0, "none", None, 5, 1, 2), (0, "back", 9, 3, 1, 2)]
    cells = [(rng.randrange(3), rng.randrange(900), rng.randrange(20)) for _ in range(400)] + [(0, None, 3)]
    want = sorted((*c, r[1]) for c in cells for r in ranges if c[0] == r[0] and None not in (*c, *r) and r[2] <= c[1] <= r[3] and r[4] <= c[2] <= r[5])
    r = spark.createDataFrame(ranges, "sheet int, name string, r1 int, r2 int, c1 int, c2 int")
    c = spark.createDataFrame(cells, "sheet int, row int, col int")
    found = contained(c, r, ["sheet"], [("row", "r1", "r2"), ("col", "c1", "c2")])
    assert sorted((x["sheet"], x["row"], x["col"], x["name"]) for x in found.collect()) == want
    one = contained(c, r, ["sheet"], [("row", "r1", "r2")])
    assert one.count() == sum(x[0] == y[0] and None not in (x[1], y[2]) and y[2] <= x[1] <= y[3] for x in cells for y in ranges)


def test_one_sheet_with_many_ranges_joins_by_equality(spark):
    r = spark.range(100_000).select(F.lit(1).alias("sheet"), F.col("id").alias("name"), (F.col("id") * 9).alias("r1"), (F.col("id") * 9 + 8).alias("r2"))
    c = spark.range(1_000_000).select(F.lit(1).alias("sheet"), F.col("id").alias("row"))
    found = contained(c, r, ["sheet"], [("row", "r1", "r2")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.agg(F.count("*"), F.sum(F.col("name"))).first() == (900_000, sum(i // 9 for i in range(900_000)))
