import random
from collections import Counter

from pyspark.sql import functions as F

from rubicost.operators.consensus import ratio_consensus

BASES = ["labour", "material", "total"]


def brute(rows):
    groups = {}
    for g, value, *bases in rows:
        groups.setdefault(g, []).append((value, bases))
    out = set()
    for g, rs in groups.items():
        n = sum(v is not None for v, _ in rs)
        votes = Counter((i, round(v / b[i] + 1e-12, 4)) for v, b in rs if v is not None for i in range(3) if b[i])
        best = min(votes, key=lambda x: (-votes[x], x), default=None)
        ok = best is not None and votes[best] >= max(2, 0.5 * n)
        base = BASES[best[0]] if ok else "labour" if g and "social" in g else "total"
        out.add((g, base, best[1] if ok else None, n, votes[best] if best else 0, ok))
    return out


def test_planted_bases_are_recovered(spark):
    rng = random.Random(20)
    rows, planted = [], {}
    for g in range(40):
        base, pct = rng.randrange(3), rng.choice((0.05, 0.1, 0.2359, 0.07))
        planted[f"g{g}"] = (BASES[base], pct)
        for _ in range(12):
            labour, material = round(rng.uniform(50, 900), 2), round(rng.uniform(50, 900), 2)
            values = [labour, material, labour + material]
            value = values[base] * pct if rng.random() < 0.75 else rng.uniform(1, 99)
            rows.append((f"g{g}", value, *values))
    # labour alone: the narrower of two bases that explain the same; noise; nothing to vote; a null group
    rows += [("both", x * 0.1, x, 0.0, x) for x in (100.0, 230.0, 55.0)] + [("social tax", rng.uniform(1, 9), 7.0, 3.0, 10.0) for _ in range(3)] + [("none", None, 1.0, 1.0, 2.0), ("zero", 4.0, 0.0, None, 0.0), (None, 1.0, 10.0, 20.0, 30.0), (None, 2.0, 20.0, 30.0, 50.0)]
    df = spark.createDataFrame(rows, "g string, value double, labour double, material double, total double")
    by_name = F.when(F.col("g").contains("social"), F.lit("labour"))
    got = ratio_consensus(df, ["g"], "value", BASES, by_name).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == 45
    found = {r["g"]: (r["base"], r["pct"]) for r in got}
    assert all(found[g] == x for g, x in planted.items()) and found["both"] == ("labour", 0.1) and found["zero"] == ("total", None)
