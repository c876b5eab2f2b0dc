import math
import random
import statistics
import time

from pyspark.sql import functions as F

from rubicost.functions import attributes
from rubicost.functions.attributes import parse_attributes as attributes_of
from rubicost.operators.fold import ordered_fold
from rubicost.operators.joins import asof_nearest, interval_join, knn_join, lexical_join, overlap_join
from rubicost.operators.merge import insert_absent, override, replace_groups, upsert
from rubicost.operators.statistics import exact_median
from rubicost.operators.topk import mode_first_seen, page, spread, systematic
from rubicost.plans.history import Bucket, Card, Deltas, Queue
from rubicost.plans.web import linked_price, sanitised
from rubicost.sources.files import clean_number, clean_value, listed, replace_files


def rows(df, *by):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple(str(x) for x in r))


def test_explicit_null_override_wins(spark):
    base = spark.createDataFrame([(1, 5.0, "a"), (2, 6.0, "b"), (3, 7.0, "c")], "k int, x double, y string")
    own = spark.createDataFrame([(1, ["x"], None, "z"), (2, ["y"], 9.0, "q")], "k int, fields array<string>, x double, y string")
    assert rows(override(base, own, ["k"], ["x", "y"])) == [(1, None, "a", True), (2, 6.0, "q", True), (3, 7.0, "c", False)]
    assert rows(override(base, own.limit(0), ["k"], ["x", "y"])) == [(1, 5.0, "a", False), (2, 6.0, "b", False), (3, 7.0, "c", False)]


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "edited"), (2, "exact")], "k int, s string")
    new = spark.createDataFrame([(1, "n1"), (2, "n2"), (3, "n3"), (3, "n4")], "k int, s string")
    assert rows(upsert(old, new.limit(3), ["k"], F.col("o.s") == "edited")) == [(1, "edited"), (2, "n2"), (3, "n3")]
    assert rows(insert_absent(old, new, ["k"], ["s"])) == [(1, "edited"), (2, "exact"), (3, "n3")]


def test_mode_takes_the_first_seen_of_equals(spark):
    df = spark.createDataFrame([("a", 2, 0), ("a", 2, 1), ("a", 1, 2), ("a", 1, 3), ("b", 5, 0)], "k string, v int, o int")
    assert rows(mode_first_seen(df, ["k"], "v", ["o"])) == [("a", 2, 2), ("b", 5, 1)]


def test_asof(spark):
    points = spark.createDataFrame([("a", 10.0, 1.0), ("a", 20.0, 2.0)], "k string, px double, v double")
    wanted = spark.createDataFrame([("a", 5.0), ("a", 10.0), ("a", 15.0), ("a", 25.0), ("b", 1.0)], "k string, x double")
    got = {(r["k"], r["x"]): (r["lo"], r["hi"]) for r in asof_nearest(points, ["k"], "px", "v", wanted, "x").collect()}
    assert got == {("a", 5.0): (None, 10.0), ("a", 10.0): (10.0, 10.0), ("a", 15.0): (10.0, 20.0), ("a", 25.0): (20.0, None), ("b", 1.0): (None, None)}


def test_asof_in_pieces_against_brute_force(spark):
    rng = random.Random(2)
    points = [(k, float(rng.randrange(0, 400)), float(rng.randrange(100))) for k in "ab" for _ in range(60)]
    wanted = [(k, float(rng.randrange(-20, 430))) for k in "abc" for _ in range(80)] + [("a", None), (None, 3.0)]
    p, w = spark.createDataFrame(points, "k string, px double, v double"), spark.createDataFrame(wanted, "k string, x double")
    value = {}
    for k, x, v in points:
        value[k, x] = min(v, value.get((k, x), v))
    want = []
    for k, x in wanted:
        xs = [a for c, a in value if c == k and x is not None]
        lo, hi = max((a for a in xs if a <= x), default=None), min((a for a in xs if a >= x), default=None)
        want.append((k, x, lo, value.get((k, lo)), hi, value.get((k, hi))))
    for width in (None, 7.0, 1000.0):
        assert rows(asof_nearest(p, ["k"], "px", "v", w, "x", width)) == sorted(want, key=lambda r: tuple(str(x) for x in r)), width


def test_asof_time_is_linear_in_one_key(spark):
    took = []
    for n in (10_000, 80_000):
        p = spark.range(n).selectExpr("1 AS k", "CAST(id AS DOUBLE) AS px", "CAST(id AS DOUBLE) AS v")
        w = spark.range(n).selectExpr("1 AS k", "id + 0.5D AS x")
        began = time.perf_counter()
        asof_nearest(p, ["k"], "px", "v", w, "x").write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * max(took[0], 2)


def test_interval_join_keeps_every_row(spark):
    r = spark.createDataFrame([("s", 60), ("s", 5), ("t", 5), (None, 1), ("s", None), ("s", 60)], "k string, at int")
    spans = spark.createDataFrame([("s", 0, 10, "a"), ("s", 3, 7, "b"), ("s", 90, 80, "empty")], "k string, lo int, hi int, t string")
    for size in (2, 8, 64):
        got = rows(interval_join(r, spans, ["k"], "at", "lo", "hi", size))
        assert sorted((x[0], x[1], x[4]) for x in got if x[4]) == [("s", 5, "a"), ("s", 5, "b")]
        assert len(got) == 7 and sum(x[4] is None for x in got) == 5


def test_interval_and_lexical_joins_stay_equi_joins(spark):
    r = spark.createDataFrame([("s", i) for i in range(200)], "k string, at int")
    spans = spark.createDataFrame([("s", 0, 70, "a"), ("s", 130, 131, "b")], "k string, lo int, hi int, t string")
    j = interval_join(r, spans, ["k"], "at", "lo", "hi", 64)
    assert j.where("t = 'a'").count() == 71 and j.where("t = 'b'").count() == 2
    a = spark.createDataFrame([("x1", ["cable", "3x1.5"])], "a string, toks array<string>")
    b = spark.createDataFrame([("y1", ["cable", "5x2.5"]), ("y2", ["lamp"])], "b string, toks array<string>")
    lex = lexical_join(a, b, "a", "b")
    assert [tuple(x) for x in lex.collect()] == [("x1", "y1", 2 / 6)]
    for df in (j, lex):
        plan = df._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_knn(spark):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(50)], "vec_id long, v array<double>")
    q = v.where("vec_id = 10").selectExpr("vec_id AS query_id", "v")
    got = [r["vec_id"] for r in knn_join(q, v, 3, shards=2, block=8).orderBy("rank").collect()]
    assert got[0] == 10 and len(got) == 3


def test_knn_leaves_out_what_has_no_direction(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [2.0, 2.0])], "vec_id long, v array<double>")
    got = knn_join(v.selectExpr("vec_id AS query_id", "v"), v, 2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(1, 1, 1), (1, 2, 6), (6, 1, 6), (6, 2, 7), (7, 1, 6), (7, 2, 7)]
    assert knn_join(v.limit(0).selectExpr("vec_id AS query_id", "v"), v.limit(0), 2).count() == 0


def test_prefixes_lose_no_similar_pair(spark):
    rng = random.Random(3)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.choice(['', '', '7'])}"
    sides = [[(f"{side}{i}", sorted({word() for _ in range(rng.randrange(1, 7))})) for i in range(40)] for side in "xy"]
    a, b = (spark.createDataFrame(x, "k string, toks array<string>") for x in sides)
    weight = lambda ts: sum(2.0 if "7" in t else 1.0 for t in ts)
    for least in (0.0, 0.416, 0.8, 1.0):
        want = {(i, j) for i, s in sides[0] for j, t in sides[1] if set(s) & set(t) and 2 * weight(set(s) & set(t)) / (weight(s) + weight(t)) >= least}
        assert {(r["l_key"], r["r_key"]) for r in lexical_join(a, b, "k", "k", least=least).collect()} == want
    want = {(i, j) for i, s in sides[0] for j, t in sides[1] if len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.5}
    got = overlap_join(a.selectExpr("k AS l", "toks"), b.selectExpr("k AS r", "toks"), "l", "r", "toks", "toks", 0.5)
    assert {(r["l"], r["r"]) for r in got.collect()} == want


def test_exact_median(spark):
    rng = random.Random(4)
    data = [(k, rng.choice([rng.random(), float(rng.randrange(5)), None])) for k in ("a", "b", None) for _ in range(501)] + [("c", 2.0), ("d", 1.0), ("d", 4.0), ("e", None)]
    df = spark.createDataFrame(data, "k string, v double")
    want = {}
    for k in {k for k, _ in data}:
        own = [v for c, v in data if c == k and v is not None]
        if own:
            want[k] = (len(own), statistics.median(own))
    assert {r["k"]: (r["n"], r["median"]) for r in exact_median(df, ["k"], "v").collect()} == want
    assert exact_median(df, [], "v").collect()[0]["median"] == statistics.median(v for _, v in data if v is not None)
    assert exact_median(df.limit(0), [], "v").count() == exact_median(df.limit(0), ["k"], "v").count() == 0
    large = spark.range(200_000).selectExpr("CAST(pmod(id * 7919, 200000) AS DOUBLE) AS v")
    assert exact_median(large, [], "v").collect()[0]["median"] == 99_999.5


def test_folds_are_in_order_and_by_key(spark):
    def steps():
        total = 0

        def step(x):
            nonlocal total
            total += x or 0
            return (total,)

        return step

    data = [(k, i, i % 3 if i % 5 else None) for k in ("a", None, "b") for i in range(30)]
    df = spark.createDataFrame(data, "k string, at int, x int").repartition(5)
    got = {(r["k"], r["at"]): r["total"] for r in ordered_fold(df, "k", ["at"], steps, ["k", "at"], "k string, at int, total int").collect()}
    assert got == {(k, i): sum(x or 0 for c, j, x in data if c == k and j <= i) for k, i, _ in data}
    assert ordered_fold(df.limit(0), "k", ["at"], steps, ["k", "at"], "k string, at int, total int").count() == 0


def test_groups_and_files_are_replaced(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "file_id int, x string")
    new = spark.createDataFrame([(1, "z"), (None, "m")], "file_id int, x string")
    assert rows(replace_groups(old, new, ["file_id"])) == [(1, "z"), (2, "c"), (None, "m")]
    path = str(tmp_path / "t")
    replace_files(old.where("file_id IS NOT NULL"), path)
    replace_files(new.where("file_id = 1"), path)
    assert sorted((r["file_id"], r["x"]) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]


def test_listed_files_tell_why_they_cannot_be_read(spark, tmp_path):
    for name, text in (("a.csv", "x"), ("b.XLSX", "w"), ("c.exe", "y"), ("d", "z")):
        (tmp_path / name).write_text(text)
    got = {r["name"]: (r["kind"], r["fail_reason"]) for r in listed(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": ("text", None), "b.XLSX": ("workbook", None), "c.exe": (None, "unsupported"), "d": (None, "unsupported")}
    row = spark.range(1).select(clean_value(F.lit(" \u00a0a \u00a0")).alias("a"), clean_value(F.lit(" ")).alias("b"), clean_number(F.lit(float("nan"))).alias("c")).collect()[0]
    assert (row["a"], row["b"], row["c"]) == ("a", None, None)


def test_systematic_and_page(spark):
    df = spark.createDataFrame([("s", i) for i in range(100)], "k string, i int")
    assert sorted(r["i"] for r in systematic(df, ["k"], ["i"], 7).collect()) == [int(j * 100 / 7) for j in range(7)]
    assert [r["i"] for r in page(df, [F.col("i")], 3, 2).collect()] == [3, 4]


def stepped(machine):
    """A machine as a step function that holds its state."""
    state = machine.start

    def step(*values):
        nonlocal state
        state, out = machine.step(state, *values)
        return out

    return step


def run(steps, *columns):
    return [x if len(x) > 1 else x[0] for x in map(steps, *columns)]


def test_deltas_buckets_and_cards():
    assert run(stepped(Deltas()), [20, 20, 20, 5, 1], [0, 0.01, 0.02, 0.03, 0.04], [True] * 3 + [False, True]) == [0, 0, 0, 1, 2]
    assert run(stepped(Deltas()), [1, 1, 1], [0, 0.05, 0.2], [True] * 3) == [0, 0, 0]
    assert run(stepped(Bucket(3, 10)), [0, 0, 0, 0, 10]) == [True, True, True, False, True]
    assert run(stepped(Card()), [0, 5, 6, 30, 31], ["allowed", "undo", "denied", "undo", "allowed"], [0] * 5) == [("allowed", "applied"), ("open", "undone"), ("denied", "applied"), ("denied", "ignored"), ("denied", "ignored")]
    assert run(stepped(Card()), [0, 4000], ["undo", "allowed"], [0, 0])[1] == ("expired", "ignored")
    assert run(stepped(Queue()), [0, 5, 10, 12], [10, 1, 1, 1]) == [True, False, True, True]


def test_html():
    assert linked_price(['[{"@graph":[{"@type":"Product","name":"Lamp","offers":[{"price":"12,50","priceCurrency":"EUR"}]}]}]']) == ("Lamp", "12,50", "EUR")
    assert linked_price(["{broken", '{"@type": "Thing", "offers": {"price": 1}}']) == linked_price(None) == (None, None, None)
    assert sanitised('<p onclick="x()">a<script>bad()</script><b>b</b> &lt;i&gt;</p><div>c</div>') == "<p>a<b>b</b> &lt;i&gt;</p>c"


def test_each_block_of_queries_meets_each_shard(spark):
    rng = random.Random(21)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(300)]
    rows = [(i, v) for i, v in rows if any(v)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    q = v.where("vec_id % 7 = 0").selectExpr("vec_id AS query_id", "v")
    got = [tuple(r) for r in knn_join(q, v, 5, shards=3, block=4, blocks=2).collect()]
    want = []
    for i, a in rows:
        if i % 7 == 0:
            cos = lambda b, a=a: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
            near = sorted((-round(cos(b), 9), j) for j, b in rows)[:5]
            want += [(i, j, r) for r, (_, j) in enumerate(near, 1)]
    assert sorted((a, b, r) for a, b, _, r in got) == sorted(want)


def test_spread_follows_the_number_of_rows(spark):
    rows = spark.range(5000).selectExpr("id % 1000 AS k", "id")
    assert spread(rows, "k", rows=100).rdd.getNumPartitions() == 50
    assert spread(rows, "k").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = spread(rows, "k", rows=100).groupBy("k", F.col("id") % 2).count()
    assert "Exchange hashpartitioning(k" in placed._jdf.queryExecution().toString() and placed._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_each_text_is_parsed_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(attributes, "parse_attributes", lambda df, *a: seen.append(df.count()) or parse(df, *a))
    parse = attributes_of
    rows = spark.createDataFrame([(i, ("Cable 3x1.5", "Socket 16A IP44", "", None)[i % 4]) for i in range(60)], "id long, text string")
    got = attributes.with_attributes(rows, "text", "a")
    want = attributes_of(rows, "text", "a")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and seen == [3]
