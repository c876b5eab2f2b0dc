import random

import pytest
from pyspark.sql import functions as F

from rubicost.operators.fold import ordered_fold
from rubicost.operators.scan import FAR, Finite, called, carried, composed, composed_fold, ranks, running_totals
from rubicost.operators.statistics import exact_median
from rubicost.plans.history import Bucket, Card, Deltas, Queue
from tests.test_operators import stepped

KINDS = {
    "bucket": (lambda: Bucket(3, 50), lambda rng, at: (at,), "at long", "passed boolean"),
    "queue": (Queue, lambda rng, at: (at, rng.randrange(60)), "at long, lasts long", "taken boolean"),
    "card": (lambda: Card(10, 900), lambda rng, at: (at, rng.choice(["undo", "allowed", "denied"]), 0), "at long, action string, begun long", "state string, effect string"),
    "deltas": (lambda: Deltas(40, 30), lambda rng, at: (rng.choice((0, 1, 9, 25, 60)), at, rng.random() < 0.9), "length int, at long, is_text boolean", "flush int"),
    "finite": (lambda: Finite(["out", "in"], lambda s, at, ok: (("in" if ok else "out"), (s,))), lambda rng, at: (at, rng.random() < 0.5), "at long, ok boolean", "was string"),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("hot", [True, False])
def test_composed_folds_give_the_rows_of_ordered_ones(spark, kind, hot):
    machine, values, given, made = KINDS[kind]
    rng = random.Random(8)
    keys = [None, 1, 2, 3, 40, 41]
    rows = [(7 if hot else rng.choice(keys), i, *values(rng, i // 2 if kind == "card" else i * 3 if kind == "deltas" else rng.randrange(3000))) for i in range(1200)]
    df = spark.createDataFrame(rows, f"key long, id long, {given}").repartition(5)
    schema = f"key long, id long, {made}"
    got = composed_fold(df, "key", ["at", "id"], machine, ["key", "id"], schema, parts=8)
    want = ordered_fold(df, "key", ["at", "id"], lambda: stepped(machine()), ["key", "id"], schema)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.schema == want.schema


def test_one_key_uses_all_tasks(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("key"), F.col("id"), (F.col("id") * 7).alias("at"))
    got = composed_fold(rows, "key", ["at", "id"], Bucket, ["key", "id"], "key int, id long, passed boolean", parts=8)
    tasks = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) >= 6 and max(r["count"] for r in tasks) < 10_000 and sum(r["count"] for r in tasks) == 20_000


def test_composed_pieces_stay_few():
    rng = random.Random(9)
    for machine, values in ((Bucket(3, 50), lambda at: (at,)), (Queue(), lambda at: (at, rng.randrange(100)))):
        at, rows = 0, []
        for _ in range(2000):
            at += rng.choice((0, 1, 5, 200))
            rows.append(values(at))
        f = machine.summary()
        for row in rows:
            f = machine.extend(f, *row)
        assert len(f) < 60
        for x in (machine.start, -FAR, 0, 17, at, 149):
            state = x
            for row in rows:
                state = machine.step(state, *row)[0]
            assert called(f, x) == state
    assert composed([(5, 1, 1), (FAR, 0, 9)], [(4, 1, 0), (FAR, 0, 4)]) == [(3, 1, 1), (FAR, 0, 4)]


def test_long_jobs_are_summed_up_in_pairs(monkeypatch):
    rng, visited = random.Random(15), []
    monkeypatch.setattr("rubicost.operators.scan.composed", lambda f, g: visited.append(len(f) + len(g)) or composed(f, g))
    for longest, most in ((4000, 4100), (400, 500)):
        rows = [[i, rng.randrange(longest)] for i in range(6000)]
        for m in (Queue(), Queue(longest)):
            f = m.summary()
            visited.clear()
            for i in range(0, len(rows), 2500):
                f = m.extend_all(f, rows[i : i + 2500])
            # one row at a time visits thousands of pieces for each
            assert sum(visited) < 60 * len(rows)
            assert m.longest is None or len(f) < most
            for x in (m.start, 0, 17, longest // 2, longest):
                state = x
                for row in rows:
                    state = m.step(state, *row)[0]
                assert called(f, x) == m.apply(f, x) == state


def test_folds_of_nothing(spark):
    empty = spark.createDataFrame([], "key long, id long, at long")
    assert composed_fold(empty, "key", ["at"], Bucket, ["key", "id"], "key long, id long, passed boolean").count() == 0


def test_ranks_and_totals_have_no_single_partition(spark):
    rng = random.Random(10)
    rows = [(rng.choice([None, *range(40)]), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "x int, id int, n int").repartition(7)
    order = [F.col("x").desc_nulls_last(), F.col("id")]
    key = lambda r: (r[0] is None, -(r[0] or 0), r[1])
    want = sorted(rows, key=key)
    got = ranks(df, order, "place", parts=6)
    assert [tuple(r) for r in got.orderBy("place").collect()] == [(*r, i) for i, r in enumerate(want, 1)]
    total, sums = 0, []
    for r in want:
        total += r[2]
        sums.append((*r, total))
    assert sorted(map(repr, map(tuple, running_totals(df, order, "n", "sum", parts=6).collect()))) == sorted(map(repr, sums))
    assert ranks(df.limit(0), order).count() == 0
    median = exact_median(df, [], "x").collect()[0]
    values = sorted(r[0] for r in rows if r[0] is not None)
    assert median["median"] == (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
    # only the frame of one row for each partition meets in one task
    plan = got._jdf.queryExecution().executedPlan().toString()
    data = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert all("_s" in line or "SinglePartition" in line for line in data) and plan.count("SinglePartition") <= 2


def test_values_are_carried_over_pieces(spark):
    rng = random.Random(11)
    rows = [(rng.choice((None, 1, 2)), i, rng.choice((None, None, None, f"t{i}"))) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, row int, title string")
    want, last = [], {}
    for k, i, title in rows:
        last[k] = title or last.get(k)
        want.append((k, i, title, last[k]))
    got = carried(df, ["k"], "row", {"section": F.col("title")}, width=7)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
