"""Usage and budget reports over the ledger of metered calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rubicost.registry import query
from rubicost.tables import Tables, with_views

LEDGER = with_views("ledger")
SINCE = "2024-01-05"
NOW = "2024-01-20 12:00:00"
#: Budget of the month, and the share of it from which it counts as near.
BUDGET, NEAR = 500_000, 0.8


def total(condition=None, column: str = "cost"):
    """Exact decimal sum as a double, 0 where nothing qualifies."""
    x = F.col(column) if condition is None else F.when(condition, F.col(column))
    return F.coalesce(F.sum(x), F.lit(0)).cast("double")


@query(f"""{LEDGER}
SELECT coalesce(sum(cost), 0)::DOUBLE AS cost, count(*) FILTER (WHERE kind = 'view') AS questions,
    count(DISTINCT run_id) FILTER (WHERE kind = 'purchase') AS runs, count(DISTINCT user_id) AS users, sum(tokens)::BIGINT AS tokens,
    coalesce(sum(cost) FILTER (WHERE kind = 'click'), 0)::DOUBLE AS click_cost
FROM ledger WHERE created_at >= TIMESTAMP '{SINCE}'""")
def usage_kpis(t: Tables):
    """Totals of the period with filtered and distinct counts."""
    return (
        t.ledger()
        .where(F.col("created_at") >= F.lit(SINCE).cast("timestamp_ntz"))
        .agg(
            total().alias("cost"),
            F.count_if(F.col("kind") == "view").alias("questions"),
            F.count_distinct(F.when(F.col("kind") == "purchase", F.col("run_id"))).alias("runs"),
            F.count_distinct("user_id").alias("users"),
            F.sum("tokens").alias("tokens"),
            total(F.col("kind") == "click").alias("click_cost"),
        )
    )


@query(f"""{LEDGER}
SELECT count(*) AS questions, round(avg(c), 4) AS avg_cost FROM (SELECT run_id, sum(cost)::DOUBLE AS c FROM ledger WHERE kind <> 'error' GROUP BY run_id)""")
def usage_cost_per_question(t: Tables):
    runs = t.ledger().where("kind <> 'error'").groupBy("run_id").agg(F.sum("cost").cast("double").alias("c"))
    return runs.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("c"), 4).alias("avg_cost"))


@query(f"""{LEDGER}, g AS (SELECT coalesce(tier, 'other') AS tier, count(*) AS calls, sum(cost)::DOUBLE AS cost FROM ledger GROUP BY 1)
SELECT tier, calls, cost, CASE WHEN sum(cost) OVER () = 0 THEN 0 ELSE round(cost / sum(cost) OVER (), 6) END AS share FROM g""")
def usage_by_tier(t: Tables):
    """Cost by tier and its share of the whole; the window runs over a row per tier."""
    tiers = t.ledger().groupBy(F.coalesce("tier", F.lit("other")).alias("tier")).agg(F.count(F.lit(1)).alias("calls"), F.sum("cost").cast("double").alias("cost"))
    whole = F.sum("cost").over(Window.partitionBy())
    return tiers.select("tier", "calls", "cost", F.when(whole == 0, 0.0).otherwise(F.round(F.col("cost") / whole, 6)).alias("share"))


@query(f"""{LEDGER}, days AS (SELECT unnest(generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY))::DATE AS day),
f AS (SELECT created_at::DATE AS day, tier, cost FROM ledger)
SELECT strftime(d.day, '%Y-%m-%d') AS day, coalesce(sum(cost) FILTER (WHERE tier = 'fast'), 0)::DOUBLE AS fast,
    coalesce(sum(cost) FILTER (WHERE tier = 'standard'), 0)::DOUBLE AS standard, coalesce(sum(cost) FILTER (WHERE tier = 'advanced'), 0)::DOUBLE AS advanced,
    coalesce(sum(cost) FILTER (WHERE coalesce(tier, 'other') NOT IN ('fast', 'standard', 'advanced')), 0)::DOUBLE AS other, coalesce(sum(cost), 0)::DOUBLE AS total
FROM days d LEFT JOIN f ON f.day = d.day GROUP BY d.day""")
def usage_daily_pivot(t: Tables):
    """Cost by day and tier with a row for every calendar day; facts are aggregated before the join."""
    spark = t.spark
    days = spark.sql("SELECT explode(sequence(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY)) AS day")
    tier = F.coalesce("tier", F.lit("other"))
    named = [n for n in ("fast", "standard", "advanced")]
    facts = t.ledger().groupBy(F.to_date("created_at").alias("day")).agg(*[F.sum(F.when(tier == n, F.col("cost"))).alias(n) for n in named], F.sum(F.when(~tier.isin(named), F.col("cost"))).alias("other"), F.sum("cost").alias("total"))
    cells = [F.coalesce(n, F.lit(0)).cast("double").alias(n) for n in (*named, "other", "total")]
    return days.join(facts, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), *cells)


@query(f"""{LEDGER}
SELECT conversation_id, count(*) AS calls, sum(cost)::DOUBLE AS cost, max(created_at) AS last_at, count(DISTINCT run_id) AS runs FROM ledger GROUP BY conversation_id""")
def usage_by_conversation(t: Tables):
    return t.ledger().groupBy("conversation_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost").cast("double").alias("cost"), F.max("created_at").alias("last_at"), F.count_distinct("run_id").alias("runs"))


@query(f"""{LEDGER}
SELECT conversation_id, coalesce(sum(cost) FILTER (WHERE tier = 'fast'), 0)::DOUBLE AS fast, coalesce(sum(cost) FILTER (WHERE tier = 'standard'), 0)::DOUBLE AS standard,
    coalesce(sum(cost) FILTER (WHERE tier = 'advanced'), 0)::DOUBLE AS advanced FROM ledger GROUP BY conversation_id""")
def usage_conversation_tiers(t: Tables):
    return t.ledger().groupBy("conversation_id").agg(*[total(F.col("tier") == n).alias(n) for n in ("fast", "standard", "advanced")])


@query(f"""{LEDGER}
SELECT coalesce(sum(cost) FILTER (WHERE created_at >= date_trunc('day', TIMESTAMP '{NOW}')), 0)::DOUBLE AS today,
    coalesce(sum(cost) FILTER (WHERE created_at >= date_trunc('week', TIMESTAMP '{NOW}')), 0)::DOUBLE AS week,
    coalesce(sum(cost) FILTER (WHERE created_at >= date_trunc('month', TIMESTAMP '{NOW}')), 0)::DOUBLE AS month
FROM ledger WHERE created_at < TIMESTAMP '{NOW}'""")
def usage_calendar_windows(t: Tables):
    """Spend of the current day, week (from Monday) and month."""
    now = F.lit(NOW).cast("timestamp_ntz")
    return t.ledger().where(F.col("created_at") < now).agg(*[total(F.col("created_at") >= F.date_trunc(u, now).cast("timestamp_ntz")).alias(n) for n, u in (("today", "day"), ("week", "week"), ("month", "month"))])


@query(f"""{LEDGER}
SELECT round(avg(cost::DOUBLE), 6) AS avg_cost, count(*) AS n FROM (SELECT cost FROM ledger WHERE kind = 'purchase' ORDER BY created_at DESC, id DESC LIMIT 50)""")
def usage_last50_average(t: Tables):
    """Average of the latest 50 purchases: the limit comes before the aggregate."""
    last = t.ledger().where("kind = 'purchase'").orderBy(F.desc("created_at"), F.desc("id")).limit(50)
    return last.agg(F.round(F.avg(F.col("cost").cast("double")), 6).alias("avg_cost"), F.count(F.lit(1)).alias("n"))


@query(f"""{LEDGER}
SELECT tier, kind, grouping(tier)::INTEGER AS g_tier, sum(cost)::DOUBLE AS cost FROM ledger WHERE created_at >= TIMESTAMP '2024-01-01' GROUP BY GROUPING SETS ((tier), (kind))""")
def usage_month_tier_task(t: Tables):
    """Month spend by tier and by task in one pass of grouping sets."""
    rows = t.ledger().where(F.col("created_at") >= F.lit("2024-01-01").cast("timestamp_ntz"))
    return rows.groupingSets([[F.col("tier")], [F.col("kind")]], "tier", "kind").agg(F.grouping("tier").cast("int").alias("g_tier"), F.sum("cost").cast("double").alias("cost"))


@query(f"""{LEDGER}, s AS (SELECT coalesce(sum(cost), 0)::DOUBLE AS spent FROM ledger WHERE created_at >= TIMESTAMP '2024-01-01'), b AS (SELECT {BUDGET}::DOUBLE AS budget)
SELECT spent, budget, round(spent / budget, 6) AS share, CASE WHEN spent >= budget THEN 'over' WHEN spent >= {NEAR} * budget THEN 'near' ELSE 'ok' END AS state FROM s CROSS JOIN b""")
def budget_status(t: Tables):
    """Spend against the budget: two one-row frames meet."""
    spent = t.ledger().where(F.col("created_at") >= F.lit("2024-01-01").cast("timestamp_ntz")).agg(total().alias("spent"))
    budget = t.spark.sql(f"SELECT CAST({BUDGET} AS DOUBLE) AS budget")
    state = F.when(F.col("spent") >= F.col("budget"), "over").when(F.col("spent") >= NEAR * F.col("budget"), "near").otherwise("ok")
    return spent.crossJoin(F.broadcast(budget)).select("spent", "budget", F.round(F.col("spent") / F.col("budget"), 6).alias("share"), state.alias("state"))


@query(f"""{LEDGER}, s AS (SELECT sum(cost)::DOUBLE AS spent, date_diff('day', min(created_at)::DATE, DATE '2024-01-30') + 1 AS days FROM ledger)
SELECT round(spent / days, 4) AS per_day, ceil(({BUDGET * 10} - spent) / (spent / days))::BIGINT AS days_left FROM s""")
def budget_projection(t: Tables):
    """Linear run rate and the days until a limit is reached."""
    s = t.ledger().agg(F.sum("cost").cast("double").alias("spent"), (F.datediff(F.lit("2024-01-30"), F.min("created_at")) + 1).alias("days"))
    return s.select(F.round(F.col("spent") / F.col("days"), 4).alias("per_day"), F.ceil((BUDGET * 10 - F.col("spent")) / (F.col("spent") / F.col("days"))).alias("days_left"))


@query(f"""{LEDGER}
SELECT conversation_id, sum(cost)::DOUBLE AS cost FROM ledger GROUP BY conversation_id ORDER BY cost DESC, conversation_id LIMIT 6""")
def usage_top_conversations(t: Tables):
    return t.ledger().groupBy("conversation_id").agg(F.sum("cost").cast("double").alias("cost")).orderBy(F.desc("cost"), "conversation_id").limit(6)


@query(f"""{LEDGER}
SELECT run_id, sum(cost)::DOUBLE AS cost, max(conversation_id) AS conversation_id FROM ledger GROUP BY run_id""")
def run_costs(t: Tables):
    """Cost of each run, derived from the ledger instead of kept as a running total."""
    return t.ledger().groupBy("run_id").agg(F.sum("cost").cast("double").alias("cost"), F.max("conversation_id").alias("conversation_id"))


#: Price per million tokens by family; the longest family name inside a model name counts.
PRICES = [("small", 1.0), ("small-fast", 0.5), ("large", 8.0), ("large-long", 12.0)]
MODEL = "CASE event_type WHEN 'view' THEN 'x-small-fast-1' WHEN 'click' THEN 'x-small-2' WHEN 'purchase' THEN 'x-large-long-1' WHEN 'signup' THEN 'x-large-1' ELSE 'unknown' END"


@query(f"""WITH m AS (SELECT event_id, {MODEL} AS model, json_extract_string(props, '$.k')::BIGINT AS tokens FROM events),
p AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in PRICES)}) v(family, price)),
r AS (SELECT model, arg_max(price, length(family)) AS price FROM (SELECT DISTINCT model FROM m) d JOIN p ON contains(d.model, p.family) GROUP BY model)
SELECT event_id, m.model, round(coalesce(price::DOUBLE, 0) * tokens / 1e6, 9) AS cost_usd FROM m LEFT JOIN r ON r.model = m.model""")
def call_costs(t: Tables):
    """Cost of each call by its model's price; prices are matched once per distinct model."""
    calls = t("events").select("event_id", F.expr(MODEL).alias("model"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"))
    prices = F.broadcast(t.rows(PRICES, "family string, price double"))
    rates = calls.select("model").distinct().join(prices, F.contains("model", "family")).groupBy("model").agg(F.max_by("price", F.length("family")).alias("price"))
    return calls.join(rates, "model", "left").select("event_id", "model", F.round(F.coalesce("price", F.lit(0.0)) * F.col("tokens") / 1e6, 9).alias("cost_usd"))


@query(f"""{LEDGER}, s AS (SELECT run_id, id, sum(cost) OVER (PARTITION BY run_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ledger)
SELECT run_id, id, coalesce(before, 0)::DOUBLE AS spent_before, coalesce(before, 0) < 3000 AS allowed FROM s""")
def cost_cap_check(t: Tables):
    """Whether each call of a run was still under the run's cap when it was made."""
    w = Window.partitionBy("run_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("cost").over(w), F.lit(0))
    return t.ledger().select("run_id", "id", before.cast("double").alias("spent_before"), (before < 3000).alias("allowed"))
