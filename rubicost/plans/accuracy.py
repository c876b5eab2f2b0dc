"""Scoring of estimates against the truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubicost.operators.statistics import exact_median
from rubicost.registry import query
from rubicost.tables import Tables

TRUTH = """s AS (SELECT l_suppkey AS file_id, l_returnflag AS part, l_extendedprice / l_quantity AS got, CASE WHEN l_partkey % 13 <> 0 THEN p_retailprice END AS truth, CASE l_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'norm' WHEN 2 THEN 'web' ELSE 'none' END AS source
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"""


def scored(t: Tables):
    """Estimated and true unit prices of each row; some rows have no truth."""
    source = F.expr("CASE l_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'norm' WHEN 2 THEN 'web' ELSE 'none' END")
    both = t("lineitem").join(t("part").select("p_partkey", "p_retailprice"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return both.select(F.col("l_suppkey").alias("file_id"), F.col("l_returnflag").alias("part"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("got"), F.when(F.col("l_partkey") % 13 != 0, F.col("p_retailprice")).alias("truth"), source.alias("source"))


@query(f"""WITH {TRUTH}, r AS (SELECT part, got / truth AS ratio FROM s WHERE truth > 0)
SELECT part, count(*) AS n, count(*) FILTER (WHERE abs(ratio - 1) <= 0.15) AS within, round(median(ratio), 6) AS median_ratio, round(median(abs(ratio - 1)), 6) AS median_error FROM r GROUP BY part""")
def ratio_statistics(t: Tables):
    """Rows within 15 per cent, exact median of the ratio and of its error."""
    r = scored(t).where("truth > 0").select("part", (F.col("got") / F.col("truth")).alias("ratio"))
    r = r.withColumn("error", F.abs(F.col("ratio") - 1))
    counts = r.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error") <= 0.15).alias("within"))
    ratio, error = (exact_median(r, ["part"], c, f"median_{c}").drop("n") for c in ("ratio", "error"))
    return counts.join(ratio, "part", "left").join(error, "part", "left").select("part", "n", "within", F.round("median_ratio", 6).alias("median_ratio"), F.round("median_error", 6).alias("median_error"))


@query(f"""WITH {TRUTH} SELECT file_id, part, count(*) AS n, count(*) FILTER (WHERE truth IS NOT NULL AND source <> 'none') AS priced, count(*) FILTER (WHERE source = 'none') AS unpriced,
    count(*) FILTER (WHERE source <> 'none' AND abs(got - truth) <= 0.15 * truth) AS hit, round(count(*) FILTER (WHERE source <> 'none' AND abs(got - truth) <= 0.15 * truth)::DOUBLE / count(*), 6) AS share FROM s GROUP BY 1, 2""")
def part_scores(t: Tables):
    """Per file and part: rows, hits within tolerance, their share, and what stayed without a price."""
    priced = F.col("source") != "none"
    hit = F.count_if(priced & (F.abs(F.col("got") - F.col("truth")) <= 0.15 * F.col("truth")))
    return scored(t).groupBy("file_id", "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(priced & F.col("truth").isNotNull()).alias("priced"), F.count_if(~priced).alias("unpriced"), hit.alias("hit"), F.round(hit.cast("double") / F.count(F.lit(1)), 6).alias("share"))


@query(f"""WITH {TRUTH} SELECT file_id, count(*) FILTER (WHERE abs(got - truth) <= 1e-9) AS exact, count(*) FILTER (WHERE abs(got - truth) <= 0.10 * truth) AS within10, count(*) FILTER (WHERE abs(got - truth) <= 0.15 * truth) AS within15,
    abs(sum(got::DECIMAL(18,4)) - sum(truth::DECIMAL(18,4))) <= 0.05::DECIMAL(3,2) * sum(truth::DECIMAL(18,4)) AS sheet_ok FROM s WHERE truth IS NOT NULL GROUP BY 1""")
def unit_rate_scores(t: Tables):
    """Exact hits, hits within two tolerances, and whether the sheet's total is near."""
    e = F.abs(F.col("got") - F.col("truth"))
    d = lambda c: F.sum(F.col(c).cast("decimal(18,4)"))
    near = F.abs(d("got") - d("truth")) <= F.lit(0.05).cast("decimal(3,2)") * d("truth")
    return scored(t).where("truth IS NOT NULL").groupBy("file_id").agg(F.count_if(e <= 1e-9).alias("exact"), F.count_if(e <= 0.10 * F.col("truth")).alias("within10"), F.count_if(e <= 0.15 * F.col("truth")).alias("within15"), near.alias("sheet_ok"))


@query(f"""WITH {TRUTH}, f AS (SELECT file_id, part, median(got / truth) AS m, max(got) AS top FROM s WHERE truth > 0 GROUP BY 1, 2)
SELECT part, count(*) AS files, round(median(m), 6) AS median_of_medians, round(max(top), 4) AS highest FROM f GROUP BY part""")
def score_rollup(t: Tables):
    """Median of the files' medians."""
    r = scored(t).where("truth > 0").select("file_id", "part", "got", (F.col("got") / F.col("truth")).alias("ratio"))
    top = r.groupBy("file_id", "part").agg(F.max("got").alias("top")).groupBy("part").agg(F.count(F.lit(1)).alias("files"), F.round(F.max("top"), 4).alias("highest"))
    middle = exact_median(exact_median(r, ["file_id", "part"], "ratio", "m").drop("n"), ["part"], "m", "mm").drop("n")
    return top.join(middle, "part", "left").select("part", "files", F.round("mm", 6).alias("median_of_medians"), "highest")


@query(f"""WITH {TRUTH} SELECT source, count(*) AS n, count(truth) AS known FROM s GROUP BY source""")
def source_counts(t: Tables):
    """How rows were priced."""
    return scored(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("truth").alias("known"))
