"""Exact order statistics that no task has to hold a group for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubicost.operators.scan import running_totals

#: how far from the middle the bracket reaches, well above the sketch's error of 1 / ACCURACY
BESIDE, ACCURACY = 0.002, 10_000


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """keys, n and the median of each group's values that aren't null, exactly.

    Two quantiles from a sketch bracket the middle. Values below them are only
    counted; the few in between are counted by value and ranked, without keys by
    range partitions. A group without values has no row.
    """
    some = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    at = F.percentile_approx("_v", [0.5 - BESIDE, 0.5 + BESIDE], ACCURACY)
    brackets = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), at.alias("_at"))
    named = brackets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "n", F.col("_at")[0].alias("_lo"), F.col("_at")[1].alias("_hi"))
    low = F.col("_v") < F.col("_lo")
    # without keys there is one bracket
    met = some.join(named, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]) if keys else some.crossJoin(F.broadcast(named))
    near = met.where(F.col("_v") <= F.col("_hi"))
    # all values below the bracket are one row, with a null for the value
    counted = near.groupBy(*keys, "n", F.when(~low, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    low_first = F.col("_v").asc_nulls_first()
    ranked = counted.withColumn("_end", F.sum("_c").over(Window.partitionBy(*keys).orderBy(low_first))) if keys else running_totals(counted, [low_first], "_c", "_end")
    # ranks from 1; the middle lies between places (n + 1) // 2 and n // 2 + 1
    first, second = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    begin = F.col("_end") - F.col("_c")
    holds = lambda place: F.max(F.when((begin < place) & (place <= F.col("_end")), F.col("_v")))
    return ranked.groupBy(*keys, "n").agg(((holds(first) + holds(second)) / 2).alias(out))
