"""Ranking helpers: placing by keys, first row of a group, most common value, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: rows of a task of ``spread``, about
ROWS = 500_000


def spread(df: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """The frame placed by its keys in as many partitions as keep a task at about ``rows`` rows, however many there are.

    Windows and groups over these keys (and more) need no further exchange. For
    frames that are cheap to count.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)


def first_of(df: DataFrame, keys: list[str], *order: Column, rank: str | None = None, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; ``rank`` keeps their place."""
    place = rank or "_rank"
    out = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)
    return out if rank else out.drop(place)


def mode_first_seen(df: DataFrame, keys: list[str], value: str, ordinal: list[str]) -> DataFrame:
    """keys, value, n: the most common value of each group; of equals the one seen first by ``ordinal``.

    Counts are partial before the shuffle, so a hot group costs a row per value.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ordinal)).alias("_seen"))
    return counted.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), "_seen")).alias("_m")).select(*keys, f"_m.{value}", "_m.n")


def systematic(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """At most ``n`` evenly spaced rows of each group, its first among them."""
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(*order)) - 1
    span = F.count(F.lit(1)).over(w)
    ranked = df.withColumn("_i", place).withColumn("_n", span)
    # place i stays if it is the floor of k * n_rows / n for some k
    k = F.ceil(F.col("_i") * n / F.col("_n"))
    keep = (F.col("_n") <= n) | ((k < n) & (F.floor(k * F.col("_n") / n) == F.col("_i")))
    return ranked.where(keep).drop("_i", "_n")


def page(df: DataFrame, order: list[Column], offset: int, limit: int, most: int = 500) -> DataFrame:
    """One page of an ordered frame; the limit is clamped to 1..most."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(most, limit)))
