"""Which base a group of amounts is a share of, by votes over ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio_consensus(rows: DataFrame, keys: list[str], value: str, bases: list[str], by_name: Column | None = None, digits: int = 4, share: float = 0.5, least: int = 2) -> DataFrame:
    """keys, base, pct, n, votes, confirmed: for each group the base of which most rows are one and the same share.

    Each row votes, for each base, for its value over the base, rounded to
    ``digits``. The base whose best ratio has most votes wins; of equals the one
    named first in ``bases``, so name the narrowest first, and then the smaller
    ratio. It has to explain at least ``share`` of the group's rows with a value
    and ``least`` of them; else ``by_name`` (over the keys) says the base, or it
    is the last one, unconfirmed and without a ratio.

    Rows without a value, and bases that are null or zero, don't vote. Votes are
    partial before the shuffle, so a large group costs a row per ratio.
    """
    some = rows.where(F.col(value).isNotNull())
    told = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(b).alias("_b"), F.round(F.col(value) / F.nullif(F.col(b), F.lit(0.0)), digits).alias("_r")) for i, b in enumerate(bases)])
    votes = some.select(*keys, F.inline(told)).where("_r IS NOT NULL").groupBy(*keys, "_i", "_b", "_r").agg(F.count(F.lit(1)).alias("_v"))
    best = votes.groupBy(*keys).agg(F.min_by(F.struct("_b", "_r", "_v"), F.struct(-F.col("_v"), "_i", "_r")).alias("_x"))
    named = best.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_x")
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("n"))
    both = sizes.join(named, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
    won = F.coalesce((F.col("_x._v") >= least) & (F.col("_x._v") >= share * F.col("n")), F.lit(False))
    other = F.coalesce(by_name, F.lit(bases[-1])) if by_name is not None else F.lit(bases[-1])
    return both.select(*keys, F.when(won, F.col("_x._b")).otherwise(other).alias("base"), F.when(won, F.col("_x._r")).alias("pct"), "n", F.coalesce("_x._v", F.lit(0)).alias("votes"), won.alias("confirmed"))
