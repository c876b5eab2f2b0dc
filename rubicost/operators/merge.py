"""Merging versions of rows: overrides, upserts, appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def override(base: DataFrame, overrides: DataFrame, keys: list[str], fields: list[str], present: str = "fields") -> DataFrame:
    """Base rows with their overrides: a field listed in ``present`` wins even where its value is null."""
    other = overrides.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(f).alias(f"_o_{f}") for f in fields], F.col(present).alias("_has"))
    joined = base.join(other, [F.col(k) == F.col(f"_k_{k}") for k in keys], "left")
    cells = [F.when(F.array_contains("_has", f), F.col(f"_o_{f}")).otherwise(F.col(f)).alias(f) if f in fields else F.col(f) for f in base.columns]
    return joined.select(*cells, F.col("_has").isNotNull().alias("edited"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: Column) -> DataFrame:
    """Rows of both: new ones replace old ones except where ``keep_old`` holds for the old row (named with the prefix ``o.``)."""
    names = old.columns
    has_old, has_new = F.col("o._in").isNotNull(), F.col("n._in").isNotNull()
    stay = has_old & (~has_new | F.coalesce(keep_old, F.lit(False)))
    both = old.withColumn("_in", F.lit(1)).alias("o").join(new.withColumn("_in", F.lit(1)).alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    return both.select(*[F.when(stay, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in names])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Old rows, and of the new ones the first of each key that the old ones don't have."""
    from rubicost.operators.topk import first_of

    fresh = first_of(new, keys, *[F.col(c) for c in order]).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def replace_groups(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones of groups that have no new row."""
    groups = new.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    kept = old.join(groups, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left_anti")
    return kept.unionByName(new.select(*old.columns))
