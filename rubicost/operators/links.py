"""References from cell to cell, followed by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubicost.sources.files import stored


def followed(links: DataFrame, source: str = "source", target: str = "target", most: int = 60) -> DataFrame:
    """source, end, steps for each source: where its references lead at last, and over how many; null for both on a cycle.

    A source has one target; of several the least counts, and a null target
    leads nowhere. Each round doubles the distance followed, so a chain of
    length n takes log2(n) joins, each on a frame that was written before. What
    has arrived takes no further part. What has not after as many doublings as
    there are sources goes round, or leads into what goes round.
    """
    # a hot target is one row: joins look up targets among sources, which are distinct
    at = stored(links.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("s")).agg(F.min(target).alias("t")).where("t IS NOT NULL").withColumn("n", F.lit(1).cast("long")))
    count = at.count()
    done = None
    for _ in range(min(most, max(1, count.bit_length()) + 1)):
        ahead = at.select(F.col("s").alias("s2"), F.col("t").alias("t2"), F.col("n").alias("n2"))
        moved = at.join(ahead, F.col("t") == F.col("s2"), "left")
        if done is not None:
            # the way may lead to one that has arrived already
            ends = done.select(F.col("s").alias("s3"), F.col("t").alias("t3"), F.col("n").alias("n3"))
            moved = moved.join(ends, F.col("t") == F.col("s3"), "left")
        else:
            moved = moved.withColumns({"s3": F.lit(None).cast(dict(at.dtypes)["s"]), "t3": F.col("t2"), "n3": F.lit(None).cast("long")})
        arrived = F.col("s2").isNull()
        step = stored(moved.select("s", F.when(arrived, F.coalesce("t3", "t")).otherwise(F.col("t2")).alias("t"), (F.col("n") + F.when(arrived, F.coalesce("n3", F.lit(0))).otherwise(F.col("n2"))).alias("n"), arrived.alias("arrived")))
        fresh = step.where("arrived").select("s", "t", "n")
        done = fresh if done is None else done.unionByName(fresh)
        at = step.where("NOT arrived").select("s", "t", "n")
        if at.isEmpty():
            break
    lost = at.select("s", F.lit(None).cast(dict(at.dtypes)["t"]).alias("t"), F.lit(None).cast("long").alias("n"))
    return done.unionByName(lost).toDF(source, "end", "steps")
