"""Containment in many or long ranges by dyadic intervals: equality joins only.

A range of whole numbers is cut into aligned pieces of lengths that are powers
of two, at most two of each length. A point lies in a range if one of the
aligned pieces above it, one for each length, is among the range's. A range of
any length is hence about 2 log2(length) rows and a point log2(domain), however
many ranges hold it. Rectangles are pairs of pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: coordinates are below 2 ** LEVELS
LEVELS = 31


def pieces(start: Column, end: Column, levels: int = LEVELS) -> Column:
    """The aligned pieces of start..end (both inclusive) as an array of (level, node); none if it is empty.

    At each level a start that is a right child, and an end that is a left one,
    are pieces of their own; what is between goes up a level.
    """
    piece = "struct<level:int,node:bigint>"
    begin = F.struct(start.cast("bigint").alias("a"), end.cast("bigint").alias("b"), F.array().cast(f"array<{piece}>").alias("out"))

    def up(s: Column, level: Column) -> Column:
        a, b = s["a"], s["b"]
        own = lambda n: F.struct(level.cast("int").alias("level"), n.alias("node"))
        left = F.when((a <= b) & (a % 2 == 1), F.array(own(a))).otherwise(F.array().cast(f"array<{piece}>"))
        a2 = a + a % 2
        right = F.when((a2 <= b) & (b % 2 == 0), F.array(own(b))).otherwise(F.array().cast(f"array<{piece}>"))
        b2 = b - F.when(b % 2 == 0, 1).otherwise(0)
        return F.struct(F.when(a2 <= b2, F.floor(a2 / 2)).otherwise(F.lit(1)).cast("bigint").alias("a"), F.when(a2 <= b2, F.floor(b2 / 2)).otherwise(F.lit(0)).cast("bigint").alias("b"), F.concat(s["out"], left, right).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), begin, up, lambda s: s["out"])


def ancestors(at: Column, levels: Column) -> Column:
    """The aligned pieces that hold a point, of the given levels, as an array of (level, node)."""
    return F.transform(levels, lambda level: F.struct(level.cast("int").alias("level"), F.floor(at / F.pow(F.lit(2.0), level)).cast("bigint").alias("node")))


def used_levels(cut: DataFrame, *columns: str) -> list[int]:
    """The levels that occur at all: points need no others."""
    found = set()
    for c in columns:
        found |= {r[0] for r in cut.select(F.col(f"{c}.level")).distinct().collect()}
    return sorted(found)


def contained(points: DataFrame, ranges: DataFrame, keys: list[str], axes: list[tuple[str, str, str]]) -> DataFrame:
    """Points with each range of their key that holds them; an axis is (point column, start, end), one or two of them.

    Whole numbers from 0 to 2**31 - 1; a null bound or place, and a range that
    ends before it starts, match nothing. A range and a point meet at most once.
    """
    pairs = [(F.when((F.col(a) >= 0) & (F.col(b) >= F.col(a)), pieces(F.col(a), F.col(b)))) for _, a, b in axes]
    other = [c for c in ranges.columns if c not in keys]
    cut = ranges.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *other, *[p.alias(f"_p{i}") for i, p in enumerate(pairs)])
    for i in range(len(axes)):
        cut = cut.withColumn(f"_p{i}", F.explode(f"_p{i}"))
    placed = points
    for i, (at, _, _) in enumerate(axes):
        levels = F.array(*map(F.lit, used_levels(cut, f"_p{i}"))).cast("array<int>")
        placed = placed.withColumn(f"_a{i}", F.explode(ancestors(F.col(at), levels)))
    same = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    for i in range(len(axes)):
        same += [F.col(f"_a{i}.level") == F.col(f"_p{i}.level"), F.col(f"_a{i}.node") == F.col(f"_p{i}.node")]
    return placed.join(cut, same).select(*points.columns, *other)
