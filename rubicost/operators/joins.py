"""Joins by similarity, nearness and interval that stay equi-joins underneath."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubicost.functions.text import total_weight, weight


def prefix_tokens(texts: DataFrame, key: str, tokens: str, frequency: DataFrame, share: float, weigh=weight, on: list[str] | None = None) -> DataFrame:
    """key, on, t: the rarest tokens of each text, up to the weight that another text can do without.

    Two texts that have tokens of at least ``share`` of each one's weight in
    common have one of these in common: what is left out weighs less than that
    share. ``frequency`` (t, df) orders the tokens, unknown ones first.
    """
    each = texts.select(key, *(on or []), tokens, F.explode(tokens).alias("t")).join(frequency, "t", "left")
    order = Window.partitionBy(key, *(on or [])).orderBy(F.coalesce("df", F.lit(0)), "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = weigh(F.col("t"))
    total = F.aggregate(tokens, F.lit(0.0), lambda s, t: s + weigh(t))
    ranked = each.select(key, *(on or []), "t", (total - F.sum(mine).over(order) + mine).alias("rest"), total.alias("total"))
    return ranked.where(F.col("rest") >= share * F.col("total") - 1e-9).select(key, *(on or []), "t")


def document_frequency(texts: DataFrame, tokens: str) -> DataFrame:
    """t, df: in how many of the texts a token occurs."""
    return texts.select(F.explode(tokens).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))


def lexical_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tokens: str = "toks", on: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """Pairs of texts with a weighted Dice similarity of at least ``least`` and above 0, by an inverted index on tokens.

    Both sides hold distinct texts with arrays of distinct tokens. Only the
    rarest tokens of a text are indexed: with d = least / (2 - least), similar
    texts share d of either one's weight, so frequent tokens meet nobody unless
    a text consists of them. ``on`` names further equal columns. Null and empty
    arrays are similar to nothing.
    """
    on = on or []
    share = max(least / (2 - least), 1e-6)
    frequency = document_frequency(right, tokens)
    index = [prefix_tokens(df, key, tokens, frequency, share, on=on).withColumnRenamed(key, f"{side}_key") for df, key, side in ((left, left_key, "l"), (right, right_key, "r"))]
    met = index[0].join(index[1], ["t", *on]).select("l_key", "r_key", *on).distinct()
    sides = [df.select(F.col(key).alias(f"{side}_key"), *on, F.col(tokens).alias(f"{side}_t")) for df, key, side in ((left, left_key, "l"), (right, right_key, "r"))]
    both = met.join(sides[0], ["l_key", *on]).join(sides[1], ["r_key", *on])
    common = total_weight(F.array_intersect("l_t", "r_t"))
    scored = both.select("l_key", "r_key", *on, (2 * common / (total_weight(F.col("l_t")) + total_weight(F.col("r_t")))).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def overlap_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_tokens: str, right_tokens: str, least: float) -> DataFrame:
    """left_key, right_key, overlap: pairs of texts with a Jaccard similarity of words of at least ``least``, by their rarest words."""
    one = lambda t: F.lit(1.0)
    a, b = left.select(left_key, F.array_distinct(left_tokens).alias("l_t")), right.select(right_key, F.array_distinct(right_tokens).alias("r_t"))
    frequency = document_frequency(b, "r_t")
    met = prefix_tokens(a, left_key, "l_t", frequency, least, one).join(prefix_tokens(b, right_key, "r_t", frequency, least, one), "t").drop("t").distinct()
    both = met.join(a, left_key).join(b, right_key)
    overlap = F.size(F.array_intersect("l_t", "r_t")) / F.size(F.array_union("l_t", "r_t"))
    return both.select(left_key, right_key, overlap.alias("overlap")).where(F.col("overlap") >= least)


def asof_nearest(points: DataFrame, keys: list[str], x: str, value: str, wanted: DataFrame, at: str, width: float | None = None) -> DataFrame:
    """Wanted rows with the nearest points at or below and at or above: lo, lo_value, hi, hi_value.

    Points and the distinct wanted places are merged into one ordered stream per
    key; each direction carries the last point along, so a stream is read once.
    With ``width`` a key's stream is cut into pieces of that length, whose first
    and last points are carried on: one hot key then has many tasks. Rows of
    wanted keys without points stay, with nulls; a null place has no neighbour.
    Of points at one place the one of least value counts.
    """
    piece = F.floor(F.col("_x") / width) if width else F.lit(0)
    p = points.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("_x")).agg(F.min(value).alias("_v")).select(*keys, "_x", F.struct(F.col("_x").alias("x"), F.col("_v").alias("v")).alias("_p"))
    w = wanted.select(*keys, F.col(at).alias("_x")).where(F.col(at).isNotNull()).distinct()
    both = p.withColumn("_w", F.lit(False)).unionByName(w.withColumn("_p", F.lit(None).cast(p.schema["_p"].dataType)).withColumn("_w", F.lit(True))).withColumn("_b", piece)
    carried = lambda keys, order, least, most: F.last("_p", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(least, most))
    up, down, first = F.col("_x"), F.col("_x").desc(), Window.unboundedPreceding
    near = both.withColumn("_lo", carried([*keys, "_b"], up, first, 0)).withColumn("_hi", carried([*keys, "_b"], down, first, 0)).where("_w")
    if width:
        ends = both.groupBy(*keys, "_b").agg(F.max("_p").alias("_last"), F.min("_p").alias("_first"))
        beside = lambda c, order: F.last(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(first, -1))
        ends = ends.withColumn("_before", beside("_last", F.col("_b"))).withColumn("_after", beside("_first", F.col("_b").desc())).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"), "_before", "_after")
        near = near.join(ends, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_b") == F.col("_kb")]).withColumn("_lo", F.coalesce("_lo", "_before")).withColumn("_hi", F.coalesce("_hi", "_after"))
    found = near.select(*[F.col(k).alias(f"_w_{k}") for k in keys], "_x", F.col("_lo.x").alias("lo"), F.col("_lo.v").alias("lo_value"), F.col("_hi.x").alias("hi"), F.col("_hi.v").alias("hi_value"))
    return wanted.join(found, [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys] + [F.col(at) == F.col("_x")], "left").select(*wanted.columns, "lo", "lo_value", "hi", "hi_value")


def interval_join(rows: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, size: float) -> DataFrame:
    """Every row with each span of its key that holds it, or once with nulls if none does.

    A left equi-join on key and bucket of ``size``, with the bounds as a further
    condition of the join. ``size`` should be about the length of a span.
    """
    buckets = F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size)))
    other = [c for c in spans.columns if c not in keys]
    cut = spans.where(F.col(start) <= F.col(end)).select(*[F.col(k).alias(f"_k_{k}") for k in keys], *other, buckets.alias("_kb"))
    inside = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_b") == F.col("_kb"), F.col(at).between(F.col(start), F.col(end))]
    return rows.withColumn("_b", F.floor(F.col(at) / size)).join(cut, inside, "left").select(*rows.columns, *other)


def first_match(*tiers: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The best row of the first tier that has any, for each key."""
    both = tiers[0].withColumn("tier", F.lit(1))
    for i, t in enumerate(tiers[1:], 2):
        both = both.unionByName(t.withColumn("tier", F.lit(i)))
    w = Window.partitionBy(*keys).orderBy("tier", *order)
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


#: vectors of a shard and queries of a block of ``knn_join``, about; a task holds one of each
SHARD, BLOCK = 100_000, 20_000


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, shards: int | None = None, block: int = 256, blocks: int | None = None, unrounded: str | None = None) -> DataFrame:
    """query_id, vec_id, similarity, rank: each query's k nearest rows by cosine, exact.

    Queries and vectors carry id and vector columns (``query_id``/``vec_id``,
    ``v``). Each block of queries meets every shard of vectors, one pair at a
    time, ``block`` queries at once; of a shard k rows of each query are kept.
    The numbers of shards and blocks follow those of vectors and queries, so a
    task's memory stays the same. Similarities are rounded to nine digits;
    ``unrounded`` names a further column that holds them as they were, for those
    who round to fewer. Vectors that are null, hold a null or a
    non-finite number or have length 0, and null ids, take no part.
    """
    valid = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    queries, vectors = queries.where(valid & F.col("query_id").isNotNull()), vectors.where(valid & F.col("vec_id").isNotNull())
    shards = shards or max(4, math.ceil(vectors.count() / SHARD))
    blocks = blocks or max(1, math.ceil(queries.count() / BLOCK))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col("query_id").cast("long").alias("id"), "v", part("query_id", blocks).alias("b"), every(shards).alias("s"))
    right = vectors.select(F.col("vec_id").cast("long").alias("id"), "v", part("vec_id", shards).alias("s"), every(blocks).alias("b"))

    def unit(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = t.column("v").combine_chunks()
        v = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float64)
        return t.column("id").to_numpy(), v / np.linalg.norm(v, axis=1, keepdims=True)

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            (q_ids, q), (ids, v) = unit(left), unit(right)
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            for at in range(0, len(q), block):
                sim = np.round(q[at : at + block] @ v.T, 9)
                least = np.partition(sim, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(sim), -np.inf)
                for i, row in enumerate(sim):
                    # columns are in order of ids, so a stable sort puts the smaller id first
                    near = np.flatnonzero(row >= least[i])
                    near = near[np.argsort(-row[near], kind="stable")[:k]]
                    found = [np.full(len(near), q_ids[at + i]), ids[near], row[near]]
                    out.append(found + [v[near] @ q[at + i]] if unrounded else found)
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)][: len(names)]
        return pa.table(dict(zip(names, cols, strict=True)))

    names = ["query_id", "vec_id", "similarity", *([unrounded] if unrounded else [])]
    near = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(task, "query_id long, vec_id long, similarity double" + f", `{unrounded}` double" * bool(unrounded))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
