"""Mixing sources to target weights by the cube method.

Each source gets a target number of words: weights share the total, a target
stops at ``cap`` times its source's words and the excess is shared again. A
document of a source is wanted m = target / source words times: floor(m) whole
copies and, with inclusion probability m - floor(m), one more. The extra copies
are drawn by the cube method: in blocks of bounded size the probabilities move
through the null space of two balancing constraints (number of documents,
number of words) until at most two of a block stay fractional. Those meet in
new blocks, round after round, until one block per source is left; its last
two probabilities are landed on the rounding nearest to the word total.

The draw depends on the rows and the seed only, so reruns agree. Sources are
the named parts of a mixture; their table (one row each, at most
``max_sources``, else an error) goes through the driver.

Defined results: a null text has size 0; the null source is a source of its
own and comes last; repeated rows are drawn one by one, in different blocks; a null doc_id is kept;
a source without words has target 0 and its documents are taken 0 times; an
empty table gives no rows; other columns are ignored by ``mix`` and pass
through ``mixed_documents``, where rows of one id and text are told apart by a
hash of the whole row.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubicost.llm.common import WORD, saved, text_key, whole_row

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 4096
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Targets that share the sum of ``sizes`` by ``weights``, each at most ``cap`` times its size."""
    left = float(sum(sizes))
    open_, out = set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            open_.discard(i)
        left = float(sum(sizes)) - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def flight(sizes: list[float], probs: list[float], rng: random.Random, land: bool) -> list[float]:
    """Moves probabilities along null vectors of (count, words) until at most two are fractional.

    Three fractional units are held at a time; a vector u with sum(u) = 0 and
    sum(u * size) = 0 exists for them, and moving along it settles one of them.
    With ``land`` the last ones are rounded so that the word total changes least.
    """
    out, held = list(probs), []
    for i in range(len(sizes)):
        if not 1e-9 < out[i] < 1 - 1e-9:
            out[i] = float(round(out[i]))
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = (sizes[k] for k in held)
        u = (c - b, a - c, b - a)
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - out[k]) / x if x > 0 else out[k] / -x for k, x in zip(held, u, strict=True) if x)
        down = min(out[k] / x if x > 0 else (1 - out[k]) / -x for k, x in zip(held, u, strict=True) if x)
        step = up if rng.random() < down / (up + down) else -down
        for k, x in zip(held, u, strict=True):
            out[k] += step * x
            if out[k] < 1e-9 or out[k] > 1 - 1e-9:
                out[k] = float(round(out[k]))
        held = [k for k in held if 0 < out[k] < 1]
    if land and held:
        want = sum(out[k] * sizes[k] for k in held)
        best = min(range(1 << len(held)), key=lambda m: (abs(sum(sizes[k] for j, k in enumerate(held) if m >> j & 1) - want), m))
        for j, k in enumerate(held):
            out[k] = float(best >> j & 1)
    return out


def source_table(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, max_sources: int = MAX_SOURCES):
    """One row per source in code point order, null last: source, source_size, docs, target."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    got = targets([r["source_size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], cap)
    return [(i, r["source"], r["source_size"], r["docs"], t) for i, (r, t) in enumerate(zip(rows, got, strict=True))]


def sizes_of(documents: DataFrame) -> DataFrame:
    """doc_id, tk, source, size and nth, one row per document; equal rows are numbered by ``nth``, so that blocks can part them."""
    each = documents.select("doc_id", text_key().alias("tk"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    counted = each.groupBy("doc_id", "tk", "source", "size").agg(F.count(F.lit(1)).alias("k"))
    return counted.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "k"))).drop("k")


def flier(names: list[str], seed: int, level: int, last: bool):
    """The flight of one block of one source, in the order of its rows' keys."""

    def fly(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "tk", "nth"], kind="stable").reset_index(drop=True)
        rng = random.Random(f"{seed}/{level}/{key[0]}/{key[1]}")
        group["p"] = flight(group["size"].astype(float).tolist(), group["p"].tolist(), rng, last)
        return group[names]

    return fly


def mix(documents: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """doc_id, tk, source, size, source_size, target, copies, taken: one row for each row of documents."""
    spark = documents.sparkSession
    sizes = saved(sizes_of(documents))
    table = source_table(sizes, weights, cap)
    schema = "s int, t_source string, source_size long, docs long, target double"
    rows = sizes.join(F.broadcast(spark.createDataFrame(table, schema)), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    m = F.when(F.col("source_size") == 0, 0.0).when(F.col("target") == cap * F.col("source_size"), F.lit(float(cap))).otherwise(F.col("target") / F.col("source_size"))
    rows = rows.withColumn("m", m).withColumn("whole", F.floor("m")).withColumn("p", F.col("m") - F.floor("m"))
    columns = "doc_id long, tk long, nth long, source string, size long, s int, source_size long, docs long, target double, whole long, p double"
    names = [c.split()[0] for c in columns.split(", ")]
    settled = [rows.where("p = 0").select(*names)]
    left = rows.where("p > 0").select(*names)
    units, level = max([1, *(t[3] for t in table)]), 0
    while True:
        # at most two units of each block stay, so the number of blocks is known without counting
        factor = 2.0**level / float(block) ** (level + 1)
        blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") * F.lit(factor)))
        last = math.ceil(units * factor) <= 1

        dealt = left.withColumn("block", F.pmod(F.xxhash64("doc_id", "tk", "nth", F.lit(level)), blocks))
        flown = saved(dealt.groupBy("s", "block").applyInPandas(flier(names, seed, level, last), columns))
        settled.append(flown.where("p = 0 or p = 1"))
        left, level = flown.where("p > 0 and p < 1"), level + 1
        if last:
            break
    done = settled[0]
    for x in settled[1:]:
        done = done.unionByName(x)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return done.select("doc_id", "tk", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document as often as it is taken, with all its columns."""
    place = lambda order: F.row_number().over(Window.partitionBy("doc_id", "tk", "source").orderBy(order))
    drawn = mix(documents, **options).withColumn("n", place(F.desc("copies"))).where("copies > 0").select(F.col("doc_id").alias("d_id"), F.col("tk").alias("d_tk"), F.col("source").alias("d_source"), F.col("n").alias("d_n"), "copies")
    # the row is nested, so that none of its columns can meet one of these
    docs = documents.select("doc_id", "source", text_key().alias("tk"), whole_row(documents).alias("h"), F.struct("*").alias("row")).withColumn("n", place(F.col("h")))
    joined = docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("tk") == F.col("d_tk")) & F.col("source").eqNullSafe(F.col("d_source")) & (F.col("n") == F.col("d_n")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
