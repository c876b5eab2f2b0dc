"""Exact top-k inner-product search over an impact-ordered index.

Components become integers floor(scale * x). Spark deals vectors into shards;
each shard is packed into blocks, and a block's index keeps, for each dimension
and each sign of a query's component, its postings in segments of equal
quantised impact, highest first. An impact is the distance of a component from
the block's lowest (for a negative query component: from its highest) value, so
all contributions are non-negative and the rest of the score is a constant.

A query goes through its segments score at a time: in descending contribution
|query component| * quantised impact, wave by wave. After each wave the
accumulators are lower bounds; adding the largest possible remainder gives upper
bounds. It stops only when the bounds prove that few enough vectors can still be
members; these are rescored exactly. When segments run out, the same proof is
taken with the quantisation error alone, so the result is always exact.

Queries are packed into blocks as well and go to every shard: the stated query
set against all rows, in blocks. A shard keeps k results a query. The number of
shards follows the number of rows.

Defined results: vectors that are null or hold null or non-finite components
take no part; a shorter vector, and an empty one, counts as padded with zeros; rows that repeat a
vec_id are separate candidates, and a query sees none of its own id; ties go to
the smaller vec_id; a null vec_id takes no part; an empty table gives no rows;
other columns are ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 16
#: least number of shards, and vectors of a shard from which on there are more
SHARDS, SHARD = 24, 50_000
BLOCK = 4096
QUERY_BLOCK = 256


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, x as double."""
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(whole).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


class Block:
    """Impact-ordered postings of up to BLOCK vectors."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, levels: int = LEVELS) -> None:
        self.ids, self.v = ids, v
        self.low, self.high = v.min(0), v.max(0)
        self.step = np.maximum(1, -((self.low - self.high - 1) // levels))  # ceil((high - low + 1) / levels)
        self.order, self.level, self.until = [], [], []
        for impact in (v - self.low, self.high - v):
            level = impact // self.step
            order = np.argsort(-level, axis=0, kind="stable").T
            self.order.append(order.astype(np.int32))
            ranked = np.take_along_axis(level, order.T, 0).T
            self.level.append(ranked)
            # until[d, l]: postings of dimension d whose level is l or more
            self.until.append(np.stack([(level >= at).sum(0) for at in range(levels + 1)], 1))

    def search(self, q: np.ndarray, k: int, least: int | None, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and exact scores of every possible member of the query's top k.

        ``least`` is a score that a member must reach (k better ones are known).
        """
        n, levels = len(self.ids), self.until[0].shape[1] - 1
        sign, weight = (q < 0).astype(int), np.abs(q)
        constant = int((q * np.where(q < 0, self.high, self.low)).sum())
        unit = weight * self.step  # contribution of one level
        skip = int((self.ids == own).sum())
        scores = np.zeros(n, dtype=np.int64)
        reached = np.full(len(q), levels)  # levels from here up are processed
        done = np.zeros(len(q), dtype=int)
        dims = np.flatnonzero(weight)
        wave = int(unit.max(initial=0)) * (levels - 1)
        while True:
            wave //= 2
            goal = np.where(unit > 0, -(-max(wave, 1) // np.maximum(unit, 1)), 0)
            goal = np.minimum(reached, np.maximum(goal, 0) if wave >= max(1, int(unit[dims].min(initial=1))) else 0)
            at, value = [], []
            for d in dims:
                if goal[d] < reached[d]:
                    s = sign[d]
                    a, b = done[d], self.until[s][d, goal[d]]
                    if b > a:
                        at.append(self.order[s][d, a:b])
                        value.append(self.level[s][d, a:b] * unit[d])
                        done[d] = b
                    reached[d] = goal[d]
            if at:
                np.add.at(scores, np.concatenate(at), np.concatenate(value))
            # what a vector can still gain: unprocessed levels, or the quantisation error
            slack = int((weight * (np.maximum(reached, 1) * self.step - 1)).sum())
            floor_ = least - constant if least is not None else None
            if n - skip > k:
                known = int(np.partition(scores, n - k - skip)[n - k - skip]) if not skip else int(np.partition(scores[self.ids != own], n - k - skip)[n - k - skip])
                floor_ = known if floor_ is None else max(known, floor_)
            members = np.flatnonzero(scores + slack >= floor_) if floor_ is not None else np.arange(n)
            if len(members) <= max(4 * k, n // 16) or not reached[dims].any():
                break
        members = members[self.ids[members] != own]
        return members, self.v[members] @ q


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def packed(frame: DataFrame, part: str, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors of one part: part, block, dims, ids and components as bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = 0

        def out(p: int, rows: list) -> pa.RecordBatch:
            dims = max(1, *(len(x) for _, x in rows))
            v = np.zeros((len(rows), dims), dtype=np.int64)
            for i, (_, x) in enumerate(rows):
                v[i, : len(x)] = x
            return pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "block": pa.array([made], pa.int32()), "dims": pa.array([dims], pa.int32()), "ids": pa.array([np.array([r[0] for r in rows], np.int64).tobytes()], pa.binary()), "v": pa.array([v.tobytes()], pa.binary())})

        for batch in batches:
            parts, ids, vs = (batch.column(i) for i in range(3))
            for p, i, x in zip(parts.to_pylist(), ids.to_pylist(), vs, strict=True):
                rows = held.setdefault(p, [])
                rows.append((i, x.values.to_numpy()))
                if len(rows) == size:
                    yield out(p, held.pop(p))
                    made += 1
        for p, rows in held.items():
            yield out(p, rows)
            made += 1

    return frame.select(part, "vec_id", "v").mapInArrow(task, "part int, block int, dims int, ids binary, v binary")


def unpack(ids: bytes, v: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(v, np.int64).reshape(-1, dims)


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, shards: int | None = None, levels: int = LEVELS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows other than its own."""
    rows = usable(vectors, scale)
    shards = shards or max(SHARDS, -(-vectors.count() // SHARD))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    index = packed(rows.select(shard.alias("p"), "vec_id", "v").repartition(shards, "p"), "p", BLOCK)
    group = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    queries = packed(rows.where(is_query).select(group.alias("p"), "vec_id", "v").repartition(shards, "p"), "p", QUERY_BLOCK)
    sent = queries.select(F.col("part").alias("q_part"), F.col("block").alias("q_block"), F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("part"))
    pairs = sent.join(index, "part").sortWithinPartitions("part", "block")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if (now := (r["part"], r["block"])) != key:
                    key, block = now, Block(*unpack(r["ids"], r["v"], r["dims"]), levels)
                q_ids, q = unpack(r["q_ids"], r["q"], r["q_dims"])
                dims = r["dims"]
                q = np.pad(q, ((0, 0), (0, max(0, dims - q.shape[1]))))[:, :dims]
                for i, x in zip(q_ids.tolist(), q, strict=True):
                    old = found.get(i)
                    least = int(old[1][-1]) if old is not None and len(old[1]) == k else None
                    at, scores = block.search(x, k, least, i)
                    ids = block.ids[at]
                    if old is not None:
                        ids, scores = np.concatenate([old[0], ids]), np.concatenate([old[1], scores])
                    found[i] = best(ids, scores, k)
                if len(found) >= 65_536:
                    yield rows_of(found)
                    found = {}
        if found:
            yield rows_of(found)

    def rows_of(found: dict) -> pa.RecordBatch:
        n = [len(s) for _, s in found.values()]
        return pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(np.array(list(found), np.int64), n)), "vec_id": pa.array(np.concatenate([i for i, _ in found.values()])), "score": pa.array(np.concatenate([s for _, s in found.values()]))})

    members = pairs.select("part", "block", "dims", "ids", "v", "q_dims", "q_ids", "q").mapInArrow(task, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
