"""Exact ranked lexical search over an index that recursive graph bisection orders.

Build (``build``):

1. A tree of bisections is fitted on a bounded sample of the documents (``SAMPLE``
   rows by hash, at most ``SAMPLE_TERMS`` terms of each): halves of a node swap
   documents while that lowers the logarithmic cost of the gaps between the
   postings of their terms. What a node learned is a weight for each of at most
   ``FEATURES`` terms, towards its left or its right half.
2. Every document goes down the tree by the mean weight of its terms, in the
   task that reads its text, and so gets its cluster. Documents that share terms
   get neighbouring clusters. Clusters larger than ``shard`` documents are cut
   into shards of about that size, by row, so copies however many fill no task.

Search (``search``):

3. Postings of the items' terms are packed by shard, impacts of a term and its
   documents side by side, documents by their place in the shard.
4. A shard's bound for an item is the sum over the item's terms of weight times
   the largest impact in the shard. An item visits its shards by descending
   bound, in waves; after each wave it goes on only while the next bounds reach
   the score of its k-th best document. It stops on that proof alone, so results
   are exact. Equal bounds are visited: an equal score may have a smaller doc_id.
5. A shard scores an item term by term into one array and returns its k best;
   places are mapped back to doc_ids, which break ties.

Scores are whole numbers as the contract of the query defines them.

Defined results: null and empty texts have no terms, match nothing and count
nowhere; rows with one doc_id are separate candidates; a null doc_id takes part
in the counts and not in the results; rows with one item_id are one item with
the terms of all; a null item_id and items without terms have no rows; empty
tables give no rows; other columns are ignored. A very long text is one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubicost.llm.common import discard, map_slices, saved, tidy

#: runs of letters and digits in ASCII and of anything beyond
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SAMPLE, SAMPLE_TERMS, FEATURES = 8192, 512, 65_536
#: levels of the tree: at least, at most; documents of a shard, about
LEAST_DEPTH, MOST_DEPTH, SHARD = 3, 7, 4096
ROUNDS = 12


def term_counts(text: str | None, pattern: re.Pattern) -> Counter:
    # bytes.lower changes A-Z alone
    return Counter(pattern.findall(text.encode().lower().decode())) if text else Counter()


@dataclass
class Tree:
    """Bisections by heap number (root 1): weights of the features towards the right half, and where the halves part."""

    features: dict[str, int]
    weights: np.ndarray
    middle: np.ndarray
    depth: int

    def route(self, at: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """The cluster (0 .. 2**depth - 1) of each of n documents, from feature numbers and their documents, in order."""
        node = np.ones(n, dtype=np.int64)
        known = np.maximum(np.bincount(owner, minlength=n), 1)
        for _ in range(self.depth):
            lean = np.bincount(owner, weights=self.weights[node[owner], at], minlength=n) / known
            node = 2 * node + (lean > self.middle[node])
        return node - (1 << self.depth)


def cost(d: np.ndarray, n: int) -> np.ndarray:
    """Bits of the gaps of a term with d postings among n documents."""
    return d * np.log2(n / (d + 1))


def split(owner: np.ndarray, at: np.ndarray, n: int, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Halves n documents: which are right, and how much each term leans to the right."""
    right = np.arange(n) % 2 == 1

    def moves() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What it saves for each term when one of its documents changes from left to right and back, and the lean."""
        b = np.bincount(at, weights=right[owner], minlength=terms)
        a = np.bincount(at, minlength=terms) - b
        n_b = max(int(right.sum()), 1)
        n_a = max(n - n_b, 1)
        now = cost(a, n_a) + cost(b, n_b)
        over = now - cost(np.maximum(a - 1, 0), n_a) - cost(b + 1, n_b)
        back = now - cost(a + 1, n_a) - cost(np.maximum(b - 1, 0), n_b)
        lean = (cost(a + 1, n_a) - cost(a, n_a)) - (cost(b + 1, n_b) - cost(b, n_b))
        return over, back, lean

    for _ in range(ROUNDS):
        over, back, lean = moves()
        gain = np.bincount(owner, weights=np.where(right[owner], back[at], over[at]), minlength=n)
        left_first, right_first = (np.flatnonzero(side)[np.argsort(-gain[side], kind="stable")] for side in (~right, right))
        m = min(len(left_first), len(right_first))
        swap = int((gain[left_first[:m]] + gain[right_first[:m]] > 1e-9).sum())
        if not swap:
            break
        right[left_first[:swap]], right[right_first[:swap]] = True, False
    return right, moves()[2]


def fit(sample: list[np.ndarray], features: dict[str, int], depth: int) -> Tree:
    """The tree of bisections of a sample of documents, each the numbers of its features."""
    weights, middle = np.zeros((1 << depth, max(len(features), 1)), dtype=np.float32), np.zeros(1 << depth)

    def grow(node: int, members: list[int]) -> None:
        if node >= 1 << depth or len(members) < 2:
            return
        own = [sample[i] for i in members]
        owner, at = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
        _, lean = split(owner, at, len(own), len(features))
        weights[node] = lean
        mean = np.bincount(owner, weights=weights[node, at], minlength=len(own)) / np.maximum(np.bincount(owner, minlength=len(own)), 1)
        middle[node] = np.median(mean)
        # as all documents will go
        goes = mean > middle[node]
        grow(2 * node, [i for i, g in zip(members, goes, strict=True) if not g])
        grow(2 * node + 1, [i for i, g in zip(members, goes, strict=True) if g])

    if features:
        grow(1, list(range(len(sample))))
    return Tree(features, weights, middle, depth)


def sampled(documents: DataFrame, count: int, most: int) -> tuple[list[np.ndarray], dict[str, int]]:
    """At most ``most`` documents, drawn by hash, as numbers of features, and the features: the most frequent terms that tell neighbours apart.

    Of a long document the terms of smallest hash count. What goes through the
    driver is at most ``FEATURES`` terms and ``most`` * ``SAMPLE_TERMS`` numbers.
    """

    def terms():
        pattern = re.compile(TERM)

        def work(cols):
            return {"h": cols["h"], "terms": [sorted(term_counts(t, pattern), key=lambda x: (crc32(x.encode()), x))[:SAMPLE_TERMS] for t in cols["text"]]}

        return work

    grain = 1 << 30
    h = F.xxhash64("doc_id", "text")
    drawn = documents.where(F.col("text").isNotNull()).select(h.alias("h"), "text").where(F.pmod("h", F.lit(grain)) < math.ceil(grain * min(1.0, 1.3 * most / max(count, 1))))
    rows = saved(map_slices(drawn, terms, "h long, terms array<string>").orderBy("h").limit(most))
    # the terms of a single document and those of most say nothing about neighbours
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    useful = df.where((F.col("df") > 1) & (F.col("df") <= max(2, 0.6 * rows.count()))).orderBy(F.desc("df"), "term").limit(FEATURES).collect()
    features = {r["term"]: i for i, r in enumerate(useful)}
    shared = documents.sparkSession.sparkContext.broadcast(features)

    def numbers():
        def work(cols):
            return {"at": [np.array([shared.value[t] for t in c if t in shared.value], dtype=np.int32).tobytes() for c in cols["terms"]]}

        return work

    lists = [np.frombuffer(r["at"], np.int32) for r in map_slices(rows, numbers, "at binary").collect()]
    discard(rows)
    return lists, features


def build(documents: DataFrame, shard: int = SHARD, depth: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """row, doc_id, n, terms, tfs, cluster and shard of every document, written once."""
    count = documents.count()
    depth = depth or min(MOST_DEPTH, max(LEAST_DEPTH, math.ceil(math.log2(max(count, 1) / shard))))
    shared = documents.sparkSession.sparkContext.broadcast(fit(*sampled(documents, count, sample), depth))

    def start():
        pattern, tree = re.compile(TERM), shared.value

        def work(cols):
            counts = [term_counts(t, pattern) for t in cols["text"]]
            known = [[tree.features[t] for t in c if t in tree.features] for c in counts]
            owner = np.repeat(np.arange(len(known)), [len(x) for x in known])
            at = np.fromiter((i for x in known for i in x), dtype=np.int64, count=len(owner))
            return {
                "doc_id": cols["doc_id"],
                "n": [c.total() for c in counts],
                "cluster": tree.route(at, owner, len(counts)).tolist(),
                "terms": [list(c) for c in counts],
                "tfs": [list(c.values()) for c in counts],
            }

        return work

    routed = map_slices(documents.select(F.col("doc_id").cast("long"), "text"), start, "doc_id long, n long, cluster int, terms array<string>, tfs array<int>", rows=128)
    rows = saved(routed.withColumn("row", F.monotonically_increasing_id()))
    # at most 2 ** MOST_DEPTH rows
    pieces = rows.groupBy(F.col("cluster").alias("of")).agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")
    return rows.join(F.broadcast(pieces), F.col("cluster") == F.col("of")).select("row", "doc_id", "n", "terms", "tfs", "cluster", (F.col("cluster").cast("long") * (1 << 32) + piece).alias("shard"))


def item_terms(items: DataFrame, key: str = "item_id") -> DataFrame:
    """item_id, term: the distinct terms of each item."""

    def start():
        pattern = re.compile(TERM)

        def work(cols):
            rows = [(i, t) for i, text in zip(cols["item_id"], cols["text"], strict=True) for t in term_counts(text, pattern)]
            return {"item_id": [i for i, _ in rows], "term": [t for _, t in rows]}

        return work

    return map_slices(items.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item_id"), "text"), start, "item_id long, term string").distinct()


def packed(postings: DataFrame) -> DataFrame:
    """shard, ids, ts, starts, places, impacts: each shard's postings as arrays, terms in order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        last = None

        def out() -> pa.RecordBatch:
            t, doc, row, u = (np.concatenate(x) for x in zip(*held, strict=True))
            # rows in order are the places
            _, first, place = np.unique(row, return_index=True, return_inverse=True)
            order = np.lexsort((place, t))
            ts, starts = np.unique(t[order], return_index=True)
            values = {"shard": np.array([last]), "ids": doc[first], "ts": ts, "starts": np.append(starts, len(t)), "places": place[order].astype(np.int32), "impacts": u[order].astype(np.int32)}
            return pa.RecordBatch.from_pydict({k: pa.array(v) if k == "shard" else pa.array([v.tobytes()], pa.binary()) for k, v in values.items()})

        for batch in batches:
            shard, *rest = (batch.column(i).to_numpy() for i in range(5))
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    if held and shard[a] != last:
                        yield out()
                        held.clear()
                    last = int(shard[a])
                    held.append(tuple(x[a:b] for x in rest))
        if held:
            yield out()

    placed = postings.select("shard", "t", "doc_id", "row", "u").repartition("shard").sortWithinPartitions("shard")
    return placed.mapInArrow(task, "shard long, ids binary, ts binary, starts binary, places binary, impacts binary")


def largest(blocks: DataFrame) -> DataFrame:
    """shard, t, most: the largest impact of each term in a shard."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, ts, starts, impacts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ts, starts, impacts = np.frombuffer(ts, np.int64), np.frombuffer(starts, np.int64), np.frombuffer(impacts, np.int32)
                yield pa.RecordBatch.from_pydict({"shard": np.full(len(ts), shard), "t": ts, "most": np.maximum.reduceat(impacts, starts[:-1]).astype(np.int64)})

    return blocks.select("shard", "ts", "starts", "impacts").mapInArrow(task, "shard long, t long, most long")


def visit(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best of each visited shard (queries: shard, item_id, ts, ws).

    A shard's block comes first and its queries stream by, so no block is copied.
    """
    asked = queries.select("shard").distinct().withColumnRenamed("shard", "of")
    own = blocks.join(asked, F.col("shard") == F.col("of"), "left_semi").select("shard", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("array<long>").alias("qt"), F.lit(None).cast("array<long>").alias("qw"), "ids", "ts", "starts", "places", "impacts")
    asking = queries.select("shard", "item_id", F.col("ts").alias("qt"), F.col("ws").alias("qw"), *[F.lit(None).cast("binary").alias(c) for c in ("ids", "ts", "starts", "places", "impacts")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                item = batch.column(1)[i].as_py()
                if item is None:
                    raw = [batch.column(c)[i].as_py() for c in range(4, 9)]
                    ids, ts, starts = (np.frombuffer(x, np.int64) for x in raw[:3])
                    places, impacts = (np.frombuffer(x, np.int32) for x in raw[3:])
                    scores = np.zeros(len(ids), dtype=np.int64)
                    continue
                scores[:] = 0
                qt, qw = (np.array(batch.column(c)[i].as_py(), dtype=np.int64) for c in (2, 3))
                at = np.searchsorted(ts, qt)
                for j, w in zip(at.tolist(), qw.tolist(), strict=True):
                    a, b = starts[j], starts[j + 1]
                    scores[places[a:b]] += w * impacts[a:b].astype(np.int64)
                found = np.flatnonzero(scores)
                if len(found) > k:
                    found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k]]
                found = found[np.lexsort((ids[found], -scores[found]))[:k]]
                yield pa.RecordBatch.from_pydict({"item_id": np.full(len(found), item), "doc_id": ids[found], "score": scores[found]})

    return own.unionByName(asking).repartition("shard").sortWithinPartitions("shard", F.col("item_id").asc_nulls_first()).mapInArrow(task, "item_id long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, k: int = 10, width: int = 2) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0; exact."""
    totals = index.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    docs, terms = totals["docs"], totals["terms"] or 1
    wanted = saved(item_terms(items))
    words = saved(wanted.select(F.col("term").alias("word")).distinct().withColumn("t", F.monotonically_increasing_id()))
    each = index.select("shard", "doc_id", "row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("z")).select("shard", "doc_id", "row", "n", F.col("z.terms").alias("term"), F.col("z.tfs").cast("long").alias("tf"))
    length = F.expr(f"10 + (90 * n * {docs}L) div {terms}L")
    hits = each.join(words, F.col("term") == F.col("word")).withColumn("m", length)
    postings = saved(hits.select("shard", "doc_id", "row", "t", F.expr("(1000000000L * tf) div (1000L * tf + 8 * m)").alias("u")))
    df = postings.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weights = df.select("t", F.floor(1000 * F.log((F.lit(2 * docs + 2).cast("double")) / (2 * F.col("df") + 1))).cast("long").alias("w"))
    asked = saved(wanted.join(words, F.col("term") == F.col("word")).select("item_id", "t").join(weights, "t").where("w > 0"))
    blocks = saved(packed(postings.where("doc_id IS NOT NULL")))
    discard(postings)
    tidy(items.sparkSession)

    # a shard only knows the terms it has, so an item asks each shard for those
    bounds = asked.join(largest(blocks), "t").groupBy("item_id", "shard").agg(F.sum(F.col("w") * F.col("most")).alias("bound"), F.sort_array(F.collect_list(F.struct("t", "w"))).alias("q"))
    order = Window.partitionBy("item_id").orderBy(F.desc("bound"), "shard")
    todo = saved(bounds.select("item_id", "shard", "bound", F.col("q.t").alias("ts"), F.col("q.w").alias("ws"), F.row_number().over(order).alias("turn")))
    best_first = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    best, done = None, 0
    while True:
        wave = todo.where((F.col("turn") > done) & (F.col("turn") <= done + width))
        if best is not None:
            known = best.where(F.col("rank") == k).select(F.col("item_id").alias("of"), F.col("score").alias("least"))
            wave = wave.join(known, F.col("item_id") == F.col("of"), "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        wave = saved(wave.select("item_id", "shard", "ts", "ws"))
        # bounds descend, so an item that has none in this wave has none later
        if wave.isEmpty() and best is not None:
            break
        found = visit(blocks, wave, k)
        both = found if best is None else found.unionByName(best.select("item_id", "doc_id", "score"))
        new = saved(both.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
        if best is not None:
            discard(best)
        discard(wave)
        best, done, width = new, done + width, width * 4
    for x in (blocks, todo, wave):
        discard(x)
    return best
