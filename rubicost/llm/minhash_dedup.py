"""Near-duplicate groups by one-permutation MinHash with optimal densification.

1. One hash of each shingle serves for all of a signature: its low bits name a
   bin, the rest is its value, and a bin keeps its least value. An empty bin
   takes the value of a bin that isn't, found by a fixed sequence of hashes of
   its own number (optimal densification); the sequence does not depend on the
   set, so equal fills lend alike.
2. Equal sets collapse to one representative (two 64-bit hashes and the size).
3. ``BANDS`` bands of ``ROWS`` bins each; sets with an equal band are in one
   bucket. A pair at the limit of 85 % shares no bucket with a probability of
   (1 - 0.85 ** ROWS) ** BANDS, 4e-13 for 50 bands of 5 bins.
4. Star-shaped candidate edges: a bucket's smallest member is its hub, and each
   other member is one edge to the hub, so candidates number at most members
   less one, however large the bucket. The hub is found by aggregation and
   joined with the members; no bucket is held or streamed by a task.
5. Edges whose signatures agree in far fewer bins than linked ones do are left
   out (``DEVIATIONS`` standard deviations, a chance below 1e-12); the others
   are measured on the full sets, from the texts.
6. A star alone would lose links of members that are far from their hub. Buckets
   whose members are not all in one component after the stars stay open: their
   members meet in blocks, those of the largest component never among
   themselves, pairs of one component never, and a pair only in the first bucket
   that it shares. They meet with their signatures first; members that these
   leave anyone to be measured against meet again, with their full sets. A link found there joins its two components for
   the task, so a task returns fewer links than it has members. There are as many
   blocks as the bytes of a bucket need: a member of a bucket that two blocks hold
   is one row, or one for each block beyond. Blocks are dealt by range, so that
   large buckets don't gather in a task.

Links are confirmed on the full sets: stars on the texts' shingles, the others
on all 64-bit hashes of these. Only a link that no band proposes is lost, with
the probability stated above.

Defined results: null texts and texts without words have an empty set and link
with nothing; with fewer words than a shingle the whole sequence is the one
shingle; rows with one doc_id are one node, each of their texts counts; a null
doc_id takes no part and its component is null, and it is kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubicost.llm.common import GOLDEN, discard, map_slices, mix64, saved, signed, slices, tidy
from rubicost.llm.jaccard_metric import checked, components, runs, set_hash, shingle_hashes, texts_of

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 50, 5
#: how far below its mean the agreement of a linked pair's signatures may be
DEVIATIONS = 7.5
#: members of an open bucket in a block, at most: two blocks are compared in one task
BLOCK = 8192
#: bytes of what the members of a block bring along, on average
VOLUME = 16 << 20

SCAN = "doc_id long, n_shingles long, s1 long, s2 long, signature binary"


def densification(bins: int, tries: int = 64) -> np.ndarray:
    """For each bin (row) the bins that it asks for a value, in order."""
    place = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(tries) + np.arange(tries, dtype=np.uint64)
    return (mix64((place + np.uint64(1)) * GOLDEN) % np.uint64(bins)).astype(np.int64)


def signature(h: np.ndarray, lenders: np.ndarray) -> np.ndarray:
    """16 bits for each bin of a set that isn't empty, from 64-bit hashes of its shingles."""
    bins = len(lenders)
    h = mix64(h)
    at = (h % np.uint64(bins)).astype(np.int64)
    least = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, at, h // np.uint64(bins))
    filled = np.zeros(bins, dtype=bool)
    filled[at] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        asked = filled[lenders[empty]]
        # the tries after the last are those bins in a row from the last one on
        first = asked.argmax(axis=1)
        source = lenders[empty, first]
        for i in np.flatnonzero(~asked.any(axis=1)):
            around = np.roll(np.arange(bins), -int(lenders[empty[i], -1]))
            source[i] = around[filled[around]][0]
        least[empty] = least[source]
    # the value alone would be small in full bins, so it is scrambled before it is cut
    return (mix64(least) >> np.uint64(48)).astype("<u2")


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """64-bit keys of the bands of signatures (rows): band number and content."""
    n, bins = signatures.shape
    parts = signatures.reshape(n, bands, bins // bands).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (n, bands)).copy()
    for i in range(bins // bands):
        key = mix64(key ^ parts[:, :, i] * np.uint64(0x9E3779B97F4A7C15 + 2 * i))
    return signed(key)


def least_agreement(bins: int, percent: int) -> int:
    """How many bins of linked signatures agree at least, but for a negligible chance."""
    p = percent / 100
    return max(0, math.floor(bins * p - DEVIATIONS * math.sqrt(bins * p * (1 - p))))


def scan(documents: DataFrame, size: int, bins: int) -> DataFrame:
    """Set size, two hashes of the set and its signature, for each row."""

    def start():
        lenders = densification(bins)

        def work(cols):
            sets = [shingle_hashes(t, size) for t in cols["text"]]
            return {
                "doc_id": cols["doc_id"],
                "n_shingles": [len(h) for h in sets],
                "s1": [set_hash(h) for h in sets],
                "s2": [set_hash(h, 0x8EBC6AF09C88C6E3) for h in sets],
                "signature": [signature(h, lenders).tobytes() if len(h) else b"" for h in sets],
            }

        return work

    return map_slices(documents.select(F.col("doc_id").cast("long"), "text"), start, SCAN, rows=64)


def postings(rows: DataFrame, bands: int) -> DataFrame:
    """key, s1: the buckets of each signature."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1024, 4 << 20):
                raw = np.stack([np.frombuffer(x, "<u2") for x in part.column(1).to_pylist()])
                keys = band_keys(raw, bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), bands))], names=["key", "s1"])

    return rows.select("s1", "signature").mapInArrow(task, "key long, s1 long")


def buckets(posted: DataFrame) -> DataFrame:
    """key, s1, hub: the members of buckets of two or more, with the smallest."""
    hubs = posted.groupBy(F.col("key").alias("k")).agg(F.min("s1").alias("hub"), F.max("s1").alias("top")).where("hub < top")
    return posted.join(hubs, F.col("key") == F.col("k")).select("key", "s1", "hub")


def agreeing(pairs: DataFrame, signatures: DataFrame, least: int) -> DataFrame:
    """x, y of the pairs that sizes and signatures don't rule out."""
    left = signatures.select(F.col("s1").alias("x"), F.col("n").alias("n_x"), F.col("signature").alias("a"))
    right = signatures.select(F.col("s1").alias("y"), F.col("n").alias("n_y"), F.col("signature").alias("b"))

    def start():
        def work(cols):
            if not cols["x"]:
                return {"x": [], "y": []}
            a, b = (np.frombuffer(b"".join(cols[k]), "<u2").reshape(len(cols["x"]), -1) for k in "ab")
            keep = np.flatnonzero((a == b).sum(axis=1) >= least).tolist()
            return {k: [cols[k][i] for i in keep] for k in ("x", "y")}

        return work

    return map_slices(pairs.join(left, "x").join(right, "y"), start, "x long, y long", rows=2048)


def sizes_fit(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def open_cells(met: DataFrame, labels: DataFrame) -> DataFrame:
    """key, s1, label, top of the members of buckets that hold several components, ``top`` being the largest."""
    named = met.join(labels, "s1").select("key", "s1", "label")
    kinds = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m")).groupBy(F.col("key").alias("k"))
    mixed = kinds.agg(F.sum("m").alias("size"), F.max(F.struct("m", "label")).alias("z"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1 AND size > 2")
    return named.join(mixed, F.col("key") == F.col("k")).select("key", "s1", "label", F.col("z.label").alias("top"))


def full_sets(documents: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """of, hashes: all shingles of the wanted representatives (s1, rep), as sorted 64-bit hashes."""

    def start():
        def work(cols):
            return {"of": cols["s1"], "hashes": [shingle_hashes(t, size).tobytes() for t in cols["text"]]}

        return work

    return map_slices(texts_of(documents, wanted, size), start, "of long, hashes binary", rows=64).dropDuplicates(["of"])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def first_shared(i: int, s1: np.ndarray, n: np.ndarray, component: np.ndarray, own: np.ndarray, raw: np.ndarray, keys: np.ndarray, key: int, apart: bool, least: int, percent: int) -> np.ndarray:
    """Members behind i of other components, of fitting size and signature, of which this bucket is the first shared one."""
    ok = np.flatnonzero((component != component[i]) & sizes_fit(n, n[i], percent) & (s1 > s1[i]) & (own != own[i] if apart else True))
    ok = ok[(raw[ok] == raw[i]).sum(axis=1) >= least]
    return ok[keys[i, (keys[ok] == keys[i]).argmax(axis=1)] == key]


def spanning_links(s1: np.ndarray, n: np.ndarray, label: np.ndarray, own: np.ndarray, raw: np.ndarray, sets: list[np.ndarray], key: int, bands: int, apart: bool, least: int, percent: int) -> tuple[list[int], list[int]]:
    """Links between members of different components, of which this bucket is the first shared one; those that join components so far apart."""
    component = np.unique(label, return_inverse=True)[1]
    keys = band_keys(raw, bands)
    a, b = [], []
    for i in range(len(s1)):
        for j in first_shared(i, s1, n, component, own, raw, keys, key, apart, least, percent).tolist():
            if component[j] != component[i]:
                shared = common(sets[i], sets[j])
                if 100 * shared >= percent * (n[i] + n[j] - shared):
                    component[component == component[j]] = component[i]
                    a.append(int(s1[i]))
                    b.append(int(s1[j]))
    return a, b


def with_blocks(cells: DataFrame, volume: Column, block: int) -> DataFrame:
    """cells with many, rest: the blocks of each bucket's largest component and of its other members, by number and bytes."""
    top = F.col("label") == F.col("top")

    def needed(these: Column) -> Column:
        parts = F.greatest(F.sum(these.cast("int")) / block, F.sum(F.when(these, volume).otherwise(0)) / VOLUME)
        return F.ceil(parts).cast("int")

    own = cells.groupBy(F.col("key").alias("k")).agg(needed(top).alias("many"), needed(~top).alias("rest"))
    # a bucket that one block holds is one
    own = own.select("k", F.when(F.greatest("many", "rest") > 1, F.col("many")).otherwise(0).alias("many"), F.greatest("rest", F.lit(1)).alias("rest"))
    return cells.join(own, F.col("key") == F.col("k")).drop("k")


def met_in_blocks(full: DataFrame, *more: str) -> DataFrame:
    """Members of open buckets by key and pair of blocks (lo, hi), placed and sorted so; those of the largest component meet the others only."""
    top = (F.col("label") == F.col("top")) & (F.col("many") > 0)
    place = F.xxhash64("s1", "key")
    own = F.when(top, F.pmod(place, F.greatest("many", F.lit(1)))).otherwise(F.col("many") + F.pmod(place, F.col("rest"))).cast("int")
    # blocks of the largest component meet those of the others, and not each other
    others = F.sequence(F.when(top, F.col("many")).otherwise(F.lit(0)), F.col("many") + F.col("rest") - 1)
    meeting = full.withColumn("own", own).withColumn("other", F.explode(others)).select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "s1", "label", "n", "signature", *more)
    return meeting.repartitionByRange("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "s1")


def arrays(g: pa.Table) -> tuple:
    """Ids, sizes, components, blocks and signatures of members that meet."""
    s1, n, label, own = (g[c].to_numpy() for c in ("s1", "n", "label", "own"))
    return s1, n, label, own, np.frombuffer(b"".join(g["signature"].to_pylist()), "<u2").reshape(len(s1), -1)


def measurable(cells: DataFrame, signatures: DataFrame, bands: int, least: int, percent: int, block: int) -> DataFrame:
    """The cells of members that have anyone to be measured against in their bucket, told by sizes and signatures alone.

    A member is one row for each bucket, however many it would be measured against.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            g = pa.Table.from_batches(held)
            s1, n, label, own, raw = arrays(g)
            key, lo, hi = (g[k][0].as_py() for k in ("key", "lo", "hi"))
            keys, has = band_keys(raw, bands), np.zeros(len(s1), dtype=bool)
            for i in range(len(s1)):
                ok = first_shared(i, s1, n, label, own, raw, keys, key, lo != hi, least, percent)
                has[ok] = True
                has[i] |= len(ok) > 0
            return pa.RecordBatch.from_pydict({"k": pa.array([key] * int(has.sum()), pa.int64()), "s": pa.array(s1[has], pa.int64())})

        yield from runs(batches, 3, held, flush)

    # a signature and the keys of its bands
    full = with_blocks(cells, F.lit((2 * ROWS + 8) * bands), block).join(signatures, "s1")
    some = met_in_blocks(full).mapInArrow(task, "k long, s long").distinct()
    return cells.join(some, (F.col("key") == F.col("k")) & (F.col("s1") == F.col("s"))).drop("k", "s")


def open_links(cells: DataFrame, signatures: DataFrame, sets: DataFrame, bands: int, least: int, percent: int, block: int) -> DataFrame:
    """x, y: links between components that share an open bucket; a task holds at most two blocks of members."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            g = pa.Table.from_batches(held)
            s1, n, label, own, raw = arrays(g)
            sets = [np.frombuffer(x, np.uint64) for x in g["hashes"].to_pylist()]
            key, lo, hi = (g[k][0].as_py() for k in ("key", "lo", "hi"))
            a, b = spanning_links(s1, n, label, own, raw, sets, key, bands, lo != hi, least, percent)
            return pa.RecordBatch.from_pydict({"x": pa.array(a, pa.int64()), "y": pa.array(b, pa.int64())})

        yield from runs(batches, 3, held, flush)

    sized = cells.join(signatures.select("s1", F.col("n").alias("m")), "s1")
    full = with_blocks(sized, 8 * F.col("m"), block).join(signatures, "s1").join(sets, F.col("s1") == F.col("of"))
    return met_in_blocks(full, "hashes").mapInArrow(task, "x long, y long").distinct()


def join(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents."""
    least = least_agreement(bands * rows, percent)
    scanned = saved(scan(documents, size, bands * rows))
    real = scanned.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = saved(real.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    named = saved(scanned.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")))
    # the sets of one id are one node: its representatives are linked
    several = named.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
    bound = several.join(named.select("doc_id", F.col("rep").alias("b")), "doc_id").where("a <> b").select("a", "b")

    signatures = saved(real.groupBy("s1").agg(F.first("n_shingles").alias("n"), F.first("signature").alias("signature")))
    discard(scanned)
    met = saved(buckets(postings(signatures, bands)))
    tidy(documents.sparkSession)
    stars = met.where("s1 <> hub").select(F.col("hub").alias("x"), F.col("s1").alias("y")).distinct()
    links = checked(documents, agreeing(stars, signatures, least), classes, size, percent).unionByName(bound)
    labels = components(links)
    own = classes.join(labels, F.col("rep") == F.col("v"), "left").select("s1", F.coalesce("label", "rep").alias("label"))
    cells = saved(open_cells(met, own))
    tidy(documents.sparkSession)
    if not cells.isEmpty():
        # full sets travel only for members that have anyone to be measured against
        cells, every = saved(measurable(cells, signatures, bands, least, percent, block)), cells
        discard(every)
        wanted = saved(cells.select("s1").distinct().join(classes, "s1").select("s1", "rep"))
        sets = saved(full_sets(documents, wanted, size))
        found = saved(open_links(cells, signatures, sets, bands, least, percent, block))
        left, right = (classes.select(F.col("s1").alias(s), F.col("rep").alias(r)) for s, r in (("x", "a"), ("y", "b")))
        labels = components(found.join(left, "x").join(right, "y").select("a", "b"), labels)
        for x in (wanted, sets, found):
            discard(x)
    for x in (met, signatures, cells):
        discard(x)
    # a node is its own component where it has no link
    final = named.join(labels, F.col("rep") == F.col("v"), "left").select("doc_id", "n_shingles", F.coalesce("label", "rep", "doc_id").alias("component_id"))
    return final.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
