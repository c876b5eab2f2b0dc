"""Exact n-gram Jaccard join in the metric space of shingle sets.

Documents are sets of word shingles; the Jaccard distance is a metric. Two
documents link when their similarity is at least ``percent`` / 100. The result
is the connected component of each document.

1. Equal sets collapse to one representative (two 64-bit hashes and the size).
2. First-level regions. Nearly all documents lie at distance 1 of each other,
   where a pivot says nothing, so regions are cells of documents that agree on
   a slice of the shingle universe. Sizes fall into classes; a class has more
   slices than linked documents of its sizes can have differing shingles, and
   some to spare. A document names one cell more than it can have differing
   shingles from any it links with, and leaves out the slices with the fewest
   shingles (later ones first): of two sets that overlap in more members than
   either leaves out, in one order for all, a common one stays in both. A slice
   of a single shingle is what documents share by chance, ever more of them the
   more there are; hardly any names a cell.
3. Each cell's smallest member is its pivot and is measured against all others,
   linearly in its size. Members within the radius link to the pivot; pairs in
   one component are settled, which ends cells of near copies however large.
4. What stays open is joined recursively in bounded tasks: pivots split a
   region into Voronoi regions, and a document also goes to each region whose
   pivot is not farther than its own pivot plus twice the radius (triangle
   inequality). Cells with one pivot form a bundle. A bundle of up to ``BUNDLE``
   bytes of sketches goes to one task, each member once, however many of its
   cells it is in. Cells of larger bundles are dealt out one by one, in blocks
   of ``REGION`` members; members of a cell's largest component never meet each
   other there. A pair is proposed for one cell only: the first of those that
   its two members share.

A slice is kept as 32 bits, which are the hashes of its finer slices. All slices
of a document, and two bits each for how many shingles they hold, are its
sketch. The number of fine slices that differ is a metric
too and never more than the number of shingles that differ, so it rules pairs
out before any text is read (steps 3 and 4). What it doesn't rule out is
measured on the texts' own shingles: hashes only propose.

Defined results: null texts and texts without words have an empty set and link
with nothing; with fewer words than a shingle the whole sequence is the one
shingle; rows with one doc_id are one node, each of their texts counts; a null
doc_id takes no part and its component is null; an empty table gives no rows;
other columns are ignored by ``join`` and pass through ``one_of_each``. There,
of rows with one doc_id the one with the smallest text stays, and rows with a
null doc_id stay.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubicost.llm.common import FOLDERS, discard, free_name, map_slices, mix64, rolling, saved, sieve, signed, slices, tidy, word_hashes, words_of

SHINGLE = 3
PERCENT = 90
CLASS_RATIO = 1.25
REGION = 256
BUNDLE = 32 << 20
LEAF = 12
#: fine slices of a sketch for each shingle, at most about
RESOLUTION = 0.45

SCAN = "doc_id long, n_shingles long, s1 long, s2 long, sigs array<struct<c:int,sketch:binary>>"


def lowered(text: str) -> str:
    """A-Z in lower case, nothing else changed."""
    return text.encode().lower().decode()


def shingles(text: str | None, size: int = SHINGLE) -> set[bytes]:
    words = words_of(lowered(text)) if text else []
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def linked(a: set, b: set, percent: int) -> bool:
    common = len(a & b)
    return bool(common) and 100 * common >= percent * (len(a) + len(b) - common)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes of the shingles of a text."""
    h = word_hashes(lowered(text)) if text else np.zeros(0, dtype=np.uint64)
    if 0 < len(h) < size:
        h = np.concatenate([h, np.full(size - len(h), 0x5851F42D4C957F2D, dtype=np.uint64)])
    return np.unique(rolling(h, size))


class SizeClasses:
    """Classes of set sizes and, for each, how many slices and spare slices it has.

    Linked sets differ in at most (100 - percent) / (100 + percent) of their sizes' sum.
    """

    def __init__(self, percent: int, ratio: float = CLASS_RATIO) -> None:
        self.percent, self.ratio = percent, ratio
        self.least = -(-percent // (100 - percent))  # smaller sets link only if equal
        #: fine slices of a slice; they share its 32 bits
        self.fine = max(f for f in (1, 2, 4) if f == 1 or f <= RESOLUTION * percent / (100 - percent) + 0.5)
        self.tops: list[int] = []

    def at(self, n: int) -> int:
        """The class of size n."""
        while not self.tops or self.tops[-1] < n:
            low = self.tops[-1] + 1 if self.tops else self.least
            self.tops.append(max(low, int(low * self.ratio)))
        return bisect_left(self.tops, n)

    def slices(self, c: int) -> tuple[int, int]:
        least = 2 * self.tops[c] * (100 - self.percent) // (100 + self.percent) + 1
        smallest = (self.tops[c - 1] + 1 if c else self.least) * self.percent / 100
        empty = least * math.exp(-smallest / least)  # as many are expected; more than three deviations beyond are rare
        spare = math.ceil(empty + 3 * math.sqrt(empty))
        return least + spare, spare

    def of(self, n: int) -> range:
        """Classes of the larger member of any linked pair that a set of n members can be in."""
        if n < self.least:
            return range(0)
        return range(self.at(n), self.at(n * 100 // self.percent) + 1)

    def spare(self, c: int, n: int) -> int:
        """How many slices of class c a set of n members can leave out: one less than it has in common with any that it links with."""
        largest = min(self.tops[c], n * 100 // self.percent)
        return self.slices(c)[0] - (n + largest) * (100 - self.percent) // (100 + self.percent) - 1

    def unpacked(self, sketch: bytes) -> np.ndarray:
        """The fine slices of a sketch."""
        return parted(np.frombuffer(sketch, "<u4"))[0].view(f"<u{4 // self.fine}")


#: slices whose numbers of shingles, two bits each, share 32 bits of a sketch
PACKED = 16


def sketch(h: np.ndarray, m: int, fine: int) -> np.ndarray:
    """32 bits for each slice of a set, made of the hashes of its fine slices, then how many members each slice has, up to 3."""
    at = ((h >> np.uint64(20)) % np.uint64(fine * m)).astype(np.int64)
    sums = np.zeros(fine * m, dtype=np.uint64)
    np.add.at(sums, at, mix64(h))
    slices = (mix64(sums) >> np.uint64(64 - 32 // fine)).astype(f"<u{4 // fine}").view("<u4")
    held = np.zeros(-(-m // PACKED) * PACKED, dtype="<u4")
    held[:m] = np.minimum(np.bincount(at // fine, minlength=m), 3)
    return np.concatenate([slices, (held.reshape(-1, PACKED) << BITS).sum(axis=1, dtype="<u4")])


BITS = np.arange(0, 2 * PACKED, 2, dtype="<u4")


def parted(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of a sketch, or of many (rows), and how many members each has, up to 3."""
    n = sketches.shape[-1]
    m = n - -(-n // (PACKED + 1))
    held = (sketches[..., m:, None] >> BITS & np.uint32(3)).astype(np.uint8)
    return sketches[..., :m], held.reshape(*sketches.shape[:-1], -1)[..., :m]


def posted(held: np.ndarray, spare: int) -> np.ndarray:
    """Which slices name a cell: all but the spare number of those with the fewest members, later ones first."""
    out = np.ones(len(held), dtype=bool)
    out[len(held) - 1 - np.argsort(held[::-1], kind="stable")[:spare]] = False
    return out


def cell_keys(c: int, sketch: np.ndarray, spare: int) -> np.ndarray:
    """Cells of a set in a class: the class, the slice's place (24 bits) and its content, side by side."""
    slices, held = parted(sketch)
    at = np.flatnonzero(posted(held, spare)).astype(np.uint64)
    return signed(np.uint64(c & 127) << np.uint64(56) | (at & np.uint64(0xFFFFFF)) << np.uint64(32) | slices[at].astype(np.uint64))


def signatures(h: np.ndarray, classes: SizeClasses) -> list[tuple[int, np.ndarray]]:
    """The classes of a set and its sketch in each."""
    return [(c, sketch(h, classes.slices(c)[0], classes.fine)) for c in classes.of(len(h))]


def set_hash(h: np.ndarray, salt: int = 0) -> int:
    """A hash of the set of some hashes, in any order."""
    return int(signed(mix64(h ^ np.uint64(salt)).sum(dtype=np.uint64, keepdims=True))[0])


def scan(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Set size, two hashes of the set and its sketch by class, for each row."""

    def start():
        classes = SizeClasses(percent)

        def work(cols):
            sets = [shingle_hashes(t, size) for t in cols["text"]]
            return {
                "doc_id": cols["doc_id"],
                "n_shingles": [len(h) for h in sets],
                "s1": [set_hash(h) for h in sets],
                "s2": [set_hash(h, 0x8EBC6AF09C88C6E3) for h in sets],
                "sigs": [[{"c": c, "sketch": x.tobytes()} for c, x in signatures(h, classes)] for h in sets],
            }

        return work

    return map_slices(documents.select("doc_id", "text"), start, SCAN, rows=64)


def postings(rows: DataFrame, percent: int) -> DataFrame:
    """key, s1: the cells of each row's set, from its sketches."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = SizeClasses(percent)
        for batch in batches:
            for part in slices(batch, 64, 1 << 20):
                keys, owner = [], []
                for s1, n, sigs in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    classes.of(n)
                    own = [cell_keys(z["c"], np.frombuffer(z["sketch"], "<u4"), classes.spare(z["c"], n)) for z in sigs]
                    keys += own
                    owner.append(np.full(sum(map(len, own)), s1, dtype=np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owner))], names=["key", "s1"])

    return rows.select("s1", "n_shingles", "sigs").mapInArrow(task, "key long, s1 long")


def with_pivots(postings: DataFrame) -> DataFrame:
    """key, s1, p: the members of cells of two or more, p being the smallest. Cells are streamed, none is held."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = member = pivot = None  # of the row before
        told = False  # whether the pivot's own row of that cell is out
        for batch in batches:
            key, s1 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            fresh = np.empty(len(key), dtype=bool)
            fresh[0] = key[0] != cell
            fresh[1:] = key[1:] != key[:-1]
            again = np.zeros(len(key), dtype=bool)
            again[0] = not fresh[0] and s1[0] == member
            again[1:] = ~fresh[1:] & (s1[1:] == s1[:-1])
            cell, member = key[-1], s1[-1]
            key, s1, fresh = key[~again], s1[~again], fresh[~again]
            if not len(key):
                continue
            begin = np.flatnonzero(fresh)
            run = np.cumsum(fresh)
            p = np.concatenate([[0 if pivot is None else pivot], s1[begin]])[run]
            out = ~fresh
            several = begin[np.append(out[1:], False)[begin]]
            at = np.concatenate([np.flatnonzero(out), several])
            rows = [key[at], s1[at], p[at]]
            if not fresh[0] and not told:
                rows = [np.append(x, y) for x, y in zip(rows, (key[0], pivot, pivot), strict=True)]
            told = bool(several[-1] == begin[-1]) if len(begin) and len(several) else not len(begin)
            pivot = p[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in rows], names=["key", "s1", "p"])

    return postings.repartition("key").sortWithinPartitions("key", "s1").mapInArrow(task, "key long, s1 long, p long")


def may_link(a: np.ndarray, b: np.ndarray, n_a, n_b, percent: int) -> np.ndarray:
    """False where the sketches prove that two sets don't link.

    Sets that link differ in at most (100 - percent) / (100 + percent) of their
    sizes' sum, and the sketches differ in no more slices.
    """
    return (a != b).sum(axis=-1) * (100 + percent) <= (100 - percent) * (n_a + n_b)


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """v, label: the smallest node reachable over links a - b, for each node that has a link.

    ``known`` labels (v, label) count as links. Smallest labels spread along
    links and labels of labels are followed, until nothing changes.
    """
    pairs = links.select("a", "b")
    if known is not None:
        pairs = pairs.unionByName(known.select(F.col("v").alias("a"), F.col("label").alias("b")))
    edges = saved(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = saved(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        near = edges.join(labels, edges.b == labels.v).groupBy("a").agg(F.min("label").alias("m"))
        best = labels.join(near, labels.v == near.a, "left").select("v", "label", F.least("label", F.coalesce("m", "label")).alias("m"))
        jump = labels.select(F.col("v").alias("j"), F.col("label").alias("j_label"))
        new = saved(best.join(jump, F.col("m") == F.col("j"), "left").select("v", F.col("label").alias("old"), F.least("m", F.coalesce("j_label", "m")).alias("label")))
        discard(labels)
        labels = new.select("v", "label")
        if new.where("label <> old").isEmpty():
            discard(edges)
            return labels
        FOLDERS[labels] = FOLDERS.pop(new)


def sifted(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """x, y of the pairs (x, y, c) that sizes and sketches don't rule out."""
    left = sketches.select(F.col("s1").alias("x"), "c", F.col("n").alias("n_x"), F.col("sketch").alias("a"))
    right = sketches.select(F.col("s1").alias("y"), "c", F.col("n").alias("n_y"), F.col("sketch").alias("b"))
    both = pairs.join(left, ["x", "c"]).join(right, ["y", "c"]).where(100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))

    def start():
        unpacked = SizeClasses(percent).unpacked

        def work(cols):
            keep = [bool(may_link(unpacked(a), unpacked(b), n, m, percent)) for a, b, n, m in zip(cols["a"], cols["b"], cols["n_x"], cols["n_y"], strict=True)]
            return {k: [v for v, ok in zip(cols[k], keep, strict=True) if ok] for k in ("x", "y")}

        return work

    return map_slices(both, start, "x long, y long", rows=4096).distinct()


def measured(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: representatives of the pairs (x, y of set hashes) whose texts' sets link."""
    left = texts.select(F.col("s1").alias("x"), F.col("rep").alias("a"), F.col("text").alias("t_a"))
    right = texts.select(F.col("s1").alias("y"), F.col("rep").alias("b"), F.col("text").alias("t_b"))

    def start():
        def work(cols):
            seen: dict[str, set] = {}
            out = {"a": [], "b": []}
            for a, b, s, t in zip(cols["a"], cols["b"], cols["t_a"], cols["t_b"], strict=True):
                for text in (s, t):
                    if text not in seen:
                        seen[text] = shingles(text, size)
                if linked(seen[s], seen[t], percent):
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return work

    return map_slices(pairs.join(left, "x").join(right, "y").select("a", "b", "t_a", "t_b"), start, "a long, b long", rows=64)


def region_pairs(sketches: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int, cross: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Positions of the pairs of a region that may link; recursive, misses none.

    Pairs with one label are settled. ``cross`` (0 or 1 for each member) asks
    only for pairs of different sides. The radius bounds the slices that differ
    between linked members of the region.
    """
    found: set[tuple[int, int]] = set()
    radius = int(2 * sizes.max(initial=0) * (100 - percent) / (100 + percent))

    def join(region: np.ndarray) -> None:
        if len(np.unique(labels[region])) < 2:
            return
        if len(region) > LEAF:
            pivots = region[:: max(1, len(region) // 4)][:4]
            away = (sketches[region][:, None, :] != sketches[pivots][None, :, :]).sum(axis=2)
            near = away <= away.min(axis=1, keepdims=True) + 2 * radius
            if near.sum(axis=0).max() <= 0.75 * len(region):
                for part in near.T:
                    join(region[part])
                return
        for k, i in enumerate(region):
            rest = region[k + 1 :]
            rest = rest[(labels[rest] != labels[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))]
            if cross is not None:
                rest = rest[cross[rest] != cross[i]]
            ok = may_link(sketches[rest], sketches[i], sizes[rest], sizes[i], percent)
            found.update((min(i, j), max(i, j)) for j in rest[ok].tolist())

    join(np.arange(len(sizes)))
    return sorted((int(i), int(j)) for i, j in found)


def open_cells(met: DataFrame, labels: DataFrame) -> DataFrame:
    """key, p, c, s1, label, size, top, n_top of the members of cells that hold several components.

    A cell's pivot has met all others, so cells of two are settled. ``top`` is
    the component with most members, ``n_top`` their number.
    """
    named = met.join(labels, "s1").select("key", "p", "s1", "label")
    kinds = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("key").alias("k"))
    mixed = kinds.agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("z"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1 AND size > 2")
    some = mixed.select("k", "size", F.col("z.label").alias("top"), F.col("z.n").alias("n_top"))
    return named.join(some, F.col("key") == F.col("k")).select("key", "p", class_of("key").alias("c"), "s1", "label", "size", "top", "n_top")


def class_of(key: str) -> Column:
    return F.shiftright(key, 56).cast("int")


def bundled(cells: DataFrame, sketches: DataFrame) -> DataFrame:
    """p, c, s1, label, bytes: the members of all open cells with one pivot, once, and the size of their sketches, which are as long as each other."""
    members = cells.select("p", "c", "s1", "label").distinct()
    widths = sketches.groupBy(F.col("c").alias("w_c")).agg(F.max(F.length("sketch")).alias("width"))
    sizes = members.groupBy(F.col("p").alias("of"), F.col("c").alias("of_c")).agg(F.count(F.lit(1)).alias("n")).join(widths, F.col("of_c") == F.col("w_c"))
    both = members.join(sizes, (F.col("p") == F.col("of")) & (F.col("c") == F.col("of_c")))
    return both.select("p", "c", "s1", "label", (F.col("n") * F.col("width")).alias("bytes"))


def bundle_pairs(pivot: int, sketches: np.ndarray, sizes: np.ndarray, labels: np.ndarray, c: int, percent: int, classes: SizeClasses) -> list[tuple[int, int]]:
    """Positions of the pairs of members of one class that may link and whose first shared cell the pivot is in."""
    classes.of(int(sizes.max()))
    sketches, held = parted(sketches)
    named = np.stack([posted(x, classes.spare(c, int(n))) for x, n in zip(held, sizes, strict=True)])
    sketches = np.ascontiguousarray(sketches)
    fine = sketches.view(f"<u{4 // classes.fine}")
    largest = np.array([classes.at(int(n)) for n in sizes])
    found = []
    for i in np.flatnonzero(named[pivot]):
        cell = np.flatnonzero(named[:, i] & (sketches[:, i] == sketches[pivot, i]))
        if (labels[cell] == labels[pivot]).all():
            continue
        for a, b in region_pairs(fine[cell], sizes[cell], labels[cell], percent):
            a, b = cell[a], cell[b]
            if max(largest[a], largest[b]) == c and np.argmax((sketches[a] == sketches[b]) & named[a] & named[b]) == i:
                found.append((int(a), int(b)))
    return found


def joined_bundles(bundles: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """x, y of pairs within bundles that may link; a task holds one bundle at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        classes = SizeClasses(percent)

        def flush() -> pa.RecordBatch:
            g = pa.Table.from_batches(held)
            s1, sizes = g["s1"].to_numpy(), g["n"].to_numpy()
            raw = np.stack([np.frombuffer(x, "<u4") for x in g["sketch"].to_pylist()])
            pivot = int(np.flatnonzero(s1 == g["p"][0].as_py())[0])
            got = np.array(bundle_pairs(pivot, raw, sizes, g["label"].to_numpy(), g["c"][0].as_py(), percent, classes), dtype=np.int64).reshape(-1, 2)
            a, b = s1[got[:, 0]], s1[got[:, 1]]
            return pa.RecordBatch.from_pydict({"x": pa.array(np.minimum(a, b)), "y": pa.array(np.maximum(a, b))})

        yield from runs(batches, 2, held, flush)

    full = bundles.join(sketches, ["s1", "c"]).select("p", "c", "s1", "label", "n", "sketch")
    placed = full.repartition("p", "c").sortWithinPartitions("p", "c", "s1")
    return placed.mapInArrow(task, "x long, y long")


def runs(batches: Iterator[pa.RecordBatch], width: int, held: list[pa.RecordBatch], flush: Callable[[], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``flush`` makes of each run of rows with equal first ``width`` columns; it finds their rows in ``held``."""
    last = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
        new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
            if b > a:
                if held and tuple(keys[:, a]) != last:
                    yield flush()
                    held.clear()
                held.append(batch.slice(a, b - a))
                last = tuple(keys[:, a])
    if held:
        yield flush()


def joined_in_tasks(cells: DataFrame, sketches: DataFrame, percent: int, region: int) -> DataFrame:
    """x, y of pairs within open cells that may link; a task holds at most about two blocks of ``region`` members.

    The members of the largest component have blocks of their own, which meet
    those of the others and not each other.
    """
    top = F.col("label") == F.col("top")
    many, rest = F.ceil(F.col("n_top") / F.lit(region)).cast("int"), F.ceil((F.col("size") - F.col("n_top")) / F.lit(region)).cast("int")
    place = F.xxhash64("s1", "key")
    own = F.when(top, F.pmod(place, many)).otherwise(many + F.pmod(place, rest)).cast("int")
    others = F.sequence(F.when(top, many).otherwise(F.lit(0)), many + rest - 1)
    full = cells.join(sketches, ["s1", "c"]).withColumn("own", own).withColumn("other", F.explode(others))
    dealt = full.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "s1", "label", "n", "sketch")

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        classes = SizeClasses(percent)

        def flush() -> pa.RecordBatch:
            g = pa.Table.from_batches(held)
            key, lo, hi = (g[k][0].as_py() for k in ("key", "lo", "hi"))
            cross = None if lo == hi else g["own"].to_numpy() == hi
            raw, s1, sizes = g["sketch"].to_pylist(), g["s1"].to_numpy(), g["n"].to_numpy()
            c, i = key >> 56, key >> 32 & 0xFFFFFF
            got = region_pairs(np.stack([classes.unpacked(x) for x in raw]), sizes, g["label"].to_numpy(), percent, cross)
            got = [(a, b) for a, b in got if classes.at(max(sizes[a], sizes[b])) == c and first_shared(raw[a], raw[b], *(classes.spare(c, int(sizes[j])) for j in (a, b))) == i]
            a, b = s1[np.array([a for a, _ in got], dtype=np.int64)], s1[np.array([b for _, b in got], dtype=np.int64)]
            return pa.RecordBatch.from_pydict({"x": pa.array(np.minimum(a, b)), "y": pa.array(np.maximum(a, b))})

        yield from runs(batches, 3, held, flush)

    placed = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "s1")
    return placed.mapInArrow(regions, "x long, y long")


def first_shared(a: bytes, b: bytes, spare_a: int, spare_b: int) -> int:
    """The first slice whose cell two sets of one class share, by their sketches; they share one where this is asked."""
    (x, held_x), (y, held_y) = (parted(np.frombuffer(z, "<u4")) for z in (a, b))
    return int(np.argmax((x == y) & posted(held_x, spare_a) & posted(held_y, spare_b))) & 0xFFFFFF


def join(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, region: int = REGION, bundle: int = BUNDLE) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of documents."""
    rows = saved(scan(documents, size, percent))
    real = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = saved(real.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    named = saved(rows.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")))
    # the sets of one id are one node: its representatives are linked
    several = named.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
    bound = several.join(named.select("doc_id", F.col("rep").alias("b")), "doc_id").where("a <> b").select("a", "b")

    met = saved(with_pivots(postings(real, percent)))
    by_class = real.select("s1", F.col("n_shingles").alias("n"), F.explode("sigs").alias("z")).select("s1", "n", "z.c", "z.sketch")
    tidy(documents.sparkSession)  # the exchange of the cells is the largest
    sketches = saved(by_class.join(met.select("s1").distinct(), "s1", "left_semi").dropDuplicates(["s1", "c"]))
    discard(rows)
    tidy(documents.sparkSession)
    ends = met.where("s1 <> p").select(F.col("p").alias("x"), F.col("s1").alias("y"), class_of("key").alias("c")).groupBy("x", "y").agg(F.max("c").alias("c"))
    links = checked(documents, sifted(ends, sketches, percent), classes, size, percent).unionByName(bound)
    labels = components(links)
    tidy(documents.sparkSession)

    own = classes.join(labels, F.col("rep") == F.col("v"), "left").select("s1", F.coalesce("label", "rep").alias("label"))
    cells = saved(open_cells(met, own))
    discard(met)
    tidy(documents.sparkSession)
    if not cells.isEmpty():
        bundles = saved(bundled(cells, sketches))
        pairs = joined_bundles(bundles.where(F.col("bytes") <= bundle), sketches, percent)
        wide = bundles.where(F.col("bytes") > bundle)
        if not wide.isEmpty():
            some = cells.join(wide.select("p", "c").distinct(), ["p", "c"], "left_semi")
            pairs = pairs.unionByName(joined_in_tasks(some, sketches, percent, region))
        pairs = saved(pairs.distinct())
        discard(bundles)
        if not pairs.isEmpty():
            labels = components(checked(documents, pairs, classes, size, percent), labels)
    for x in (sketches, cells):
        discard(x)
    # a node is its own component where it has no link
    final = named.join(labels, F.col("rep") == F.col("v"), "left")
    return final.select("doc_id", "n_shingles", F.coalesce("label", "rep", "doc_id").alias("component_id"))


def checked(documents: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among the proposed pairs, from the texts of their representatives."""
    pairs = saved(pairs)
    wanted = saved(pairs.select(F.explode(F.array("x", "y")).alias("s1")).distinct().join(classes, "s1").select("s1", "rep"))
    return saved(measured(pairs, saved(texts_of(documents, wanted, size)), size, percent))


def texts_of(documents: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """s1, rep and the text for each wanted representative."""
    named = sieve(documents.select("doc_id", "text"), "doc_id", wanted.select("rep"))
    both = named.join(wanted, F.col("doc_id") == F.col("rep")).select("s1", "rep", "text")

    def start():
        def work(cols):
            own = [set_hash(shingle_hashes(t, size)) for t in cols["text"]]
            keep = [a == b for a, b in zip(own, cols["s1"], strict=True)]
            return {k: [x for x, ok in zip(v, keep, strict=True) if ok] for k, v in cols.items()}

        return work

    # an id may have several texts: only those of the wanted set stay, once
    return map_slices(both, start, "s1 long, rep long, text string").dropDuplicates(["s1", "rep"])


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """The documents that stand for their component (those with its smallest doc_id); null ids stay. Columns stay."""
    gone, again, rank = (free_name(documents, x) for x in ("gone", "again", "rank"))
    found = join(documents, **options)
    lost = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    kept = documents.join(lost, F.col("doc_id") == F.col(gone), "left_anti")
    twice = saved(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(again)).count().where("count > 1").select(again))
    if twice.isEmpty():
        return kept
    same = F.col("doc_id") == F.col(again)
    order = Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(*(F.col(f"`{c}`") for c in documents.columns))))
    first = kept.join(twice, same, "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    return kept.join(twice, same, "left_anti").unionByName(first)
