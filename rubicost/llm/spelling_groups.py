"""Spelling variants: words one edit apart, found by a rare-first q-gram prefix filter.

1. Runs of letters are counted in the tasks that read the texts; sums by word
   follow. In about one of ``every`` documents a run loses a letter (planted
   misspellings; see ``Dropped``).
2. Bigrams are ordered globally by the number of words that hold them, the
   rarest first; equal ones of a word by position. One edit touches at most two
   bigrams, so two words that are one edit apart share one of the three rarest
   of each, unharmed. The order has to be one of bigrams, not of bigram and
   position: an insertion shifts what follows.
3. Position limits. The edit lies behind an unharmed bigram or before it. In the
   first case both words begin alike, up to the bigram's end; in the other both
   end alike, from the bigram's start. Each of the three bigrams hence names two
   cells: its head (``<`` and the word up to the bigram's end) and its tail
   (``>`` and the word from its start). Near words share one of the six.
4. Cells are streamed. Inside one, words are verified by what remains when a
   letter of the open part is left out: equal remainders with a gap at one place
   are a replacement, a remainder that is a word a deletion. A pair counts in
   the least cell that both have. What leaves a task is one row for each word
   and cell, not one for each pair.
5. A cell of more than ``block`` words is dealt out by the hash of remainders, so
   that no task holds it; a word goes to the parts of its remainders.
6. Forms are followed by pointer jumping; counts at least double at each step,
   so chains are short, and doubling joins them in few rounds.

The table of bigrams has at most (number of letters)**2 rows, 7,744 for the
default alphabet, and goes through the driver; nothing else does.

Defined results: null and empty texts have no runs; a row with a null doc_id has
no planted misspelling; repeated rows count each; of near words with one count
the first in code-point order is the form; an empty table gives no rows; other
columns are ignored. A very long text is one row and read in one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubicost.llm.common import FOLDERS, discard, map_slices, saved

RUN = r"[A-Za-zÀ-ÿ]+"
#: code points a word has at least (a word of four has too few bigrams for the filter), and occurrences
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: how many of the rarest bigrams of a word are joined: 2 for one edit, and one more
RAREST = 3
#: words of a cell that a task holds, and of a task's table of counts
BLOCK, HELD = 20_000, 300_000


class Dropped:
    """Which letter of a run a document lacks: planted misspellings, one in ``every`` by the hash of doc_id and run."""

    def __init__(self, every: int = 97) -> None:
        self.every = every

    def of(self, doc_id: int | None, runs: Counter) -> Iterator[tuple[str, int]]:
        if doc_id is None or not self.every:
            yield from runs.items()
            return
        begun = crc32(f"{doc_id}:".encode())
        for run, n in runs.items():
            h = crc32(run.encode(), begun)
            if h % self.every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            yield run, n


def vocabulary(documents: DataFrame, run: str = RUN, every: int = 97, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of all texts with their occurrences."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, dropped, counts = re.compile(run), Dropped(every), Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                # bytes.lower changes A-Z alone
                runs = Counter(pattern.findall(text.encode().lower().decode()))
                for word, n in dropped.of(doc_id.as_py(), runs):
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) > HELD:
                    yield out()
        yield out()

    counted = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """In how many words each bigram occurs; as many entries as there are pairs of letters, at most."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                counts.update({word[i : i + 2] for i in range(len(word) - 1)})
        yield pa.RecordBatch.from_pydict({"g": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    counted = words.select("word").mapInArrow(task, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return {r["g"]: r["n"] for r in counted.collect()}


def cells(word: str, frequency: dict[str, int]) -> list[str]:
    """The head and the tail of each of the rarest bigrams of a word."""
    ranked = sorted((frequency[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1))
    return [cell for _, _, i in ranked[:RAREST] for cell in ("<" + word[: i + 2], ">" + word[i:])]


def remainders(word: str, cell: str) -> Iterator[tuple[int, str]]:
    """Place and rest of the word for each letter that the cell leaves open; places count from the fixed end."""
    fixed, n = len(cell) - 1, len(word)
    for i in range(fixed, n) if cell[0] == "<" else range(n - fixed):
        yield (i if cell[0] == "<" else n - i), word[:i] + word[i + 1 :]


def part_of(rest: str, parts: int) -> int:
    return crc32(rest.encode()) % parts


def parts_of(word: str, cell: str, parts: int) -> set[int]:
    """The parts of a dealt cell that a word takes part in: those of its remainders and of itself."""
    return {part_of(rest, parts) for _, rest in remainders(word, cell)} | {part_of(word, parts)}


def near_pairs(words: Iterable[str], cell: str, part: int = 0, parts: int = 1) -> set[tuple[str, str]]:
    """Pairs of words of one cell that are one edit apart, in order; of a dealt cell those of one part."""
    words, gaps, found = set(words), {}, set()
    for word in words:
        for at, rest in remainders(word, cell):
            if parts > 1 and part_of(rest, parts) != part:
                continue
            # as many as there are letters, at most
            gaps.setdefault((at, rest), []).append(word)
            if rest in words:
                found.add((min(word, rest), max(word, rest)))
    for alike in gaps.values():
        if len(alike) > 1:
            found.update(combinations(sorted(alike), 2))
    return found


def postings(words: DataFrame, frequency) -> DataFrame:
    """cell, word, n: the six cells of each word."""

    def start():
        def work(cols):
            rows = [(c, w, n) for w, n in zip(cols["word"], cols["n"], strict=True) for c in cells(w, frequency.value)]
            return dict(zip(("cell", "word", "n"), zip(*rows, strict=True), strict=True)) if rows else {"cell": [], "word": [], "n": []}

        return work

    return map_slices(words.select("word", "n"), start, "cell string, word string, n long", rows=8192)


def dealt(posted: DataFrame, block: int) -> DataFrame:
    """cell, part, parts, word, n: cells as one part, those of more than ``block`` words in parts."""
    large = saved(posted.groupBy("cell").count().where(F.col("count") > block).select(F.col("cell").alias("of"), F.ceil(F.col("count") / block).cast("int").alias("parts")))
    whole = posted.select("cell", F.lit(0).alias("part"), F.lit(1).alias("parts"), "word", "n")
    if large.isEmpty():
        return whole

    def start():
        def work(cols):
            rows = [(c, p, k, w, n) for c, k, w, n in zip(cols["cell"], cols["parts"], cols["word"], cols["n"], strict=True) for p in parts_of(w, c, k)]
            return dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {x: [] for x in names}

        return work

    names = ("cell", "part", "parts", "word", "n")
    same = F.col("cell") == F.col("of")
    split = map_slices(posted.join(large, same).select("cell", "parts", "word", "n"), start, "cell string, part int, parts int, word string, n long", rows=2048)
    return whole.join(large.select("of"), same, "left_anti").unionByName(split)


def neighbours(posted: DataFrame, frequency) -> DataFrame:
    """word, n_near, best: near words that a cell has for a word, their number and the most frequent as (-n, word)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lru_cache(1 << 16)(lambda w: frozenset(cells(w, frequency.value)))
        held: dict[str, int] = {}
        last = None

        def flush() -> list[tuple]:
            cell, part, parts = last
            near: dict[str, list] = {}
            for pair in near_pairs(held, cell, part, parts) if len(held) > 1 else ():
                if min(own(pair[0]) & own(pair[1])) == cell:
                    for a, b in (pair, pair[::-1]):
                        entry = near.setdefault(a, [0, (-held[b], b)])
                        entry[0] += 1
                        entry[1] = min(entry[1], (-held[b], b))
            held.clear()
            return [(w, k, {"m": m, "w": b}) for w, (k, (m, b)) in near.items()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            word, k, best = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(k, pa.int64()), pa.array(best, pa.struct([("m", pa.int64()), ("w", pa.string())]))], names=["word", "n_near", "best"])

        made = []
        for batch in batches:
            for cell, part, parts, word, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (cell, part, parts) != last:
                    if last is not None:
                        made += flush()
                    last = (cell, part, parts)
                held[word] = n
            if len(made) > 10_000:
                yield batch_of(made)
                made = []
        if last is not None:
            made += flush()
        if made:
            yield batch_of(made)

    placed = posted.select("cell", "part", "parts", "word", "n").repartition("cell", "part").sortWithinPartitions("cell", "part")
    return placed.mapInArrow(task, "word string, n_near long, best struct<m:long,w:string>")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) lead from each word that has one."""
    at = saved(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("of"), F.col("root").alias("next"))
        # what has arrived finds no further step
        new = saved(at.join(further, F.col("root") == F.col("of"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(at)
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        at = new.select("word", "root")
        FOLDERS[at] = FOLDERS.pop(new)


def groups(documents: DataFrame, block: int = BLOCK, every: int = 97) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the texts."""
    words = saved(vocabulary(documents, every=every))
    frequency = documents.sparkSession.sparkContext.broadcast(bigram_counts(words))
    posted = saved(postings(words, frequency))
    found = neighbours(dealt(posted, block), frequency)
    near = found.groupBy(F.col("word").alias("of")).agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    wins = -F.col("best.m") >= 2 * F.col("n")
    forms = saved(words.join(near, F.col("word") == F.col("of"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(wins, F.col("best.w")).alias("form"), F.when(wins, -F.col("best.m")).alias("form_n")))
    discard(posted)
    discard(words)
    led = roots(forms).withColumnRenamed("word", "of")
    return forms.join(led, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
