"""Substring dedup: repeated windows of a fixed number of tokens.

A window is 50 consecutive words. Rabin-Karp hashes (two rolling polynomials over
64-bit word hashes, 128 bits together) stand for windows; Spark counts them and finds the smallest
document of each. Words of a window that also starts in a smaller document are
removed; overlapping windows merge into maximal intervals.

Two exact steps keep the shuffles small:

* Texts with the same words form a class. Its smallest document stands for it;
  the others lose all words, if they have a whole window.
* Each window names an anchor: the least hash among its 25-word grams. Equal
  windows name the same anchor, so a window whose anchor occurs in one class
  only is unique. Only windows with shared anchors are hashed and counted.

Defined results: a null text has no words; texts shorter than a window lose
nothing; windows that repeat within one document only are kept; rows with one
doc_id never count as smaller than each other; a null doc_id counts as larger
than all; an empty table gives no rows; other columns are ignored by
``removal``. Windows are judged on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubicost.llm.common import map_slices, mix64, rolling, saved, sieve, signed, word_hashes, words_of

WINDOW = 50
LAST = (1 << 63) - 1
#: makes second hashes of words, so that windows have 128 bits
SECOND = np.uint64(0x2545F4914F6CDD1D)

SCAN = "doc_id long, c1 long, c2 long, n_words long, kept_sha256 string, anchors array<long>"


def window_anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window: the least hash among its grams of half the width."""
    grams = rolling(hashes, width // 2)
    span = width - width // 2 + 1
    if len(grams) < span:
        return np.zeros(0, dtype=np.uint64)
    return np.lib.stride_tricks.sliding_window_view(grams, span).min(axis=1)


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def scan(documents: DataFrame, width: int) -> DataFrame:
    """One row per document: class of the word sequence, words, digest of all words and anchors."""

    def start():
        def work(cols):
            out = {k: [] for k in ("c1", "c2", "n_words", "kept_sha256", "anchors")}
            for text in cols["text"]:
                words = words_of(text)
                d = digest(words)
                out["c1"].append(int.from_bytes(bytes.fromhex(d[:16]), "big", signed=True))
                out["c2"].append(int.from_bytes(bytes.fromhex(d[16:32]), "big", signed=True))
                out["n_words"].append(len(words))
                out["kept_sha256"].append(d)
                out["anchors"].append(signed(np.unique(window_anchors(word_hashes(text), width))) if len(words) >= width else [])
            return {"doc_id": cols["doc_id"]} | out

        return work

    return map_slices(documents.select("doc_id", "text"), start, SCAN)


def repeated_windows(flagged: DataFrame, width: int) -> DataFrame:
    """id, c1, starts: where windows begin that also start in a smaller document.

    flagged: id, c1, text and the shared anchors of each document.
    """

    def start():
        def work(cols):
            out = {"starts": [], "hashes": [], "seconds": []}
            for text, anchors in zip(cols["text"], cols["anchors"], strict=True):
                h = word_hashes(text)
                at = np.flatnonzero(np.isin(signed(window_anchors(h, width)), np.array(anchors, dtype=np.int64)))
                out["starts"].append(at.astype(np.int32))
                out["hashes"].append(signed(rolling(h, width)[at]))
                out["seconds"].append(signed(rolling(mix64(h ^ SECOND), width)[at]))
            return {"id": cols["id"], "c1": cols["c1"]} | out

        return work

    each = map_slices(flagged.select("id", "c1", "text", "anchors"), start, "id long, c1 long, starts array<int>, hashes array<long>, seconds array<long>")
    windows = each.select("id", "c1", F.inline(F.arrays_zip(F.col("starts").alias("at"), F.col("hashes").alias("h"), F.col("seconds").alias("g"))))
    # written, so that the join is one of two plain exchanges, of which Spark can split a window that very many documents share
    shared = saved(windows.groupBy("h", "g").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(F.col("h").alias("r_h"), F.col("g").alias("r_g"), "least"))
    later = windows.join(shared, (F.col("h") == F.col("r_h")) & (F.col("g") == F.col("r_g"))).where("id > least")
    return later.groupBy("id", "c1").agg(F.collect_list("at").alias("starts"))


def intervals(starts: list[int], width: int) -> list[tuple[int, int]]:
    """Maximal intervals (start, end exclusive) that windows at the starts cover."""
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = s + width
        else:
            out.append([s, s + width])
    return [tuple(x) for x in out]


def removal(documents: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of documents."""
    rows = saved(scan(documents, width).withColumn("id", F.coalesce("doc_id", F.lit(LAST))))
    classes = rows.groupBy("c1", "c2", "n_words").agg(F.min("id").alias("rep"))
    anchors = rows.select("c1", F.explode("anchors").alias("a"))
    shared = anchors.groupBy("a").agg(F.min("c1").alias("x"), F.max("c1").alias("y")).where("x < y").select(F.col("a").alias("r_a"))
    marks = anchors.join(shared, F.col("a") == F.col("r_a")).groupBy(F.col("c1").alias("m_c1")).agg(F.collect_set("a").alias("marks"))
    first = rows.join(classes, ["c1", "c2", "n_words"])
    judged = saved(first.drop("anchors").join(marks, F.col("c1") == F.col("m_c1"), "left").select("doc_id", "id", "c1", "n_words", "kept_sha256", (F.col("id") > F.col("rep")).alias("copy"), F.col("marks").alias("anchors")))
    wanted = saved(judged.where(~F.col("copy") & F.col("anchors").isNotNull()).groupBy(F.col("id").alias("w_id"), "c1").agg(F.first("anchors").alias("anchors")))
    near = with_class(sieve(documents.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text"), "id", wanted.select("w_id")))
    # several rows may share an id: each meets the class of its own text only
    texts = near.join(wanted.withColumnRenamed("c1", "w_c1"), (F.col("id") == F.col("w_id")) & (F.col("c1") == F.col("w_c1")))
    flagged = saved(texts.select("id", "c1", "text", "anchors").dropDuplicates(["id", "c1"]))
    found = repeated_windows(flagged, width)
    cut = cut_texts(flagged.join(found.select(F.col("id").alias("f_id"), F.col("c1").alias("f_c1"), "starts"), (F.col("id") == F.col("f_id")) & (F.col("c1") == F.col("f_c1"))), width)
    done = judged.join(cut.select(F.col("id").alias("d_id"), F.col("c1").alias("d_c1"), "removed", "sha"), (F.col("id") == F.col("d_id")) & (F.col("c1") == F.col("d_c1")), "left")
    whole = F.col("copy") & (F.col("n_words") >= width)
    return done.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "kept_sha256")).alias("kept_sha256"),
    )


def with_class(texts: DataFrame) -> DataFrame:
    """id, text and the class of each text."""

    def start():
        def work(cols):
            return cols | {"c1": [int.from_bytes(bytes.fromhex(digest(words_of(t))[:16]), "big", signed=True) for t in cols["text"]]}

        return work

    return map_slices(texts.select("id", "text"), start, "id long, text string, c1 long")


def cut_texts(found: DataFrame, width: int) -> DataFrame:
    """id, c1, removed words and digest of the kept ones, from texts and window starts."""

    def start():
        def work(cols):
            out = {"removed": [], "sha": []}
            for text, starts in zip(cols["text"], cols["starts"], strict=True):
                words, kept, at = words_of(text), [], 0
                for a, b in intervals(starts, width):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out["removed"].append(len(words) - len(kept))
                out["sha"].append(digest(kept))
            return {"id": cols["id"], "c1": cols["c1"]} | out

        return work

    return map_slices(found.select("id", "c1", "text", "starts"), start, "id long, c1 long, removed long, sha string")
