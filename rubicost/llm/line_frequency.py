"""Quality rules: frequency of lines across the documents of a host.

Lines are normalised (A-Z lower-cased, white space collapsed) and hashed. For
each host (``source``) the documents that hold a line are counted; lines in
more documents than the limit are removed, and a document that loses more than
``depleted`` of its words is rejected. The limit of a host is the larger of
``min_docs`` and ``share`` of its documents, so it behaves alike at any size.

Base statistics of each text (``base_stats``) come from one pass over it.

Defined results: each row counts as one document, so repeated rows count as
often as they stand; a null text has no words and fails the base rules; a null
source is a host of its own; a null doc_id is kept as it is; an empty table
gives no rows; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubicost.llm.common import map_slices, text_key, words_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5

BASE_SCHEMA = "doc_id long, tk long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows found twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(window)), strict=False))
    first: dict[tuple, int] = {}
    covered: set[int] = set()
    if len(set(windows)) == len(windows):
        return 0
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            covered.update(range(i, i + window))
            covered.update(range(j, j + window))
    return len(covered)


def base_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    words = words_of(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace() or words_of(line):
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(text.count(c) for c in SYMBOLS), dup, repeated_words(words)


def base(documents: DataFrame) -> DataFrame:
    def start():
        def work(cols):
            stats = list(zip(*map(base_stats, cols["text"]), strict=True)) or [()] * 5
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            return {"doc_id": cols["doc_id"], "tk": cols["tk"]} | dict(zip(names, stats, strict=True))

        return work

    return map_slices(documents.select("doc_id", text_key().alias("tk"), "text"), start, BASE_SCHEMA)


def normalised(line: Column) -> Column:
    """A-Z lower-cased, white space collapsed to single spaces, ends trimmed."""
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.btrim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "))


def line_hash(line: Column) -> Column:
    """128 bits: as good as the line itself at any size."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def lines_of(documents: DataFrame) -> DataFrame:
    """source, doc_id, tk and an array of (line hash, words), one row per document."""
    lines = F.filter(F.transform(F.split("text", "\n"), normalised), lambda x: x != "")
    hashed = F.transform(lines, lambda x: F.struct(line_hash(x).alias("h"), F.size(F.split(x, " ")).alias("w")))
    return documents.where(F.col("text").isNotNull()).select("source", "doc_id", text_key().alias("tk"), hashed.alias("lines"))


def frequent_lines(lines: DataFrame, min_docs: int, share: float) -> DataFrame:
    """source, h of the lines that more documents of their host hold than the limit allows."""
    per_host = lines.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    counted = lines.select("source", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).groupBy("source", "h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > min_docs)
    joined = counted.join(per_host.withColumnRenamed("source", "host"), F.col("source").eqNullSafe(F.col("host")))
    return joined.where(F.col("c") > share * F.col("docs")).select("source", "h")


def remove_frequent_lines(documents: DataFrame, min_docs: int = 10, share: float = 0.002, depleted: float = 0.7) -> DataFrame:
    """doc_id, tk, line_words, removed_words, rejected: the verdict for each document that has lines.

    Repeated rows with one id and text share a verdict; their words add up on
    both sides of the quotient.
    """
    lines = lines_of(documents)
    frequent = frequent_lines(lines, min_docs, share).select(F.col("source").alias("f_source"), F.col("h").alias("f_h"))
    each = lines.select("source", "doc_id", "tk", F.explode("lines").alias("x")).select("source", "doc_id", "tk", "x.h", "x.w")
    marked = each.join(frequent, (F.col("h") == F.col("f_h")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    sums = marked.groupBy("doc_id", "tk").agg(F.sum("w").alias("line_words"), F.sum(F.when(F.col("f_h").isNotNull(), F.col("w")).otherwise(0)).alias("removed_words"))
    return sums.withColumn("rejected", F.col("removed_words") > depleted * F.col("line_words"))


def cleaned_text(documents: DataFrame, min_docs: int = 10, share: float = 0.002) -> DataFrame:
    """The documents without their frequent lines; line order is kept, other columns pass through.

    Each document's frequent lines are gathered by document, then taken out of its text.
    """
    lines = lines_of(documents)
    frequent = frequent_lines(lines, min_docs, share).select(F.col("source").alias("f_source"), F.col("h").alias("f_h"))
    each = lines.select("source", "doc_id", "tk", F.explode("lines").alias("x")).select("source", "doc_id", "tk", "x.h")
    found = each.join(frequent, (F.col("h") == F.col("f_h")) & F.col("source").eqNullSafe(F.col("f_source"))).groupBy(F.col("doc_id").alias("r_id"), F.col("tk").alias("r_tk")).agg(F.collect_set("h").alias("r_lines"))
    # the row is nested, so that none of its columns can meet one of these
    docs = documents.select("doc_id", text_key().alias("tk"), "text", F.struct("*").alias("row"))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("tk") == F.col("r_tk")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("r_lines", line_hash(normalised(x)))), "\n")
    new = F.when(F.col("r_lines").isNull(), F.col("text")).otherwise(kept)
    return joined.select(F.col("row").withField("text", new).alias("row")).select("row.*")


def rules(documents: DataFrame, min_docs: int = 10, share: float = 0.002, depleted: float = 0.7) -> DataFrame:
    """Base statistics, ``base_failed`` and ``kept`` for each document."""
    stats = base(documents).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    rejected = remove_frequent_lines(documents, min_docs, share, depleted).where("rejected").select(F.col("doc_id").alias("r_id"), F.col("tk").alias("r_tk"))
    joined = stats.join(rejected, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("tk") == F.col("r_tk")), "left")
    kept = ~F.col("base_failed") & F.col("r_tk").isNull()
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))

