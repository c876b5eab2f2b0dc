"""Vocabularies as tables: phrases found in texts by joins, leftmost and longest first.

A phrase is keyed by its first two words (or its only one). A text gives each
of its positions as two rows, keyed by the word and by it and the next, with as
many words as the longest phrase has; equal keys meet and the words are
compared. If all phrases are single words, a position is one row and its word
the key. No pattern grows with the vocabulary, and a vocabulary of any size is
one side of an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubicost.sources.files import stored

#: runs of letters and digits of any alphabet
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column, token: str = TOKEN) -> Column:
    """The words of a text in lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(token), F.lit(0)), F.array().cast("array<string>"))


def keyed(vocabulary: DataFrame, token: str = TOKEN) -> DataFrame:
    """phrase, label, words, k: phrases that have a word, once; of several labels of the same words the least counts."""
    split = vocabulary.select("phrase", "label", tokens(F.col("phrase"), token).alias("words")).where(F.size("words") > 0)
    one = split.groupBy("words").agg(F.min(F.struct("label", "phrase")).alias("x")).select("words", "x.label", "x.phrase")
    return one.withColumn("k", F.concat_ws(" ", F.slice("words", 1, 2)))


def prepared(vocabulary: DataFrame, token: str = TOKEN) -> tuple[DataFrame, int]:
    """The vocabulary by key, and how many words its longest phrase has."""
    # written once: it is read twice, and its size tells whether texts have to be placed by word to meet it
    phrases = stored(keyed(vocabulary, token))
    # one number
    return phrases, phrases.agg(F.max(F.size("words")).alias("n")).first()["n"] or 1


def candidates(texts: DataFrame, key: str, text: str, phrases: DataFrame, longest: int, token: str = TOKEN) -> DataFrame:
    """key, at, n, phrase, label: every place where one of the ``prepared`` phrases begins, ``at`` from 0."""
    said = texts.select(F.col(key).alias("_id"), tokens(F.col(text), token).alias("_t"))
    if longest == 1:
        # a word is its own key
        met = said.select("_id", F.posexplode("_t").alias("at", "_k")).join(phrases, F.col("_k") == F.col("k"))
        return met.select(F.col("_id").alias(key), "at", F.size("words").alias("n"), "phrase", "label")
    ahead = F.transform(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: F.struct(i.alias("at"), F.slice("_t", i + 1, longest).alias("ahead")))
    each = said.where(F.size("_t") > 0).select("_id", F.inline(ahead))
    keys = F.array_distinct(F.array(F.get("ahead", F.lit(0)), F.concat_ws(" ", F.slice("ahead", 1, 2))))
    places = each.select("_id", "at", "ahead", F.explode(keys).alias("_k"))
    met = places.join(phrases, F.col("_k") == F.col("k"))
    same = F.slice("ahead", F.lit(1), F.size("words")) == F.col("words")
    return met.where(same).select(F.col("_id").alias(key), "at", F.size("words").alias("n"), "phrase", "label")


def phrase_join(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, token: str = TOKEN) -> DataFrame:
    """key, at, n, phrase, label: the phrases of each text that don't overlap, leftmost first and of those the longest.

    ``key`` tells texts apart. ``vocabulary`` has phrase and label. Null texts
    and phrases without a word match nothing.
    """
    phrases, most = prepared(vocabulary, token)
    found = candidates(texts, key, text, phrases, most, token)
    if most == 1:
        # single words don't overlap
        return found
    longest = found.groupBy(key, "at").agg(F.max_by(F.struct("at", "n", "phrase", "label"), "n").alias("m"))
    # a text's matches are fewer than its words
    row = found.select("at", "n", "phrase", "label").schema.simpleString()
    ordered = longest.groupBy(key).agg(F.sort_array(F.collect_list("m")).alias("ms"))
    start = F.struct(F.array().cast(f"array<{row}>").alias("kept"), F.lit(0).alias("until"))
    step = lambda s, m: F.when(m["at"] >= s["until"], F.struct(F.array_append(s["kept"], m).alias("kept"), (m["at"] + m["n"]).alias("until"))).otherwise(s)
    return ordered.select(key, F.inline(F.aggregate("ms", start, step)["kept"]))


def labelled(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, token: str = TOKEN) -> DataFrame:
    """key, label, hits: the label whose phrases a text has most often, of equals the one that begins first; texts without any have none."""
    found = phrase_join(texts, key, text, vocabulary, token)
    counted = found.groupBy(key, "label").agg(F.count(F.lit(1)).alias("hits"), F.min("at").alias("first"))
    return counted.groupBy(key).agg(F.min_by(F.struct("label", "hits"), F.struct(-F.col("hits"), "first", "label")).alias("x")).select(key, "x.label", "x.hits")


def stripped(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, token: str = TOKEN) -> DataFrame:
    """key, rest: the words of each text without the phrases of the vocabulary; if nothing is left, all its words."""
    found = phrase_join(texts, key, text, vocabulary, token)
    gone = found.groupBy(F.col(key).alias("_of")).agg(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1))).alias("gone"))
    said = texts.select(key, tokens(F.col(text), token).alias("_t")).join(gone, F.col(key) == F.col("_of"), "left")
    left = F.filter(F.col("_t"), lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    return said.select(key, F.concat_ws(" ", F.when(F.size(left) > 0, left).otherwise(F.col("_t"))).alias("rest"))
