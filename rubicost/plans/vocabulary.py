"""Vocabularies that are tables: languages by their words, passages by how they begin, brands out of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubicost.operators.phrases import labelled, phrase_join, stripped, tokens
from rubicost.operators.topk_join import top_k_join
from rubicost.registry import query
from rubicost.tables import Tables

#: words of a language's list
WORDS = 200


def language_words(t: Tables) -> DataFrame:
    """phrase, label: the words in most documents of each language; a word of several languages belongs to none."""
    each = t("documents").where("lang IS NOT NULL").select("doc_id", "lang", F.explode(F.array_distinct(tokens(F.col("text")))).alias("phrase"))
    counted = each.groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("n"))
    # a language has a bounded list: partial ranks first, so no task ranks all words of one
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    order = [F.desc("n"), F.col("phrase")]
    few = counted.withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_p").orderBy(*order))).where(F.col("_r") <= WORDS)
    top = few.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_r") <= WORDS)
    return top.groupBy("phrase").agg(F.min("lang").alias("label"), F.count(F.lit(1)).alias("_n")).where("_n = 1").select("phrase", "label")


TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"


@query(rf"""WITH e AS (SELECT DISTINCT doc_id, lang, unnest({TOKENS.format('text')}) AS w FROM documents WHERE lang IS NOT NULL), c AS (SELECT lang, w, count(*) AS n FROM e GROUP BY lang, w),
top AS (SELECT w, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS r FROM c) WHERE r <= 200), voc AS (SELECT w, min(lang) AS label FROM top GROUP BY w HAVING count(*) = 1),
d AS (SELECT doc_id, {TOKENS.format('text')} AS ws FROM documents), p AS (SELECT doc_id, unnest(range(0, len(ws))) AS "at", unnest(ws) AS w FROM d), h AS (SELECT doc_id, label, count(*) AS hits, min("at") AS first FROM p JOIN voc USING (w) GROUP BY doc_id, label)
SELECT doc_id, label, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, first, label) AS r FROM h) WHERE r = 1""")
def vocabulary_language(t: Tables):
    """The language of each document by word lists, which come from the documents themselves."""
    return labelled(t("documents"), "doc_id", "text", language_words(t))


@query(rf"""WITH RECURSIVE b AS (SELECT item_id, {TOKENS.format('text')} AS ws FROM benchmark), v AS (SELECT words, min(item_id) AS item_id FROM (SELECT item_id, unnest([ws[1:2], ws[1:3], ws[3:7]]) AS words FROM b) WHERE len(words) > 1 GROUP BY words),
k AS (SELECT words, item_id, words[1] || ' ' || words[2] AS k FROM v), d AS (SELECT doc_id, {TOKENS.format('text')} AS ws FROM documents), p AS (SELECT doc_id, ws, unnest(range(0, len(ws))) AS "at" FROM d),
c AS (SELECT doc_id, "at", len(words) AS n, item_id FROM p JOIN k ON k = ws["at" + 1] || ' ' || ws["at" + 2] WHERE ws["at" + 1:"at" + len(words)] = words),
l AS (SELECT doc_id, "at", max(n) AS n, arg_max(item_id, n) AS item_id FROM c GROUP BY doc_id, "at"), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "at") AS r FROM l),
g AS (SELECT doc_id, r, "at", n, item_id, true AS ok, "at" + n AS until FROM o WHERE r = 1 UNION ALL SELECT o.doc_id, o.r, o."at", o.n, o.item_id, o."at" >= g.until, CASE WHEN o."at" >= g.until THEN o."at" + o.n ELSE g.until END FROM g JOIN o ON o.doc_id = g.doc_id AND o.r = g.r + 1)
SELECT doc_id, "at"::INTEGER AS "at", n::INTEGER AS n, item_id FROM g WHERE ok""")
def passage_mentions(t: Tables):
    """Where documents say how a passage begins: phrases of two to five words, leftmost and longest."""
    words = tokens(F.col("text"))
    heads = t("benchmark").select("item_id", F.explode(F.array(*[F.slice(words, a, n) for a, n in ((1, 2), (1, 3), (3, 5))])).alias("w")).where(F.size("w") > 1)
    vocabulary = heads.select(F.concat_ws(" ", "w").alias("phrase"), F.col("item_id").alias("label"))
    return phrase_join(t("documents"), "doc_id", "text", vocabulary).select("doc_id", "at", "n", F.col("label").alias("item_id"))


@query(rf"""WITH f AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part WHERE p_size > 45), x AS (SELECT p_partkey, {TOKENS.format("p_name || ' ' || p_type")} AS ws FROM part), a AS (SELECT list(w) AS gone FROM f), k AS (SELECT p_partkey, ws, list_filter(ws, lambda x: NOT list_contains(gone, x)) AS rest FROM x, a)
SELECT p_partkey, array_to_string(CASE WHEN len(rest) > 0 THEN rest ELSE ws END, ' ') AS rest FROM k""")
def names_without_makes(t: Tables):
    """Part texts without the words of a vocabulary that is a column of a table."""
    makes = t("part").where("p_size > 45").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("phrase")).distinct().withColumn("label", F.lit("make"))
    return stripped(t("part").withColumn("text", F.concat_ws(" ", "p_name", "p_type")), "p_partkey", "text", makes)


@query(rf"""WITH a AS (SELECT item_id, list_distinct({TOKENS.format('text')}) AS x FROM benchmark), b AS (SELECT doc_id, list_distinct({TOKENS.format('text')}) AS y FROM documents), wa AS (SELECT *, list_sum(list_transform(x, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN 2.0::DOUBLE ELSE 1.0 END)) AS wx FROM a),
wb AS (SELECT *, list_sum(list_transform(y, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN 2.0::DOUBLE ELSE 1.0 END)) AS wy FROM b), s AS (SELECT item_id, doc_id, 2 * list_sum(list_transform(list_intersect(x, y), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN 2.0::DOUBLE ELSE 1.0 END)) / (wx + wy) AS similarity FROM wa, wb WHERE list_has_any(x, y))
SELECT item_id, doc_id, round(similarity, 9) AS similarity, rank FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id))::INTEGER AS rank FROM s) WHERE rank <= 3""")
def best_matches(t: Tables):
    """The three documents most similar to each passage, without a threshold, by an index that is read as far as bounds ask for."""
    toks = F.array_distinct(tokens(F.col("text")))
    found = top_k_join(t("benchmark").select("item_id", toks.alias("toks")), t("documents").select("doc_id", toks.alias("toks")), "item_id", "doc_id", 3)
    return found.select(F.col("l_key").alias("item_id"), F.col("r_key").alias("doc_id"), F.round("similarity", 9).alias("similarity"), "rank")
