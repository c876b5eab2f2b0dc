"""Rules over rows and texts: classifiers as tables, guarded similarity, pools, public rows, rounding, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubicost.functions.attributes import first_rule
from rubicost.functions.numbers import python_round
from rubicost.operators.joins import overlap_join
from rubicost.operators.statistics import exact_median
from rubicost.operators.topk import first_of
from rubicost.registry import query
from rubicost.tables import Tables

# Classes of texts and the patterns that say so, the first counts.
CONTRACTOR = [("accommodation", r"accom\w*dation"), ("transport", r"transport"), ("lift", r"scissor|lift|mewp|cherry"), ("tools", r"tools")]
ANCHOR = [("luminaire bracket", "luminaire bracket"), ("fire rated junction", "fire rated junction"), ("junction box", "junction box"), ("end feed", "end feed")]
MARKET = [("NL", r"\bams\d*\b|amsterdam|nl\b|netherlands|holland"), ("DE", r"\bfra\d*\w*\b|frankfurt|germany|deutschland|\bde\b"), ("LV", r"\briga\b|rīga|latvia|latvija|\blv\b"), ("DK", r"\bcph\d*\b|copenhagen|denmark|danmark"), ("IE", r"\bdub\d*\b|dublin|ireland"), ("UK", r"\blon\d*\b|london|\buk\b")]
TAG = [("hourly_norms", r"norm|stundu|darbietilp"), ("price_list", r"price|cenu|cenas|cenrād|prislist"), ("reference_estimate", r"/estimates/|/references/|tāme|tame|estimate|piedāvāj")]


def classed(text: Column, rules: list[tuple[str, str]], other: Column) -> Column:
    """The class of a text in lower case by the first rule that it has, or else ``other``."""
    return F.coalesce(first_rule(F.lower(text), rules), other)


def lump_class(text: Column, other: Column) -> Column:
    """Fixings, tools or both."""
    has = lambda w: F.lower(text).contains(w)
    return F.when(has("fixation") & has("tools"), "fixation+tools").when(has("fixation"), "fixation").when(has("tools"), "tools").otherwise(other)


def market_of(*texts: Column) -> Column:
    """The market that the first of the texts that names one names."""
    return F.coalesce(*[first_rule(F.lower(x), MARKET) for x in texts])


def case(column: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({column}), '{p}') THEN '{c}'" for c, p in rules)


@query(rf"""SELECT s_suppkey AS file_id, coalesce({case('s_name', MARKET)} END, {case('n_name', MARKET)} END) AS market FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def guessed_markets(t: Tables):
    """Markets of files by their own names, or else by those of their nations."""
    named = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("s_suppkey").alias("file_id"), market_of(F.col("s_name"), F.col("n_name")).alias("market"))


@query(rf"""SELECT page_id, {case('url', TAG)} ELSE 'other' END AS tag FROM pages""")
def guessed_tags(t: Tables):
    """Kinds of files by words in their paths."""
    return t("pages").select("page_id", classed(F.col("url"), TAG, F.lit("other")).alias("tag"))


@query(rf"""SELECT doc_id, {case('text', CONTRACTOR)} ELSE left(lower(text), 40) END AS contractor, {case('text', ANCHOR)} ELSE left(lower(text), 30) END AS anchor,
    CASE WHEN lower(text) LIKE '%fixation%' AND lower(text) LIKE '%tools%' THEN 'fixation+tools' WHEN lower(text) LIKE '%fixation%' THEN 'fixation' WHEN lower(text) LIKE '%tools%' THEN 'tools' ELSE left(lower(text), 40) END AS lump FROM documents""")
def text_classes(t: Tables):
    """Classes of texts as contractor items, as anchors of accessories and as lump sums; a text of no class is its own, cut short."""
    x = F.col("text")
    low = lambda n: F.substring(F.lower(x), 1, n)
    return t("documents").select("doc_id", classed(x, CONTRACTOR, low(40)).alias("contractor"), classed(x, ANCHOR, low(30)).alias("anchor"), lump_class(x, low(40)).alias("lump"))


def guarded(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of texts (a, b, overlap) as pairs of rows whose products don't differ and whose components agree.

    Sides hold classes of rows: a or b, product, component and unit, each class once. A product or unit that is not known hinders
    nothing; a component that one side lacks does.
    """
    sides = [df.select(F.col(k), F.col("product").alias(f"{k}_product"), F.col("component").alias(f"{k}_component"), F.col("unit").alias(f"{k}_unit"), *[F.col(c) for c in df.columns if c not in (k, "product", "component", "unit")]) for df, k in ((left, "a"), (right, "b"))]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    apart = (F.col("a_product") != F.col("b_product")) | (F.col("a_unit") != F.col("b_unit"))
    return both.where(~F.coalesce(apart, F.lit(False)) & F.col("a_component").eqNullSafe(F.col("b_component")))


@query("""WITH w AS (SELECT DISTINCT p_name AS a, nullif(p_type, 'ECONOMY') AS product, CASE WHEN p_size > 40 THEN p_size END AS component, CASE WHEN p_size % 2 = 0 THEN 'm' END AS unit FROM part),
r AS (SELECT p_name || ' ' || lower(p_type) AS b, nullif(p_type, 'ECONOMY') AS product, CASE WHEN p_size > 40 THEN p_size END AS component, CASE WHEN p_size % 3 = 0 THEN 'm' WHEN p_size % 3 = 1 THEN 'pcs' END AS unit, min(p_partkey) AS ref_id FROM part GROUP BY ALL),
s AS (SELECT w.a, w.product, w.component, w.unit, r.b, ref_id, len(list_intersect(string_split(a, ' '), string_split(b, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS j FROM w, r
    WHERE NOT coalesce(w.product <> r.product, false) AND NOT coalesce(w.unit <> r.unit, false) AND w.component IS NOT DISTINCT FROM r.component)
SELECT a, product, component, unit, b, ref_id, round(j, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY a, product, component, unit ORDER BY j DESC, ref_id) AS k FROM s WHERE j >= 0.5) WHERE k = 1""")
def guarded_similar_text(t: Tables):
    """The reference row with the largest word overlap, at least one half, among those of the same product, component and unit; the preferred of equals."""
    part = t("part")
    product, component = F.nullif("p_type", F.lit("ECONOMY")).alias("product"), F.when(F.col("p_size") > 40, F.col("p_size")).alias("component")
    a = part.select(F.col("p_name").alias("a"), product, component, F.when(F.col("p_size") % 2 == 0, "m").alias("unit")).distinct()
    b = part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("b"), product, component, F.when(F.col("p_size") % 3 == 0, "m").when(F.col("p_size") % 3 == 1, "pcs").alias("unit"), "p_partkey")
    b = b.groupBy("b", "product", "component", "unit").agg(F.min("p_partkey").alias("ref_id"))
    words = lambda df, k: df.select(k).distinct().withColumn(f"t{k}", F.split(k, " "))
    pairs = overlap_join(words(a, "a"), words(b, "b"), "a", "b", "ta", "tb", 0.5)
    met = guarded(pairs, a, b)
    best = first_of(met, ["a", "a_product", "a_component", "a_unit"], F.desc("overlap"), F.col("ref_id"))
    return best.select("a", F.col("a_product").alias("product"), F.col("a_component").alias("component"), F.col("a_unit").alias("unit"), "b", "ref_id", F.round("overlap", 6).alias("overlap"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_tax <> 0 AND NOT (l_returnflag = 'R' AND l_linestatus = 'F')""")
def supply_rate_pool(t: Tables):
    """Rows that may answer for a supply rate: those that have one and no contradiction in their description."""
    flags = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), F.array(F.lit("CONFLICTING_DESCRIPTION"))).otherwise(F.array().cast("array<string>"))
    rate = F.nullif("l_tax", F.lit(0.0))
    return t("lineitem").withColumns({"flags": flags, "rate": rate}).where(F.col("rate").isNotNull() & ~F.array_contains("flags", "CONFLICTING_DESCRIPTION")).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


#: columns that stay on the server
PRIVATE = ("o_custkey", "stored_path", "work_path")


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND coalesce(nullif(o_orderpriority, '5-LOW'), '1-URGENT') = '1-URGENT'""")
def public_files(t: Tables):
    """Files that may be used, without the columns that stay on the server: read, not deleted, and of the model asked for (one that is not said is that one)."""
    deleted = F.when(F.col("o_totalprice") < 1000, F.col("o_orderdate"))
    model = F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("1-URGENT"))
    return t("orders").where((F.col("o_orderstatus") == "F") & deleted.isNull() & (model == "1-URGENT")).drop(*PRIVATE)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, printf('%.2f', l_extendedprice / l_quantity)::DOUBLE AS cents, printf('%.1f', l_quantity / 4)::DOUBLE AS tenths, printf('%.0f', l_quantity / 2)::DOUBLE AS whole FROM lineitem""")
def half_even_rounds(t: Tables):
    """Numbers rounded as their binary values lie; exact halves go to the even digit."""
    q = F.col("l_quantity")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", python_round(F.col("l_extendedprice") / q, 2).alias("cents"), python_round(q / 4, 1).alias("tenths"), python_round(q / 2, 0).alias("whole"))


def report_lines(scores: DataFrame, title: str) -> DataFrame:
    """line_no, line: a Markdown report of scores (part, n, hits, median): a heading, a line for each part in order, a table."""
    share = F.format_string("%d/%d (%.1f%%)", "hits", "n", F.try_divide(100.0 * F.col("hits"), F.col("n")))
    shown = F.when(F.col("n") > 0, share).otherwise("n/a")
    middle = F.when(F.col("median").isNotNull(), F.format_string("%.2f", "median")).otherwise("n/a")
    body = scores.select(F.col("part"), F.concat(F.lit("| "), F.col("part"), F.lit(" | "), shown, F.lit(" | "), middle, F.lit(" |")).alias("line"))
    # a report has a line for each part
    ordered = body.groupBy().agg(F.array_sort(F.collect_list(F.struct("part", "line"))).alias("x"))
    head = F.array(F.lit(f"# {title}"), F.lit(""), F.lit("| Part | Within tolerance | Median ratio |"), F.lit("|---|---|---|"))
    return ordered.select(F.posexplode(F.concat(head, F.transform("x", lambda r: r["line"]))).alias("line_no", "line"))


def write_report(scores: DataFrame, title: str, path: str) -> None:
    """Report sinks: ``path``/report.md as text, in order, and ``path``/scores.json, one object a line."""
    report_lines(scores, title).orderBy("line_no").coalesce(1).select("line").write.mode("overwrite").text(f"{path}/report.md")
    scores.coalesce(1).write.mode("overwrite").json(f"{path}/scores.json")


@query("""WITH s AS (SELECT year(l_shipdate)::VARCHAR AS part, count(*) AS n, count(*) FILTER (WHERE abs(l_tax - 0.04) < 0.025) AS hits, median(l_discount) AS median FROM lineitem GROUP BY 1),
b AS (SELECT part, '| ' || part || ' | ' || hits || '/' || n || ' (' || printf('%.1f', 100.0 * hits / n) || '%) | ' || printf('%.2f', median) || ' |' AS line FROM s)
SELECT (3 + row_number() OVER (ORDER BY part))::INTEGER AS line_no, line FROM b UNION ALL SELECT * FROM (VALUES (0, '# Accuracy by year'), (1, ''), (2, '| Part | Within tolerance | Median ratio |'), (3, '|---|---|---|')) v(line_no, line)""")
def accuracy_report(t: Tables):
    """A report on how many rows of each year lie within a tolerance, as lines of Markdown."""
    rows = t("lineitem").select(F.year("l_shipdate").cast("string").alias("part"), "l_tax", "l_discount")
    hits = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("l_tax") - 0.04) < 0.025).alias("hits"))
    scores = hits.join(exact_median(rows, ["part"], "l_discount").drop("n"), "part")
    return report_lines(scores, "Accuracy by year")
