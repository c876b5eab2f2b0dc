"""Reading sheets: numbers and units in text, structure of columns and rows, price records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rubicost.functions.numbers import close, column_letters, excel_round, parse_number
from rubicost.functions.text import match_key, normalised
from rubicost.functions.units import normalise_unit, with_labels
from rubicost.operators.consensus import ratio_consensus
from rubicost.operators.dyadic import contained
from rubicost.operators.joins import interval_join
from rubicost.operators.topk import spread, systematic
from rubicost.registry import query
from rubicost.tables import Tables

ORDER = ["l_linenumber", "l_partkey", "l_extendedprice"]
SQL_ORDER = "l_linenumber, l_partkey, l_extendedprice"


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS value FROM lineitem""")
def parsed_numbers(t: Tables):
    """Numbers written in eight ways are all read back."""
    x = F.col("l_quantity")
    n = F.col("l_partkey") % 8
    whole = x.cast("int").cast("string")
    text = (
        F.when(n == 0, F.concat(whole, F.lit(",0")))
        .when(n == 1, F.concat(F.lit("€ "), whole, F.lit(".00")))
        .when(n == 2, F.concat(whole, F.lit(" kr.")))
        .when(n == 3, F.concat((x.cast("int") * 100).cast("string"), F.lit("%")))
        .when(n == 4, F.concat(F.lit(" "), whole, F.lit(" EUR")))
        .when(n == 5, F.concat(whole, F.lit(",000.0")))
        .when(n == 6, F.concat(whole, F.lit(".000,0")))
        .otherwise(F.concat(F.lit("("), whole, F.lit(")")))
    )
    value = parse_number(text)
    back = F.when(n.isin(5, 6), value / 1000).when(n == 7, -value).otherwise(value)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", back.alias("value"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'pcs' WHEN 1 THEN 'm2' WHEN 2 THEN 'h' WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 'h' ELSE 'pcs' END WHEN 4 THEN 'set' WHEN 5 THEN NULL ELSE 'm' END AS unit FROM part""")
def normalised_units(t: Tables):
    """Labels in several languages to canonical units; one of them depends on the language."""
    raw = F.expr("CASE p_partkey % 7 WHEN 0 THEN 'Gab.' WHEN 1 THEN 'm²' WHEN 2 THEN 'c/h' WHEN 3 THEN 'st.' WHEN 4 THEN 'kompl.' WHEN 5 THEN 'zorkmid' ELSE 'EUR/m' END")
    lang = F.when(F.col("p_size") % 2 == 0, "LV").otherwise("SV")
    return t("part").select("p_partkey", normalise_unit(raw, lang, with_labels(pcs=("gab",), h=("c h",), set=("kompl",))).alias("unit"))


@query("""SELECT p_partkey, lower(p_name) || ' ' || p_size || 'x2.5 mm2' AS key FROM part""")
def normalised_keys(t: Tables):
    """One key for a text whatever its case, multiplication sign, comma and brand."""
    size = F.col("p_size").cast("string")
    n = F.col("p_partkey") % 4
    text = (
        F.when(n == 0, F.concat(F.upper("p_name"), F.lit(" "), size, F.lit(" × 2,5 mm²")))
        .when(n == 1, F.concat("p_name", F.lit(" ABB, "), size, F.lit("*2.5 mm^2")))
        .when(n == 2, F.concat("p_name", F.lit("; "), size, F.lit(" х 2,5 mm 2")))
        .otherwise(F.concat("p_name", F.lit(" – "), size, F.lit("x2,5 mm2.")))
    )
    return t("part").select("p_partkey", match_key(text, ("abb",)).alias("key"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN 'section ' || l_partkey END AS title FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, last_value(title IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS section FROM s""")
def section_forward_fill(t: Tables):
    """The latest section heading above each row."""
    title = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("section "), F.col("l_partkey").cast("string")))
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return t("lineitem").withColumn("title", title).select("l_orderkey", "l_linenumber", "l_partkey", F.last("title", ignorenulls=True).over(w).alias("section"))


@query(f"""WITH s AS (SELECT l_orderkey, floor(l_quantity / 10) AS rate, row_number() OVER w AS k, floor(l_quantity / 10) IS DISTINCT FROM lag(floor(l_quantity / 10)) OVER w AS new FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {SQL_ORDER})),
i AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY k) AS island FROM s) SELECT l_orderkey, rate::BIGINT AS rate, min(k) AS row_start, max(k) AS row_end, count(*) AS n FROM i GROUP BY l_orderkey, rate, island HAVING count(*) >= 2""")
def rate_islands(t: Tables):
    """Runs of consecutive rows with one rate, of two rows at least."""
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    rate = F.floor(F.col("l_quantity") / 10)
    lines = spread(t("lineitem").select("l_orderkey", "l_quantity", *ORDER), "l_orderkey")
    s = lines.select("l_orderkey", rate.alias("rate"), F.row_number().over(w).cast("long").alias("k"), (~rate.eqNullSafe(F.lag(rate).over(w))).cast("int").alias("new"))
    i = s.withColumn("island", F.sum("new").over(Window.partitionBy("l_orderkey").orderBy("k")))
    return i.groupBy("l_orderkey", "rate", "island").agg(F.min("k").alias("row_start"), F.max("k").alias("row_end"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("island")


@query(f"""WITH s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SQL_ORDER}) AS k, l_quantity, l_returnflag = 'R' AS is_total FROM lineitem),
b AS (SELECT *, coalesce(sum(is_total::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM s),
r AS (SELECT *, sum(CASE WHEN NOT is_total THEN l_quantity ELSE 0 END) OVER (PARTITION BY l_orderkey, block) AS block_sum, sum(CASE WHEN NOT is_total THEN l_quantity ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY k) AS running FROM b)
SELECT l_orderkey, k, block_sum, running, CASE WHEN abs(l_quantity - running) < 5 THEN 'grand' WHEN abs(l_quantity - block_sum) < 5 THEN 'subtotal' ELSE 'other' END AS kind FROM r WHERE is_total""")
def total_kinds(t: Tables):
    """Whether a total row sums all rows above it or those since the last total."""
    w = Window.partitionBy("l_orderkey").orderBy("k")
    lines = spread(t("lineitem").select("l_orderkey", "l_returnflag", "l_quantity", *ORDER), "l_orderkey")
    s = lines.select("l_orderkey", "l_quantity", (F.col("l_returnflag") == "R").alias("is_total"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)).cast("long").alias("k"))
    b = s.withColumn("block", F.coalesce(F.sum(F.col("is_total").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    item = F.when(~F.col("is_total"), F.col("l_quantity")).otherwise(0.0)
    r = b.withColumn("block_sum", F.sum(item).over(Window.partitionBy("l_orderkey", "block"))).withColumn("running", F.sum(item).over(w))
    kind = F.when(F.abs(F.col("l_quantity") - F.col("running")) < 5, "grand").when(F.abs(F.col("l_quantity") - F.col("block_sum")) < 5, "subtotal").otherwise("other")
    return r.where("is_total").select("l_orderkey", "k", "block_sum", "running", kind.alias("kind"))


@query("""WITH s AS (SELECT p_type, p_size AS row_start, p_size + 4 AS row_end, min(p_brand) AS title FROM part WHERE p_size % 5 = 1 GROUP BY 1, 2)
SELECT p.p_partkey, s.title FROM part p LEFT JOIN s ON s.p_type = p.p_type AND p.p_size BETWEEN s.row_start AND s.row_end""")
def section_of_row(t: Tables):
    """The section whose interval of rows holds a row: an equi-join on key and bucket, then the bounds."""
    spans = t("part").where("p_size % 5 = 1").groupBy("p_type", F.col("p_size").alias("row_start")).agg(F.min("p_brand").alias("title")).withColumn("row_end", F.col("row_start") + 4)
    rows = t("part").select("p_partkey", "p_type", "p_size")
    return interval_join(rows, spans, ["p_type"], "p_size", "row_start", "row_end", size=5).select("p_partkey", "title")


@query("""WITH m AS (SELECT s_suppkey AS sheet, s_suppkey % 5 AS r1, s_suppkey % 5 + 3 AS r2, s_nationkey % 4 AS c1, s_nationkey % 4 + 2 AS c2, s_name AS anchor FROM supplier)
SELECT l_orderkey, l_linenumber, l_partkey, anchor FROM lineitem LEFT JOIN m ON sheet = l_suppkey AND l_linenumber BETWEEN r1 AND r2 AND l_partkey % 7 BETWEEN c1 AND c2""")
def merged_ranges(t: Tables):
    """The merged range that a cell lies in, by dyadic pieces of its rows and columns: equality joins, however many ranges a sheet has."""
    m = t("supplier").select(F.col("s_suppkey").alias("sheet"), (F.col("s_suppkey") % 5).alias("r1"), (F.col("s_suppkey") % 5 + 3).alias("r2"), (F.col("s_nationkey") % 4).alias("c1"), (F.col("s_nationkey") % 4 + 2).alias("c2"), F.col("s_name").alias("anchor"))
    cells = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("sheet"), F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 7).alias("col"))
    # each place once; merged ranges don't overlap
    found = contained(cells.select("sheet", "row", "col").distinct(), m, ["sheet"], [("row", "r1", "r2"), ("col", "c1", "c2")])
    return cells.join(found.select("sheet", "row", "col", "anchor"), ["sheet", "row", "col"], "left").select("l_orderkey", "l_linenumber", "l_partkey", "anchor")


@query("""WITH r AS (SELECT *, (l_partkey % 5 = 0) AS no_unit, (l_partkey % 7 = 0) AS no_total FROM lineitem), v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, CASE WHEN NOT no_unit THEN l_tax * 100 END AS ul, CASE WHEN NOT no_total THEN l_discount * 1000 END AS tm,
    CASE WHEN l_partkey % 3 = 0 THEN 20.0::DOUBLE END AS rate, CASE WHEN l_partkey % 4 = 0 THEN 0.5::DOUBLE END AS nh FROM r),
a AS (SELECT *, tm / q AS um FROM v), b AS (SELECT *, CASE WHEN nh IS NULL AND ul > 0 AND rate > 0 THEN ul / rate ELSE nh END AS nh2 FROM a),
c AS (SELECT *, CASE WHEN ul IS NULL AND nh2 > 0 AND rate > 0 AND um IS NOT NULL THEN nh2 * rate ELSE ul END AS ul2 FROM b), d AS (SELECT *, CASE WHEN rate IS NULL AND ul2 > 0 AND nh2 > 0 THEN ul2 / nh2 ELSE rate END AS rate2 FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, round(ul2, 9) AS unit_labour, round(um, 9) AS unit_material, round(nh2, 9) AS norm_h, round(rate2, 9) AS hourly_rate, round(ul2 * q, 9) AS total_labour FROM d WHERE coalesce(ul2, 0) > 0 OR coalesce(um, 0) > 0 OR coalesce(nh2, 0) > 0""")
def price_records(t: Tables):
    """Missing values of a priced row derived in a fixed order: material from total, hours from labour, labour from hours, rate from both."""
    q = F.col("l_quantity")
    v = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q.alias("q"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_tax") * 100).alias("ul"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_discount") * 1000).alias("tm"), F.when(F.col("l_partkey") % 3 == 0, 20.0).alias("rate"), F.when(F.col("l_partkey") % 4 == 0, 0.5).alias("nh"))
    pos = lambda c: F.col(c) > 0
    v = v.withColumn("um", F.col("tm") / F.col("q"))
    v = v.withColumn("nh", F.when(F.col("nh").isNull() & pos("ul") & pos("rate"), F.col("ul") / F.col("rate")).otherwise(F.col("nh")))
    v = v.withColumn("ul", F.when(F.col("ul").isNull() & pos("nh") & pos("rate") & F.col("um").isNotNull(), F.col("nh") * F.col("rate")).otherwise(F.col("ul")))
    v = v.withColumn("rate", F.when(F.col("rate").isNull() & pos("ul") & pos("nh"), F.col("ul") / F.col("nh")).otherwise(F.col("rate")))
    priced = v.where(F.coalesce(pos("ul"), F.lit(False)) | F.coalesce(pos("um"), F.lit(False)) | F.coalesce(pos("nh"), F.lit(False)))
    r = lambda c: F.round(c, 9)
    return priced.select("l_orderkey", "l_linenumber", "l_partkey", r("ul").alias("unit_labour"), r("um").alias("unit_material"), r("nh").alias("norm_h"), r("rate").alias("hourly_rate"), F.round(F.col("ul") * F.col("q"), 9).alias("total_labour"))


@query("""WITH p AS (SELECT l_suppkey, l_quantity AS q, l_extendedprice AS t, l_extendedprice / l_quantity AS u, l_discount * 1000 AS d FROM lineitem),
s AS (SELECT l_suppkey, avg(CASE WHEN abs(t - q * u) <= greatest(0.011, 0.006 * greatest(abs(t), abs(q * u))) THEN 1.0 ELSE 0.0 END) AS s1, avg(CASE WHEN abs(t - q * d) <= greatest(0.011, 0.006 * greatest(abs(t), abs(q * d))) THEN 1.0 ELSE 0.0 END) AS s2, count(*) AS n FROM p GROUP BY 1)
SELECT l_suppkey, s1 >= 0.7 AND n >= 2 AS unit_found, s2 >= 0.7 AND n >= 2 AS other_found FROM s""")
def column_relations(t: Tables):
    """Which column is the unit price: quantity times it is the total on most rows."""
    q, total = F.col("l_quantity"), F.col("l_extendedprice")
    share = lambda u: F.avg(F.when(close(total, q * u), 1.0).otherwise(0.0))
    s = t("lineitem").groupBy("l_suppkey").agg(share(total / q).alias("s1"), share(F.col("l_discount") * 1000).alias("s2"), F.count(F.lit(1)).alias("n"))
    return s.select("l_suppkey", ((F.col("s1") >= 0.7) & (F.col("n") >= 2)).alias("unit_found"), ((F.col("s2") >= 0.7) & (F.col("n") >= 2)).alias("other_found"))


@query(f"""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, {SQL_ORDER}) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
k AS (SELECT DISTINCT l_suppkey, floor(j * n / 40.0)::BIGINT AS i FROM (SELECT DISTINCT l_suppkey, n FROM r), (SELECT unnest(range(0, 40)) AS j))
SELECT r.l_suppkey, l_orderkey, l_linenumber, l_partkey FROM r JOIN k ON k.l_suppkey = r.l_suppkey AND k.i = r.i""")
def systematic_sample(t: Tables):
    """Forty evenly spaced rows of each sheet."""
    return systematic(t("lineitem"), ["l_suppkey"], ["l_orderkey", *ORDER], 40).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH v AS (SELECT p_brand AS file, CASE p_size % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'EUR' WHEN 2 THEN 'DKK' ELSE 'SEK' END AS currency, CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 1 END AS weight FROM part), s AS (SELECT file, currency, sum(weight) AS votes FROM v GROUP BY 1, 2)
SELECT file, arg_max(currency, (votes, currency)) AS currency, max(votes)::BIGINT AS votes FROM s GROUP BY file""")
def currency_vote(t: Tables):
    """Weighted vote: marks in text count three times as much as number formats."""
    currency = F.expr("CASE p_size % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'EUR' WHEN 2 THEN 'DKK' ELSE 'SEK' END")
    s = t("part").groupBy(F.col("p_brand").alias("file"), currency.alias("currency")).agg(F.sum(F.when(F.col("p_partkey") % 3 == 0, 3).otherwise(1)).alias("votes"))
    return s.groupBy("file").agg(F.max_by("currency", F.struct("votes", "currency")).alias("currency"), F.max("votes").alias("votes"))


#: A few frequent words for each language; a parameter of the detector.
LANGUAGE_WORDS = {"en": ("the", "of", "and", "to", "in", "is", "that"), "fr": ("de", "la", "le", "et", "les", "des", "que"), "de": ("der", "die", "und", "das", "den", "ist", "von"), "es": ("de", "la", "el", "que", "los", "del", "se")}
WORD_ROWS = [(w, lang, 2.0 / sum(w in ws for ws in LANGUAGE_WORDS.values())) for lang, words in LANGUAGE_WORDS.items() for w in words]


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), d AS (SELECT * FROM (VALUES {", ".join(f"('{w}', '{x}', {s}::DOUBLE)" for w, x, s in WORD_ROWS)}) v(word, lang, score)),
s AS (SELECT doc_id, lang, round(sum(score), 6) AS score FROM w JOIN d ON d.word = w.word GROUP BY 1, 2), b AS (SELECT doc_id, arg_max(lang, (score, lang)) AS lang, max(score) AS score FROM s GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN coalesce(score, 0) < 1 THEN 'en' ELSE b.lang END AS language FROM documents LEFT JOIN b ON b.doc_id = documents.doc_id""")
def word_list_language(t: Tables):
    """Language by scored words; words that several languages share count less for each."""
    words = F.broadcast(t.rows(WORD_ROWS, "word string, lang string, score double"))
    found = t("documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).join(words, "word")
    s = found.groupBy("doc_id", "lang").agg(F.round(F.sum("score"), 6).alias("score"))
    best = s.groupBy("doc_id").agg(F.max_by("lang", F.struct("score", "lang")).alias("lang"), F.max("score").alias("score"))
    return t("documents").select("doc_id").join(best, "doc_id", "left").select("doc_id", F.when(F.coalesce("score", F.lit(0.0)) < 1, "en").otherwise(F.col("lang")).alias("language"))


@query(f"""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SQL_ORDER}) AS k, l_linestatus = 'O' AS header, l_returnflag = 'R' AS total FROM lineitem),
h AS (SELECT l_orderkey, min(k) FILTER (WHERE header AND k <= 40) AS header_row, max(k) FILTER (WHERE NOT total) AS last_item FROM r GROUP BY 1)
SELECT r.l_orderkey, k, CASE WHEN k = header_row THEN 'header' WHEN total AND k > coalesce(last_item, 0) THEN 'grand_total' WHEN total THEN 'subtotal' ELSE 'item' END AS kind FROM r JOIN h ON h.l_orderkey = r.l_orderkey""")
def row_kinds(t: Tables):
    """Kind of each row from its place: one header near the top, totals after the last item."""
    w = Window.partitionBy("l_orderkey")
    r = t("lineitem").select("l_orderkey", F.row_number().over(w.orderBy(*ORDER)).cast("long").alias("k"), (F.col("l_linestatus") == "O").alias("header"), (F.col("l_returnflag") == "R").alias("total"))
    head = F.min(F.when(F.col("header") & (F.col("k") <= 40), F.col("k"))).over(w)
    last = F.coalesce(F.max(F.when(~F.col("total"), F.col("k"))).over(w), F.lit(0))
    kind = F.when(F.col("k") == head, "header").when(F.col("total") & (F.col("k") > last), "grand_total").when(F.col("total"), "subtotal").otherwise("item")
    return r.select("l_orderkey", "k", kind.alias("kind"))


@query("""WITH h AS (SELECT l_suppkey, l_linenumber, count(*) AS words, sum(CASE WHEN l_returnflag = 'N' THEN 2 ELSE 1 END) AS score FROM lineitem WHERE l_linenumber <= 40 GROUP BY 1, 2),
p AS (SELECT *, score + coalesce(lead(score) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber), 0) / 2.0 AS two FROM h)
SELECT l_suppkey, arg_max(l_linenumber, (greatest(score, two), -l_linenumber)) AS header_row, max(greatest(score, two))::DOUBLE AS score FROM p GROUP BY 1""")
def header_row(t: Tables):
    """The row that looks most like a header, alone or with the one below it."""
    h = t("lineitem").where("l_linenumber <= 40").groupBy("l_suppkey", "l_linenumber").agg(F.sum(F.when(F.col("l_returnflag") == "N", 2).otherwise(1)).alias("score"))
    below = F.coalesce(F.lead("score").over(Window.partitionBy("l_suppkey").orderBy("l_linenumber")), F.lit(0)) / 2
    best = h.withColumn("s", F.greatest(F.col("score").cast("double"), F.col("score") + below))
    return best.groupBy("l_suppkey").agg(F.max_by("l_linenumber", F.struct("s", -F.col("l_linenumber"))).alias("header_row"), F.max("s").alias("score"))


@query("""SELECT s_suppkey, max(l_shipdate) FILTER (WHERE l_shipdate <= TIMESTAMP '1998-01-01') AS last_label, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) FILTER (WHERE l_shipdate <= TIMESTAMP '1998-01-01') AS value
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def last_label_before(t: Tables):
    """The last value at or before a point."""
    before = F.col("l_shipdate") <= F.lit("1998-01-01").cast("timestamp_ntz")
    rows = t("lineitem").where(before).groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last_label"), F.max_by("l_quantity", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")).alias("value"))
    return t("supplier").select("s_suppkey").join(rows, F.col("l_suppkey") == F.col("s_suppkey"), "left").drop("l_suppkey")


@query("""SELECT l_orderkey AS file, bool_or(l_returnflag = 'R') AND NOT bool_or(l_tax > 0.07) AS unit_rate, sum(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0 END)::DOUBLE / count(*) AS electrical,
    CASE WHEN sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) * 2 > count(*) THEN 'yes' WHEN bool_or(l_returnflag = 'N') THEN 'maybe' ELSE 'no' END AS verdict FROM lineitem GROUP BY 1""")
def workbook_kind(t: Tables):
    """What kind of workbook a file is, from marks in any of its rows."""
    n = F.col("l_returnflag") == "N"
    return t("lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(
        (F.bool_or(F.col("l_returnflag") == "R") & ~F.bool_or(F.col("l_tax") > 0.07)).alias("unit_rate"),
        (F.count_if(n).cast("double") / F.count(F.lit(1))).alias("electrical"),
        F.when(F.count_if(n) * 2 > F.count(F.lit(1)), "yes").when(F.bool_or(n), "maybe").otherwise("no").alias("verdict"),
    )


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%steel%' THEN 'parameterised' WHEN p_size < 10 THEN 'category' ELSE 'item' END AS specificity, CASE WHEN p_name LIKE '%steel%' THEN p_size END AS parameter, round(p_retailprice / 1000, 6) AS hours FROM part WHERE p_retailprice > 950""")
def norm_records(t: Tables):
    """Norms with how specific they are."""
    steel = F.col("p_name").contains("steel")
    return t("part").where("p_retailprice > 950").select("p_partkey", F.when(steel, "parameterised").when(F.col("p_size") < 10, "category").otherwise("item").alias("specificity"), F.when(steel, F.col("p_size")).alias("parameter"), F.round(F.col("p_retailprice") / 1000, 6).alias("hours"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, (CASE WHEN l_partkey % 1000 >= 702 THEN chr((65 + ((l_partkey % 1000 + 1 - 703) // 676))::INTEGER) ELSE '' END) || (CASE WHEN l_partkey % 1000 + 1 > 26 THEN chr((65 + ((l_partkey % 1000 + 1 - 27) // 26) % 26)::INTEGER) ELSE '' END)
    || chr((65 + (l_partkey % 1000) % 26)::INTEGER) || l_linenumber AS cell, CASE WHEN l_discount * 100 - floor(l_discount * 100) >= 0 THEN floor(l_quantity / 4 * 1 + 0.5) END AS rounded FROM lineitem""")
def cell_names(t: Tables):
    """Spreadsheet coordinates and rounding half away from zero."""
    n = (F.col("l_partkey") % 1000 + 1).cast("int")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(column_letters(n), F.col("l_linenumber").cast("string")).alias("cell"), excel_round(F.col("l_quantity") / 4).alias("rounded"))


@query("""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) SELECT doc_id, len(list_filter(ls, lambda s: trim(s) <> '')) AS lines FROM x""")
def work_list_lines(t: Tables):
    """Lines of a work list that hold text."""
    return t("documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")).cast("long").alias("lines"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS raw_key FROM part""")
def raw_keys(t: Tables):
    """Keys that keep the brand."""
    return t("part").select("p_partkey", normalised(F.concat_ws(" ", "p_name", "p_brand")).alias("raw_key"))


@query("""WITH r AS (SELECT l_suppkey AS file_id, l_returnflag AS name, l_quantity * 7 AS labour, l_extendedprice AS material, l_quantity * 7 + l_extendedprice AS total, CASE l_returnflag WHEN 'A' THEN l_extendedprice * round(l_suppkey % 5 / 100.0 + 0.01, 2) WHEN 'N' THEN CASE WHEN l_discount < 0.07 THEN (l_quantity * 7 + l_extendedprice) * 0.1::DOUBLE ELSE l_tax * 1000 END ELSE l_tax * 1000 END AS value FROM lineitem),
u AS (SELECT file_id, name, unnest([{'i': 0, 'b': 'labour', 'r': round(value / nullif(labour, 0), 4)}, {'i': 1, 'b': 'material', 'r': round(value / nullif(material, 0), 4)}, {'i': 2, 'b': 'total', 'r': round(value / nullif(total, 0), 4)}]) AS x FROM r WHERE value IS NOT NULL),
v AS (SELECT file_id, name, x.i, x.b, x.r, count(*) AS c FROM u WHERE x.r IS NOT NULL GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY c DESC, i, r) AS k FROM v) WHERE k = 1), n AS (SELECT file_id, name, count(value) AS n FROM r GROUP BY 1, 2)
SELECT n.file_id, n.name, CASE WHEN c >= 2 AND c >= 0.5 * n THEN b.b ELSE 'total' END AS base, CASE WHEN c >= 2 AND c >= 0.5 * n THEN b.r END AS pct, n.n, coalesce(c, 0) AS votes, coalesce(c >= 2 AND c >= 0.5 * n, false) AS confirmed FROM n LEFT JOIN b ON b.file_id = n.file_id AND b.name = n.name""")
def markup_bases(t: Tables):
    """What the markups of a file are a share of, by votes of its rows; some are noise and some are shares of nothing."""
    labour, material = F.col("l_quantity") * 7, F.col("l_extendedprice")
    noise = F.col("l_tax") * 1000
    share = F.round(F.col("l_suppkey") % 5 / 100 + 0.01, 2)
    value = F.when(F.col("l_returnflag") == "A", material * share).when(F.col("l_returnflag") == "N", F.when(F.col("l_discount") < 0.07, (labour + material) * 0.1).otherwise(noise)).otherwise(noise)
    rows = t("lineitem").select(F.col("l_suppkey").alias("file_id"), F.col("l_returnflag").alias("name"), labour.alias("labour"), material.alias("material"), (labour + material).alias("total"), value.alias("value"))
    return ratio_consensus(rows, ["file_id", "name"], "value", ["labour", "material", "total"])
