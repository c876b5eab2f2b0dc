"""What is kept: replacing by file, labels and reports, filters of lists, and small rules of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rubicost.operators.merge import override, replace_groups, upsert
from rubicost.operators.topk import first_of, spread
from rubicost.registry import query
from rubicost.sources.files import clean_number, clean_value, shared_folder
from rubicost.sources.published import publish, published
from rubicost.tables import Tables, with_views


@query("""WITH o AS (SELECT l_suppkey AS file_id, l_orderkey AS sheet, l_linenumber AS row_no, l_partkey, l_quantity AS hours FROM lineitem WHERE l_returnflag <> 'A'), n AS (SELECT l_suppkey AS file_id, l_orderkey AS sheet, l_linenumber AS row_no, l_partkey, l_quantity + 1 AS hours FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 3 = 0),
f AS (SELECT DISTINCT file_id FROM n), b AS (SELECT * FROM n UNION ALL SELECT * FROM o WHERE file_id NOT IN (SELECT file_id FROM f)),
e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE END AS hours FROM part WHERE p_partkey % 7 = 0)
SELECT b.file_id, sheet, row_no, l_partkey, CASE WHEN e.k IS NOT NULL THEN e.hours ELSE b.hours END AS hours, e.k IS NOT NULL AS edited FROM b LEFT JOIN e ON e.k = l_partkey""")
def replaced_by_file(t: Tables):
    """A file read anew replaces all its rows; overrides are applied again, explicit nulls too."""
    rows = t("lineitem").select(F.col("l_suppkey").alias("file_id"), F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row_no"), "l_partkey", F.col("l_quantity").alias("hours"), F.col("l_returnflag").alias("flag"))
    old = rows.where("flag <> 'A'").drop("flag")
    new = rows.where("flag = 'A' AND file_id % 3 = 0").drop("flag").withColumn("hours", F.col("hours") + 1)
    edits = t("part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("double")).alias("hours"), F.array(F.lit("hours")).alias("fields"))
    return override(replace_groups(old, new, ["file_id"]), edits, ["l_partkey"], ["hours"])


@query("""WITH o AS (SELECT l_suppkey AS file_id, l_orderkey AS sheet, l_linenumber AS row_no, l_partkey, l_quantity AS hours FROM lineitem WHERE l_returnflag <> 'A'), n AS (SELECT l_suppkey AS file_id, l_orderkey AS sheet, l_linenumber AS row_no, l_partkey, l_quantity + 1 AS hours FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 3 = 0),
f AS (SELECT DISTINCT file_id FROM n UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 AND s_suppkey % 3 <> 0), b AS (SELECT * FROM n UNION ALL SELECT * FROM o WHERE file_id NOT IN (SELECT file_id FROM f)),
e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE END AS hours FROM part WHERE p_partkey % 7 = 0)
SELECT b.file_id, sheet, row_no, l_partkey, CASE WHEN e.k IS NOT NULL THEN e.hours ELSE b.hours END AS hours, e.k IS NOT NULL AS edited FROM b LEFT JOIN e ON e.k = l_partkey""")
def published_files(t: Tables):
    """Files written twice as transactions and read back: a second reading replaces a file's rows, a failed one takes them away, edits are applied again."""
    rows = t("lineitem").select(F.col("l_suppkey").alias("file_id"), F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row_no"), "l_partkey", F.col("l_quantity").alias("hours"), F.col("l_returnflag").alias("flag"))
    path = f"{shared_folder(t.spark)}/published-{uuid.uuid4().hex}"
    publish(rows.where("flag <> 'A'").drop("flag"), path)
    again = rows.where("flag = 'A' AND file_id % 3 = 0").drop("flag").withColumn("hours", F.col("hours") + 1)
    failed = t("supplier").where("s_acctbal < 0 AND s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("file_id"), F.lit("unreadable").alias("fail_reason"))
    publish(again.withColumn("fail_reason", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True), path)
    edits = t("part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("double")).alias("hours"), F.array(F.lit("hours")).alias("fields"))
    return override(published(t.spark, path), edits, ["l_partkey"], ["hours"])


@query("""WITH o AS (SELECT s_suppkey AS file_id, CASE WHEN s_suppkey % 2 = 0 THEN 'DENMARK' END AS market FROM supplier WHERE s_suppkey % 5 <> 0), n AS (SELECT s_suppkey AS file_id, n_name AS market FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0)
SELECT coalesce(o.file_id, n.file_id) AS file_id, coalesce(o.market, n.market) AS market FROM o FULL JOIN n ON n.file_id = o.file_id""")
def detected_markets(t: Tables):
    """A market set before stays; a detected one fills what is missing."""
    old = t("supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("file_id"), F.when(F.col("s_suppkey") % 2 == 0, "DENMARK").alias("market"))
    new = t("supplier").where("s_acctbal > 0").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("file_id"), F.col("n_name").alias("market"))
    return upsert(old, new, ["file_id"], F.col("o.market").isNotNull())


@query("""WITH o AS (SELECT p_brand AS file, p_type AS logic_key, min(p_name) AS sentence FROM part WHERE p_size < 30 GROUP BY 1, 2), n AS (SELECT p_brand AS file, p_type AS logic_key, max(p_name) AS sentence FROM part WHERE p_size % 7 = 0 GROUP BY 1, 2)
SELECT coalesce(n.file, o.file) AS file, coalesce(n.logic_key, o.logic_key) AS logic_key, coalesce(n.sentence, o.sentence) AS sentence FROM o FULL JOIN n ON n.file = o.file AND n.logic_key = o.logic_key""")
def logic_upsert(t: Tables):
    """Derived sentences are replaced by file and key."""
    part = t("part")
    key = [F.col("p_brand").alias("file"), F.col("p_type").alias("logic_key")]
    old = part.where("p_size < 30").groupBy(*key).agg(F.min("p_name").alias("sentence"))
    new = part.where("p_size % 7 = 0").groupBy(*key).agg(F.max("p_name").alias("sentence"))
    return upsert(old, new, ["file", "logic_key"], F.lit(False))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, nullif(trim(l_returnflag || ' '), 'N') AS flag, CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS tax, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem""")
def clean_cells(t: Tables):
    """Cell values as they are kept: spaces of all kinds trimmed, nothing for what is empty or no number, ISO dates."""
    flag = F.concat(F.lit("  "), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")), F.lit(" "))
    tax = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", clean_value(flag).alias("flag"), clean_number(tax).alias("tax"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'N') AND coalesce(CASE WHEN l_linenumber % 3 = 0 THEN l_partkey % 2 = 0 END, true) AND l_linestatus = 'O'""")
def priced_row_filter(t: Tables):
    """Rows of sheets that hold prices: not those known to be of another trade, and items only."""
    electrical = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey") % 2 == 0)
    return t("lineitem").where(F.col("l_returnflag").isin("A", "N") & F.coalesce(electrical, F.lit(True)) & (F.col("l_linestatus") == "O")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '%urg%' AND o_orderdate >= TIMESTAMP '1997-01-01'""")
def list_filters(t: Tables):
    """Filters of a list by status, text and age."""
    since = F.lit("1997-01-01").cast("timestamp_ntz")
    return t("orders").where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").ilike("%urg%") & (F.col("o_orderdate") >= since)).select("o_orderkey", "o_custkey")


@query("""WITH r AS (SELECT l_suppkey AS sheet, l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 'section' WHEN 'A' THEN 'subtotal' ELSE 'item' END AS kind, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem WHERE l_returnflag IN ('R', 'A'))
SELECT sheet, l_orderkey, l_linenumber, kind FROM r WHERE k <= 2000""")
def outline_rows(t: Tables):
    """Structural rows of each sheet, at most two thousand: what a viewer shows beside its page."""
    kind = F.when(F.col("l_returnflag") == "R", "section").when(F.col("l_returnflag") == "A", "subtotal").otherwise("item")
    rows = t("lineitem").where("l_returnflag IN ('R', 'A')").select(F.col("l_suppkey").alias("sheet"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", kind.alias("kind"))
    return first_of(rows, ["sheet"], *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")), n=2000).select("sheet", "l_orderkey", "l_linenumber", "kind")


@query(f"""{with_views("files", "items")}, i AS (SELECT file_id, count(*) AS prices, count(*) FILTER (WHERE qty > 25) AS with_hours FROM items GROUP BY 1), n AS (SELECT p_partkey % 100 AS file_id, count(*) AS norms FROM part WHERE p_size < 10 GROUP BY 1), u AS (SELECT user_id % 100 AS file_id, sum(value::DECIMAL(18,2)) AS cost FROM events GROUP BY 1)
SELECT f.file_id, '| ' || name || ' | ' || CASE WHEN balance < 0 THEN 'failed' ELSE 'ready' END || ' | ' || coalesce(prices, 0) || ' | ' || coalesce(with_hours, 0) || ' | ' || coalesce(norms, 0) || ' | $' || printf('%.4f', coalesce(cost, 0)::DOUBLE) || ' |' AS line
FROM files f LEFT JOIN i ON i.file_id = f.file_id LEFT JOIN n ON n.file_id = f.file_id LEFT JOIN u ON u.file_id = f.file_id""")
def ingest_report(t: Tables):
    """A line of the report for each file: state, rows, rows with hours, norms and cost."""
    items = t.items().groupBy("file_id").agg(F.count(F.lit(1)).alias("prices"), F.count_if(F.col("qty") > 25).alias("with_hours"))
    norms = t("part").where("p_size < 10").groupBy((F.col("p_partkey") % 100).alias("file_id")).agg(F.count(F.lit(1)).alias("norms"))
    cost = t("events").groupBy((F.col("user_id") % 100).alias("file_id")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("cost"))
    rows = t.files().join(items, "file_id", "left").join(norms, "file_id", "left").join(cost, "file_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    state = F.when(F.col("balance") < 0, "failed").otherwise("ready")
    return rows.select("file_id", F.format_string("| %s | %s | %d | %d | %d | $%.4f |", "name", state, n("prices"), n("with_hours"), n("norms"), n("cost").cast("double")).alias("line"))


# Labels of price sources and the word for a row, by language.
SOURCE_LABELS = {
    "EN": {"exact": "Reference", "norm": "Norm", "web": "Web", "none": "NO PRICE", "row": "row"},
    "LV": {"exact": "Atsauce", "norm": "Norma", "web": "Internets", "none": "NAV CENAS", "row": "r."},
    "DA": {"exact": "Reference", "norm": "Norm", "web": "Web", "none": "INGEN PRIS", "row": "række"},
    "DE": {"exact": "Referenz", "norm": "Norm", "web": "Web", "none": "KEIN PREIS", "row": "Zeile"},
}


def source_label(source, language, file_name, row_no, labels: dict[str, dict[str, str]] = SOURCE_LABELS):
    """Where a price comes from, in the sheet's language (English if it has no labels)."""
    table = F.create_map(*[F.lit(x) for lang, own in labels.items() for k, v in own.items() for x in (f"{lang}:{k}", v)])
    say = lambda key: F.coalesce(F.try_element_at(table, F.concat(F.upper(language), F.lit(":"), key)), F.try_element_at(table, F.concat(F.lit("EN:"), key)), key)
    place = F.when(source == "exact", F.concat(F.lit(": "), file_name, F.lit(" "), say(F.lit("row")), F.lit(" "), row_no.cast("string"))).when(source.isin("norm", "web"), F.concat(F.lit(": "), file_name))
    return F.concat(say(source), F.coalesce(place, F.lit("")))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, s_name, CASE l_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'norm' WHEN 2 THEN 'web' ELSE 'none' END AS source, CASE l_suppkey % 3 WHEN 0 THEN 'lv' WHEN 1 THEN 'de' ELSE 'fr' END AS lang FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT l_orderkey, l_linenumber, l_partkey, CASE source WHEN 'exact' THEN CASE lang WHEN 'lv' THEN 'Atsauce' WHEN 'de' THEN 'Referenz' ELSE 'Reference' END || ': ' || s_name || CASE lang WHEN 'lv' THEN ' r. ' WHEN 'de' THEN ' Zeile ' ELSE ' row ' END || l_linenumber
    WHEN 'norm' THEN CASE lang WHEN 'lv' THEN 'Norma' ELSE 'Norm' END || ': ' || s_name WHEN 'web' THEN CASE lang WHEN 'lv' THEN 'Internets' ELSE 'Web' END || ': ' || s_name ELSE CASE lang WHEN 'lv' THEN 'NAV CENAS' WHEN 'de' THEN 'KEIN PREIS' ELSE 'NO PRICE' END END AS label FROM x""")
def source_labels(t: Tables):
    """Source column of a filled sheet in its language."""
    source = F.expr("CASE l_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'norm' WHEN 2 THEN 'web' ELSE 'none' END")
    lang = F.expr("CASE l_suppkey % 3 WHEN 0 THEN 'lv' WHEN 1 THEN 'de' ELSE 'fr' END")
    rows = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", source_label(source, lang, F.col("s_name"), F.col("l_linenumber")).alias("label"))


def loose_number(text):
    """A number whose last separator is decimal and whose only comma is; spaces and the euro sign go."""
    s = F.translate(F.trim(text), "€  ", "")
    commas, dots = F.instr(s, F.lit(",")) > 0, F.instr(s, F.lit(".")) > 0
    comma_last = F.instr(F.reverse(s), F.lit(",")) < F.instr(F.reverse(s), F.lit("."))
    plain = F.when(commas & dots & comma_last, F.translate(F.translate(s, ".", ""), ",", ".")).when(commas & dots, F.translate(s, ",", "")).when(commas, F.translate(s, ",", ".")).otherwise(s)
    return plain.try_cast("double")


# Units of bills of quantities.
UNIT_NAMES = {"no": ("no", "nr", "no.", "nr.", "pcs", "pc", "ea", "each", "gab", "gab.", "stk"), "m": ("m", "lm", "mtr", "m."), "item": ("item", "items", "ls", "sum"), "week": ("wks", "wk", "week", "weeks"), "month": ("month", "months", "mth", "mths"), "%": ("%",), "m2": ("m2", "m²"), "set": ("set",), "kg": ("kg",)}


def unit_name(text):
    """Canonical unit of a bill's line, an unknown one in lower case, null for none."""
    low = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    table = F.create_map(*[F.lit(x) for name, words in UNIT_NAMES.items() for w in words for x in (w, name)])
    return F.coalesce(F.try_element_at(table, low), F.nullif(low, F.lit("")))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 5 THEN NULL ELSE p_size + 1000.5 END::DOUBLE AS value, CASE p_partkey % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'week' WHEN 2 THEN 'bag' WHEN 3 THEN 'm2' END AS unit FROM part""")
def loose_numbers_and_units(t: Tables):
    """Numbers with separators either way, and units of bills of quantities."""
    n = (F.col("p_size") + 1000).cast("string")
    k = F.col("p_partkey") % 6
    grouped = lambda a: F.concat(F.substring(n, 1, 1), F.lit(a), F.substring(n, 2, 3))
    text = F.when(k == 0, F.concat(n, F.lit(",5"))).when(k == 1, F.concat(F.lit("€ "), grouped(","), F.lit(".50"))).when(k == 2, F.concat(grouped("."), F.lit(",5 "))).when(k == 3, F.concat(grouped(" "), F.lit(".5"))).when(k == 4, F.concat(grouped(" "), F.lit(",50 €"))).otherwise("on request")
    unit = F.element_at(F.array(*map(F.lit, ("Gab.", " WKS", "Bag", "m²", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t("part").select("p_partkey", loose_number(text).alias("value"), unit_name(unit).alias("unit"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0 THEN l_quantity END AS qty, CASE WHEN l_discount > 0 THEN l_discount * 100 END AS labour, CASE WHEN l_partkey % 3 > 0 THEN l_tax * 100 END AS material, CASE l_partkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'item' WHEN 2 THEN 'band' WHEN 3 THEN 'web' END AS method,
    CASE WHEN l_discount > 0 THEN CASE l_linenumber % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END END AS c1, CASE WHEN l_partkey % 3 > 0 THEN CASE l_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END END AS c2 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(qty * labour, 6) AS total_labour, round(qty * material, 6) AS total_material, round(CASE WHEN labour IS NOT NULL OR material IS NOT NULL THEN coalesce(labour, 0) + coalesce(material, 0) END, 6) AS unit_total,
    CASE method WHEN 'exact' THEN 'exact' WHEN 'item' THEN 'exact' WHEN 'band' THEN 'semantic' WHEN 'web' THEN 'web' ELSE 'none' END AS source, CASE WHEN 'low' IN (c1, c2) THEN 'low' WHEN 'medium' IN (c1, c2) THEN 'medium' WHEN c1 IS NOT NULL OR c2 IS NOT NULL THEN 'high' END AS confidence FROM x""")
def row_totals(t: Tables):
    """Totals of rows, null where a factor is; the source of a method, and the weakest confidence of a row's parts."""
    grade = lambda c: F.when(F.col(c) % 3 == 0, 0).when(F.col(c) % 3 == 1, 1).otherwise(2)
    x = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("qty"), F.when(F.col("l_discount") > 0, F.col("l_discount") * 100).alias("labour"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_tax") * 100).alias("material"), F.expr("CASE l_partkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'item' WHEN 2 THEN 'band' WHEN 3 THEN 'web' END").alias("method"))
    weakest = F.least(F.when(F.col("labour").isNotNull(), grade("l_linenumber")), F.when(F.col("material").isNotNull(), grade("l_orderkey")))
    some = F.col("labour").isNotNull() | F.col("material").isNotNull()
    source = F.when(F.col("method").isin("exact", "item"), "exact").when(F.col("method").isin("band", "text", "similar"), "semantic").when(F.col("method") == "web", "web").otherwise("none")
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(F.col("qty") * F.col("labour"), 6).alias("total_labour"),
        F.round(F.col("qty") * F.col("material"), 6).alias("total_material"),
        F.round(F.when(some, F.coalesce("labour", F.lit(0)) + F.coalesce("material", F.lit(0))), 6).alias("unit_total"),
        source.alias("source"),
        F.when(weakest == 0, "low").when(weakest == 1, "medium").when(weakest == 2, "high").alias("confidence"),
    )


@query("""WITH f AS (SELECT l_orderkey AS document, count(*) AS items, count(*) FILTER (WHERE l_discount = 0) AS open, count(DISTINCT l_suppkey) AS files, sum(l_extendedprice::DECIMAL(18,2)) AS total FROM lineitem GROUP BY 1)
SELECT document, items || ' rows priced from ' || files || CASE WHEN files = 1 THEN ' file' ELSE ' files' END || ', total ' || printf('%.2f', total::DOUBLE) || ' EUR' || CASE WHEN open > 0 THEN '; ' || open || ' without a price' ELSE '' END || '.' AS sentence FROM f""")
def delivery_sentences(t: Tables):
    """A sentence about each delivered document, from its aggregates."""
    lines = spread(t("lineitem").select("l_orderkey", "l_suppkey", "l_discount", "l_extendedprice"), "l_orderkey")
    f = lines.groupBy(F.col("l_orderkey").alias("document")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("l_discount") == 0).alias("open"), F.count_distinct("l_suppkey").alias("files"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))
    files = F.when(F.col("files") == 1, " file").otherwise(" files")
    open_ = F.when(F.col("open") > 0, F.format_string("; %d without a price", "open")).otherwise("")
    return f.select("document", F.concat(F.format_string("%d rows priced from %d", "items", "files"), files, F.format_string(", total %.2f EUR", "total"), open_, F.lit(".")).alias("sentence"))


@query("""SELECT doc_id, CASE WHEN length(trim(regexp_replace(regexp_replace(lower(left(text, 40)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'))) = 0 THEN 'file' ELSE regexp_replace(regexp_replace(lower(left(text, 40)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS slug FROM documents""")
def slugs(t: Tables):
    """File names made of titles."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.substring("text", 1, 40)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return t("documents").select("doc_id", F.when(slug == "", "file").otherwise(slug).alias("slug"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, list_filter([CASE WHEN l_tax = 0 THEN 'NO PRICE' END, CASE WHEN l_discount > 0.08 THEN 'CHECK' END, CASE WHEN l_partkey % 7 = 0 THEN 'WEB' END, CASE WHEN l_partkey % 11 = 0 THEN 'EDITED' END], lambda x: x IS NOT NULL) AS f FROM lineitem)
SELECT filter, count(*) AS n FROM (SELECT unnest(CASE WHEN len(f) > 0 THEN ['flagged'] ELSE [] END || CASE WHEN list_has_any(f, ['CHECK', 'NO PRICE']) THEN ['attention'] ELSE [] END || CASE WHEN list_contains(f, 'WEB') THEN ['web'] ELSE [] END || CASE WHEN list_contains(f, 'CHECK') THEN ['check'] ELSE [] END
    || CASE WHEN list_contains(f, 'NO PRICE') THEN ['no_price'] ELSE [] END || CASE WHEN list_contains(f, 'EDITED') THEN ['edited'] ELSE [] END) AS filter FROM m) GROUP BY filter""")
def filter_counts(t: Tables):
    """Rows that each of the viewer's six marker filters shows."""
    flags = F.array_compact(F.array(F.when(F.col("l_tax") == 0, "NO PRICE"), F.when(F.col("l_discount") > 0.08, "CHECK"), F.when(F.col("l_partkey") % 7 == 0, "WEB"), F.when(F.col("l_partkey") % 11 == 0, "EDITED")))
    has = lambda x: F.array_contains("f", x)
    shows = {"flagged": F.size("f") > 0, "attention": has("CHECK") | has("NO PRICE"), "web": has("WEB"), "check": has("CHECK"), "no_price": has("NO PRICE"), "edited": has("EDITED")}
    rows = t("lineitem").select(flags.alias("f")).select(F.explode(F.array_compact(F.array(*(F.when(c, name) for name, c in shows.items())))).alias("filter"))
    return rows.groupBy("filter").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.z') AS has_z, event_type AS type, value * 2 AS value FROM events""")
def json_fields(t: Tables):
    """Fields of a JSON column: read, tested, and merged with new ones, of which the later win."""
    m = F.from_json("props", "map<string,string>")
    new = F.create_map(F.lit("type"), F.col("event_type"), F.lit("value"), (F.col("value") * 2).cast("string"))
    kept = F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(new), k))  # the later value of a key wins
    merged = F.map_concat(kept, new)
    get = lambda k: F.try_element_at(merged, F.lit(k))
    return t("events").select("event_id", get("k").cast("bigint").alias("k"), F.map_contains_key(m, "k").alias("has_k"), F.map_contains_key(m, "z").alias("has_z"), get("type").alias("type"), get("value").cast("double").alias("value"))


@query("""SELECT user_id, sum(value::DECIMAL(18,2))::DOUBLE AS spent, CASE WHEN sum(value::DECIMAL(18,2)) >= 4000 THEN 'over' WHEN sum(value::DECIMAL(18,2)) >= 3200 THEN 'near' ELSE 'ok' END AS status FROM events GROUP BY user_id""")
def user_budgets(t: Tables, amount: float = 4000.0, alert: int = 80):
    """State of each user's budget, as a SQL table function: over from its amount on, near from its alert share on; an amount of nothing is no limit."""
    name = uuid.uuid4().hex
    t("events").createOrReplaceTempView(f"spent_{name}")
    t.spark.sql(f"""CREATE TEMPORARY FUNCTION budget_{name}(amount DOUBLE, alert DOUBLE) RETURNS TABLE(user_id BIGINT, spent DOUBLE, status STRING)
        RETURN SELECT user_id, spent, CASE WHEN amount <= 0 THEN 'ok' WHEN spent >= amount THEN 'over' WHEN spent >= amount * alert / 100 THEN 'near' ELSE 'ok' END
        FROM (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM spent_{name} GROUP BY user_id)""")
    out = t.spark.sql(f"SELECT * FROM budget_{name}(CAST({float(amount)} AS DOUBLE), CAST({float(alert)} AS DOUBLE))")
    # the plan holds both by now
    t.spark.sql(f"DROP TEMPORARY FUNCTION budget_{name}")
    t.spark.catalog.dropTempView(f"spent_{name}")
    return out


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < 0) THEN l_extendedprice END AS price FROM lineitem""")
def unlocked_prices(t: Tables):
    """Prices that are told only while a condition holds, as a SQL scalar function."""
    name = uuid.uuid4().hex
    t("supplier").createOrReplaceTempView(f"files_{name}")
    t.spark.sql(f"CREATE TEMPORARY FUNCTION unlocked_{name}() RETURNS BOOLEAN RETURN EXISTS (SELECT 1 FROM files_{name} WHERE s_acctbal < 0)")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(f"CASE WHEN unlocked_{name}() THEN l_extendedprice END").alias("price"))
