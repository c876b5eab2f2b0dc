"""The row viewer and the estimate document: markers, paging, edits, versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rubicost.operators.merge import upsert
from rubicost.registry import query
from rubicost.tables import Tables

ROWS = """r AS (SELECT l_orderkey AS sheet, l_linenumber AS row_no, l_partkey, l_quantity AS qty, l_extendedprice AS total,
    CASE l_partkey % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'semantic' WHEN 2 THEN 'web' WHEN 3 THEN 'none' WHEN 4 THEN 'edited' ELSE 'norm' END AS source,
    CASE WHEN l_suppkey % 4 = 0 THEN ['CHECK'] ELSE []::VARCHAR[] END AS flags FROM lineitem)"""
MARKED = f"""{ROWS}, m AS (SELECT *, list_distinct(list_concat(flags, CASE source WHEN 'web' THEN ['WEB'] WHEN 'none' THEN ['NO PRICE'] WHEN 'edited' THEN ['EDITED'] ELSE []::VARCHAR[] END)) AS all_flags FROM r)"""
MARKER = "CASE WHEN list_contains(all_flags, 'EDITED') THEN 'EDITED' WHEN list_contains(all_flags, 'NO PRICE') THEN 'NO PRICE' WHEN list_contains(all_flags, 'WEB') THEN 'WEB' WHEN list_contains(all_flags, 'CHECK') THEN 'CHECK' END"


def rows_of(t: Tables):
    source = F.expr("CASE l_partkey % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'semantic' WHEN 2 THEN 'web' WHEN 3 THEN 'none' WHEN 4 THEN 'edited' ELSE 'norm' END")
    flags = F.when(F.col("l_suppkey") % 4 == 0, F.array(F.lit("CHECK"))).otherwise(F.array().cast("array<string>"))
    return t("lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row_no"), "l_partkey", F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("total"), source.alias("source"), flags.alias("flags"))


def marked(t: Tables):
    """Rows with their effective flags and the marker that takes precedence."""
    own = F.expr("CASE source WHEN 'web' THEN array('WEB') WHEN 'none' THEN array('NO PRICE') WHEN 'edited' THEN array('EDITED') ELSE CAST(array() AS array<string>) END")
    rows = rows_of(t).withColumn("all_flags", F.array_union("flags", own))
    marker = F.coalesce(*[F.when(F.array_contains("all_flags", m), m) for m in ("EDITED", "NO PRICE", "WEB", "CHECK")])
    return rows.withColumn("marker", marker)


@query(f"""WITH {MARKED} SELECT sheet, row_no, l_partkey, total, {MARKER} AS marker, len(all_flags) AS n_flags FROM m""")
def row_markers(t: Tables):
    return marked(t).select("sheet", "row_no", "l_partkey", "total", "marker", F.size("all_flags").cast("long").alias("n_flags"))


@query(f"""WITH {MARKED} SELECT sheet % 50 AS sheet, count(*) AS n, count(*) FILTER (WHERE list_contains(all_flags, 'WEB')) AS web, count(*) FILTER (WHERE list_contains(all_flags, 'CHECK')) AS checks,
    count(*) FILTER (WHERE list_contains(all_flags, 'NO PRICE')) AS no_price, count(*) FILTER (WHERE len(all_flags) > 0) AS flagged, count(*) FILTER (WHERE list_has_any(all_flags, ['CHECK', 'NO PRICE'])) AS attention FROM m GROUP BY 1""")
def marker_counts(t: Tables):
    """Counts by sheet; a row counts once for each flag it has, and once as flagged."""
    has = lambda f: F.array_contains("all_flags", f)
    attention = F.arrays_overlap("all_flags", F.array(F.lit("CHECK"), F.lit("NO PRICE")))
    return marked(t).groupBy((F.col("sheet") % 50).alias("sheet")).agg(F.count(F.lit(1)).alias("n"), F.count_if(has("WEB")).alias("web"), F.count_if(has("CHECK")).alias("checks"), F.count_if(has("NO PRICE")).alias("no_price"), F.count_if(F.size("all_flags") > 0).alias("flagged"), F.count_if(attention).alias("attention"))


@query(f"""WITH {MARKED} SELECT coalesce(sum(total::DECIMAL(18,2)), 0)::DOUBLE AS total, sum(qty)::DOUBLE AS qty, count(*) FILTER (WHERE source = 'none') AS none_rows, count(*) FILTER (WHERE source = 'web') AS web_rows,
    count(*) FILTER (WHERE list_contains(flags, 'CHECK')) AS check_rows FROM m""")
def document_totals(t: Tables):
    """Totals over all rows of a document and counts by flag and source."""
    return rows_of(t).agg(F.coalesce(F.sum(F.col("total").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("total"), F.sum("qty").alias("qty"), F.count_if(F.col("source") == "none").alias("none_rows"), F.count_if(F.col("source") == "web").alias("web_rows"), F.count_if(F.array_contains("flags", "CHECK")).alias("check_rows"))


@query(f"""WITH {MARKED} SELECT sheet, row_no, l_partkey, total FROM m WHERE list_has_any(all_flags, ['CHECK', 'NO PRICE']) AND {MARKER} <> 'EDITED'""")
def attention_rows(t: Tables):
    """Marker filter of the viewer."""
    return marked(t).where(F.arrays_overlap("all_flags", F.array(F.lit("CHECK"), F.lit("NO PRICE"))) & (F.col("marker") != "EDITED")).select("sheet", "row_no", "l_partkey", "total")


@query("""WITH f AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE contains(lower(concat_ws(chr(31), source, lang, text)), lower('Src7')))
SELECT doc_id, lang, source FROM f ORDER BY doc_id LIMIT 200""")
def find_in_rows(t: Tables):
    """Case-insensitive search over the displayed cells of a row."""
    shown = F.lower(F.concat_ws("\x1f", "source", "lang", "text"))
    return t("documents").where(F.contains(shown, F.lower(F.lit("Src7")))).orderBy("doc_id").limit(200).select("doc_id", "lang", "source")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos, l_suppkey FROM lineitem),
a AS (SELECT l_suppkey, coalesce(min(pos) FILTER (WHERE l_orderkey >= 3000), max(pos)) AS place FROM r GROUP BY l_suppkey)
SELECT r.l_suppkey, pos, l_orderkey, l_linenumber FROM r JOIN a ON a.l_suppkey = r.l_suppkey WHERE pos // 25 = place // 25""")
def page_around_row(t: Tables):
    """For each sheet the page of 25 rows that holds the first row at or after a given one."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    rows = t("lineitem").withColumn("pos", (F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)) - 1).cast("long"))
    at = rows.groupBy("l_suppkey").agg(F.coalesce(F.min(F.when(F.col("l_orderkey") >= 3000, F.col("pos"))), F.max("pos")).alias("at"))
    return rows.join(at, "l_suppkey").where(F.floor(F.col("pos") / 25) == F.floor(F.col("at") / 25)).select("l_suppkey", "pos", "l_orderkey", "l_linenumber")


@query("""WITH s AS (SELECT l_suppkey, avg(CASE WHEN l_discount > 0 THEN 1.0 ELSE 0.0 END) AS fill, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS elec, avg(CASE WHEN l_quantity < 40 THEN 1.0 ELSE 0.0 END) AS tame FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(0.55 * fill + 0.30 * elec + 0.15 * tame, 6) AS confidence FROM s""")
def sheet_confidence(t: Tables):
    """How sure the sheet is the one to fill: weighted shares."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    s = t("lineitem").groupBy("l_suppkey").agg(share(F.col("l_discount") > 0).alias("fill"), share(F.col("l_returnflag") == "N").alias("elec"), share(F.col("l_quantity") < 40).alias("tame"))
    return s.select("l_suppkey", F.round(0.55 * F.col("fill") + 0.30 * F.col("elec") + 0.15 * F.col("tame"), 6).alias("confidence"))


@query("""WITH o AS (SELECT p_partkey AS k, p_retailprice AS price, CASE WHEN p_partkey % 7 = 0 THEN 'edited' ELSE 'exact' END AS source FROM part WHERE p_partkey % 3 <> 0),
n AS (SELECT p_partkey AS k, p_retailprice + 1 AS price, 'semantic' AS source FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NOT NULL AND (n.k IS NULL OR o.source = 'edited') THEN o.price ELSE n.price END AS price,
    CASE WHEN o.k IS NOT NULL AND (n.k IS NULL OR o.source = 'edited') THEN o.source ELSE n.source END AS source FROM o FULL JOIN n ON o.k = n.k""")
def upsert_keep_edited(t: Tables):
    """A re-price replaces rows except those that were edited."""
    part = t("part")
    old = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"), F.when(F.col("p_partkey") % 7 == 0, "edited").otherwise("exact").alias("source"))
    new = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") + 1).alias("price"), F.lit("semantic").alias("source"))
    return upsert(old, new, ["k"], F.col("o.source") == "edited")


@query("""WITH e AS (SELECT p_partkey AS k, arg_min(p_retailprice, p_size) AS x FROM part GROUP BY 1), b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice AS labour FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k IS NOT NULL AND k % 11 = 0 THEN round(x * l_quantity, 2) ELSE labour END AS labour, CASE WHEN k % 11 = 0 THEN labour END AS original, coalesce(k % 11 = 0, false) AS edited
FROM b LEFT JOIN e ON k = l_partkey""")
def edited_rows(t: Tables):
    """Edits recompute a row; the value before the first edit is kept."""
    edits = t("part").where("p_partkey % 11 = 0").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("x"))
    base = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("l_extendedprice").alias("labour"))
    hit = F.col("k").isNotNull()
    return base.join(edits, F.col("k") == F.col("l_partkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", F.when(hit, F.round(F.col("x") * F.col("l_quantity"), 2)).otherwise(F.col("labour")).alias("labour"), F.when(hit, F.col("labour")).alias("original"), hit.alias("edited"))


@query("""WITH v AS (SELECT o_custkey AS document, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_totalprice FROM orders)
SELECT document, max(version) AS versions, arg_max(o_orderkey, version) AS latest, round(arg_max(o_totalprice, version), 2) AS total FROM v GROUP BY document""")
def document_versions(t: Tables):
    """Version numbers of a document and its latest version."""
    when = F.struct("o_orderdate", "o_orderkey")
    return t("orders").groupBy(F.col("o_custkey").alias("document")).agg(F.count(F.lit(1)).alias("versions"), F.max_by("o_orderkey", when).alias("latest"), F.round(F.max_by("o_totalprice", when), 2).alias("total"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_linestatus = 'F' THEN 'skip_filled' WHEN l_discount = 0 THEN 'skip_formula' WHEN l_quantity > 45 THEN 'skip_merged' ELSE 'write' END AS decision FROM lineitem)
SELECT decision, count(*) AS n, sum(CASE WHEN decision = 'write' THEN l_quantity ELSE 0 END)::DOUBLE AS written FROM d GROUP BY decision""")
def write_report(t: Tables):
    """Which cells would be written and why others are left alone."""
    decision = F.when(F.col("l_linestatus") == "F", "skip_filled").when(F.col("l_discount") == 0, "skip_formula").when(F.col("l_quantity") > 45, "skip_merged").otherwise("write")
    rows = t("lineitem").select(decision.alias("decision"), "l_quantity")
    return rows.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("decision") == "write", F.col("l_quantity")).otherwise(0.0)).alias("written"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey AS section, 'item' AS kind, k + 1 AS line, l_quantity AS qty FROM g UNION ALL SELECT DISTINCT l_orderkey, 'section', 1, NULL FROM g
UNION ALL SELECT l_orderkey, 'subtotal', max(n) + 2, sum(l_quantity) FROM g GROUP BY l_orderkey""")
def workbook_layout(t: Tables):
    """Lines of a generated workbook: a heading, the items and a subtotal for each section."""
    w = Window.partitionBy("l_orderkey")
    g = t("lineitem").select("l_orderkey", "l_quantity", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_extendedprice")).alias("k"))
    items = g.select(F.col("l_orderkey").alias("section"), F.lit("item").alias("kind"), (F.col("k") + 1).cast("long").alias("line"), F.col("l_quantity").alias("qty"))
    ends = g.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    heads = ends.select(F.col("l_orderkey").alias("section"), F.lit("section").alias("kind"), F.lit(1).cast("long").alias("line"), F.lit(None).cast("double").alias("qty"))
    return items.unionByName(heads).unionByName(ends.select(F.col("l_orderkey").alias("section"), F.lit("subtotal").alias("kind"), (F.col("n") + 2).alias("line"), F.col("q").alias("qty")))


@query("""WITH m AS (SELECT s_suppkey, max(CASE WHEN s_acctbal < 0 THEN 'CHECK' END) AS marker FROM supplier GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, marker FROM lineitem LEFT JOIN m ON s_suppkey = l_suppkey""")
def markers_joined(t: Tables):
    """Viewer rows with the markers of another table."""
    m = t("supplier").groupBy("s_suppkey").agg(F.max(F.when(F.col("s_acctbal") < 0, "CHECK")).alias("marker"))
    return t("lineitem").join(m, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "marker")
