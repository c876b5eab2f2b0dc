"""Bills of quantities: lines, their rate keys and labels, quotes from references, basis and totals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rubicost.functions.boq import INSTALL_KEY, install_key, line_attributes, section_kind, with_card_label
from rubicost.operators.topk import mode_first_seen
from rubicost.registry import query
from rubicost.sources.files import stored
from rubicost.tables import Tables


def description():
    """Ten kinds of lines, with numbers that follow the part's size."""
    s = F.col("p_size")
    text = lambda x: x.cast("string")
    width = text(100 + 50 * (s % 5))
    lines = [
        F.concat(width, F.lit(" x 60mm Cable Tray - (b) Tee")),
        F.concat(F.lit("EXT - "), width, F.lit("mm Ladder")),
        F.concat(text(s % 4 + 2), F.lit("C 2.5MM Cable LSOH")),
        F.lit("6MM 5 CORE flex"),
        F.concat(text(F.element_at(F.array(F.lit(16), F.lit(32), F.lit(63)), s % 3 + 1)), F.lit(" Amp 3PH isolator")),
        F.concat(F.lit("Type - C"), text(s % 3 + 1), F.lit(" - ZUMTOBEL downlight")),
        F.concat(F.lit("3 tier bracket 600mm ("), F.col("p_brand"), F.lit(")")),
        F.lit("Double socket IP44"),
        F.lit("Box lid"),
        F.lit("Fire rated junction box (HENSEL)"),
    ]
    out = F.when(F.lit(False), F.lit(""))
    for i, x in enumerate(lines):
        out = out.when(F.col("p_partkey") % 10 == i, x)
    return out


def described(t: Tables):
    """Parts as lines: p_partkey, p_brand, text, its attributes and label, read once and stored."""
    lines = line_attributes(t("part").select("p_partkey", "p_brand", description().alias("text")), "text")
    return stored(with_card_label(lines, "text"))


LABEL = """CASE k WHEN 0 THEN 'Tray tee' WHEN 1 THEN 'Ladder straight · ' || w || ' mm (EXT)' WHEN 2 THEN 'Cable ' || c || '×2.5 mm²' WHEN 3 THEN 'Flex 5×6 mm²' WHEN 4 THEN 'Isolator ' || a || ' A 3PH'
    WHEN 5 THEN 'Luminaire C' || (s % 3 + 1) WHEN 6 THEN 'Bracket 600 mm · 3 tier' WHEN 7 THEN 'Socket double' WHEN 8 THEN 'Box lid' ELSE 'Fire-rated JB' END"""
LINES = f"""p AS (SELECT p_partkey, p_brand, p_size AS s, p_partkey % 10 AS k, 100 + 50 * (p_size % 5) AS w, p_size % 4 + 2 AS c, CASE p_size % 3 WHEN 0 THEN 16 WHEN 1 THEN 32 ELSE 63 END AS a FROM part),
d AS (SELECT p_partkey, p_brand, k, {LABEL} AS label, CASE k WHEN 0 THEN w WHEN 1 THEN w WHEN 2 THEN c WHEN 4 THEN a ELSE 0 END AS param, 'C' || (s % 3 + 1) AS code FROM p)"""


@query(f"""WITH {LINES} SELECT p.p_partkey, CASE p.k WHEN 0 THEN 'tee' WHEN 1 THEN 'straight' WHEN 6 THEN 'tier_bracket' END AS component, CASE p.k WHEN 0 THEN 'tray' WHEN 1 THEN 'ladder' WHEN 2 THEN 'cable' WHEN 3 THEN 'cable' WHEN 4 THEN 'isolator' WHEN 5 THEN 'luminaire' WHEN 7 THEN 'socket' WHEN 9 THEN 'junction_box' END AS product,
    CASE WHEN p.k < 2 THEN w WHEN p.k = 6 THEN 600 END AS width_mm, CASE p.k WHEN 0 THEN 60 END AS height_mm, CASE p.k WHEN 6 THEN 3 END AS tiers, CASE p.k WHEN 2 THEN c WHEN 3 THEN 5 END AS cores, CASE p.k WHEN 2 THEN 2.5::DOUBLE WHEN 3 THEN 6.0::DOUBLE END AS mm2,
    CASE p.k WHEN 4 THEN a END AS amps, CASE p.k WHEN 4 THEN 3 END AS phases, CASE p.k WHEN 7 THEN 44 END AS ip, CASE p.k WHEN 9 THEN true END AS fire_rated, CASE p.k WHEN 1 THEN 'EXT' END AS finish, CASE p.k WHEN 5 THEN code END AS type_code,
    CASE p.k WHEN 5 THEN 'ZUMTOBEL downlight' WHEN 6 THEN p.p_brand WHEN 9 THEN 'HENSEL' END AS brand_text, label FROM p JOIN d USING (p_partkey)""")
def boq_lines(t: Tables):
    """What lines are made of, and the rate-card item that each belongs to."""
    names = ("component", "product", "width_mm", "height_mm", "tiers", "cores", "mm2", "amps", "phases", "ip", "fire_rated", "finish", "type_code", "brand_text")
    return described(t).select("p_partkey", *(f"line.{n}" for n in names), "label")


REFS = """r AS (SELECT d.*, l_suppkey AS file_id, l_quantity AS rate, l_orderkey AS sheet, l_linenumber AS row_no FROM lineitem JOIN d ON l_partkey = p_partkey WHERE p_partkey % 4 <> 1)"""
SPECIFIC = "k IN (0, 1, 2, 3, 4, 6)"


def references(t: Tables, lines):
    """Reference rows with their line: those of parts that don't ask themselves."""
    return t("lineitem").join(lines.where("p_partkey % 4 <> 1"), F.col("l_partkey") == F.col("p_partkey")).select("line", "label", F.col("l_suppkey").alias("file_id"), F.col("l_quantity").alias("rate"), F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row_no"))


def is_specific(line):
    """Whether a key says enough to stand for one item."""
    named = line["component"].isNotNull() | line["product"].isNotNull()
    return named & (line["width_mm"].isNotNull() | line["tiers"].isNotNull() | line["mm2"].isNotNull() | line["amps"].isNotNull())


@query(f"""WITH {LINES}, {REFS}, m AS (SELECT k, param, CASE WHEN k = 6 THEN p_brand END AS brand, file_id, rate, count(*) AS n, min((sheet, row_no)) AS seen FROM r WHERE {SPECIFIC} GROUP BY ALL),
i AS (SELECT k, param, file_id, rate FROM (SELECT *, row_number() OVER (PARTITION BY k, param, file_id ORDER BY n DESC, seen) AS o FROM (SELECT k, param, file_id, rate, sum(n) AS n, min(seen) AS seen FROM m GROUP BY ALL)) WHERE o = 1),
s AS (SELECT k, param, brand, file_id, rate FROM (SELECT *, row_number() OVER (PARTITION BY k, param, brand, file_id ORDER BY n DESC, seen) AS o FROM m) WHERE o = 1),
want AS (SELECT DISTINCT k, param, CASE WHEN k = 6 THEN p_brand END AS brand FROM d WHERE p_partkey % 4 = 1 AND {SPECIFIC}),
qi AS (SELECT k, param, arg_min(rate, file_id) AS install, min(file_id) AS install_file FROM i GROUP BY 1, 2),
qs AS (SELECT w.k, w.param, w.brand, arg_min(rate, (w.brand IS DISTINCT FROM s.brand, file_id)) AS supply, arg_min(file_id, (w.brand IS DISTINCT FROM s.brand, file_id)) AS supply_file FROM want w JOIN s ON s.k = w.k AND s.param = w.param AND (w.brand IS NOT DISTINCT FROM s.brand OR NOT EXISTS (SELECT 1 FROM s x WHERE x.k = w.k AND x.param = w.param AND x.brand IS NOT DISTINCT FROM w.brand)) GROUP BY 1, 2, 3)
SELECT d.p_partkey, install, install_file, supply, supply_file FROM d JOIN qi USING (k, param) JOIN qs ON qs.k = d.k AND qs.param = d.param AND qs.brand IS NOT DISTINCT FROM CASE WHEN d.k = 6 THEN d.p_brand END WHERE d.p_partkey % 4 = 1""")
def install_key_quotes(t: Tables):
    """Rates of lines with the same eleven attributes (null equals null): the first file's most common one; supply prefers the same brand.

    References are reduced to a rate for each key, brand and file before any line asks.
    """
    lines = described(t)
    keyed = references(t, lines).where(is_specific(F.col("line"))).select(*install_key(F.col("line")), F.lower("line.brand_text").alias("brand"), "file_id", "rate", "sheet", "row_no")
    by_file = mode_first_seen(keyed, [*INSTALL_KEY, "file_id"], "rate", ["sheet", "row_no"])
    install = by_file.groupBy(*INSTALL_KEY).agg(F.min(F.struct("file_id", "rate")).alias("install"))
    by_brand = mode_first_seen(keyed, [*INSTALL_KEY, "brand", "file_id"], "rate", ["sheet", "row_no"]).groupBy(*INSTALL_KEY, "brand").agg(F.min(F.struct("file_id", "rate")).alias("supply"))
    asked = lines.where("p_partkey % 4 = 1").where(is_specific(F.col("line"))).select("p_partkey", *install_key(F.col("line")), F.lower("line.brand_text").alias("brand"))
    wanted = asked.select(*INSTALL_KEY, "brand").distinct()
    same = lambda a, b, names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    other = F.coalesce(F.col("w.brand") != F.col("s.brand"), F.col("w.brand").isNotNull())
    supply = wanted.alias("w").join(by_brand.alias("s"), same("w", "s", INSTALL_KEY)).groupBy(*(F.col(f"w.{n}").alias(n) for n in (*INSTALL_KEY, "brand"))).agg(F.min_by("supply", F.struct(other.alias("other"), "supply")).alias("supply"))
    out = asked.alias("w").join(install.alias("i"), same("w", "i", INSTALL_KEY)).join(supply.alias("s"), same("w", "s", (*INSTALL_KEY, "brand")))
    return out.select("p_partkey", F.col("install.rate").alias("install"), F.col("install.file_id").alias("install_file"), F.col("supply.rate").alias("supply"), F.col("supply.file_id").alias("supply_file"))


@query(f"""WITH {LINES}, {REFS}, m AS (SELECT label, file_id, rate FROM (SELECT *, row_number() OVER (PARTITION BY label, file_id ORDER BY n DESC, seen) AS o FROM (SELECT label, file_id, rate, count(*) AS n, min((sheet, row_no)) AS seen FROM r WHERE k <> 5 GROUP BY 1, 2, 3)) WHERE o = 1),
q AS (SELECT label, arg_min(rate, file_id) AS rate, min(file_id) AS file_id, CASE WHEN count(DISTINCT rate) = 1 THEN 'high' ELSE 'medium' END AS confidence, count(*) AS alternatives FROM m GROUP BY label)
SELECT p_partkey, q.* FROM d JOIN q USING (label) WHERE p_partkey % 4 = 1""")
def rate_card_quotes(t: Tables):
    """Rates of the same rate-card item; sure if all files agree. Fittings and labels without a rating don't take part."""
    lines, label = described(t), F.col("label")
    usable = ~(label.startswith("Luminaire ") & F.col("line.type_code").isNotNull()) & (label != "Luminaire / fitting") & ~label.rlike(r"^(Connection|Isolator) \?")
    rows = references(t, lines).where(usable)
    modes = mode_first_seen(rows, ["label", "file_id"], "rate", ["sheet", "row_no"])
    first = F.min(F.struct("file_id", "rate"))
    q = modes.groupBy("label").agg(first.alias("z"), F.count_distinct("rate").alias("rates"), F.count(F.lit(1)).alias("alternatives"))
    asked = lines.where("p_partkey % 4 = 1").where(usable).select("p_partkey", "label")
    return asked.join(q, "label").select("p_partkey", "label", F.col("z.rate").alias("rate"), F.col("z.file_id").alias("file_id"), F.when(F.col("rates") == 1, "high").otherwise("medium").alias("confidence"), "alternatives")


@query(f"""WITH {LINES}, {REFS}, f AS (SELECT r.*, s_nationkey % 5 AS client FROM r JOIN supplier ON s_suppkey = file_id WHERE k = 5),
same AS (SELECT code, client, arg_min(rate, (file_id, sheet, row_no)) AS rate FROM f GROUP BY 1, 2), typical AS (SELECT arg_min(rate, (file_id, sheet, row_no)) AS rate FROM f),
want AS (SELECT p_partkey, code, p_partkey % 7 AS client FROM d WHERE p_partkey % 4 = 1 AND k = 5)
SELECT p_partkey, coalesce(same.rate, typical.rate) AS rate, CASE WHEN same.rate IS NOT NULL THEN 'exact' ELSE 'item' END AS method, same.rate IS NULL AS needs_check FROM want LEFT JOIN same USING (code, client), typical""")
def luminaire_quotes(t: Tables):
    """Fittings: the same type code for the same end client, else a typical fitting's rate, to be checked."""
    clients = t("supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("client"))
    lines = described(t)
    rows = references(t, lines).where("line.product = 'luminaire'").join(clients, F.col("s_suppkey") == F.col("file_id")).select(F.col("line.type_code").alias("code"), "client", "file_id", "sheet", "row_no", "rate")
    first = F.min(F.struct("file_id", "sheet", "row_no", "rate"))
    same = rows.groupBy("code", "client").agg(first.alias("same"))
    typical = same.agg(F.min("same").alias("typical"))  # one row
    asked = lines.where("p_partkey % 4 = 1 AND line.product = 'luminaire'").select("p_partkey", F.col("line.type_code").alias("code"), (F.col("p_partkey") % 7).alias("client"))
    out = asked.join(same, ["code", "client"], "left").crossJoin(F.broadcast(typical))
    return out.select("p_partkey", F.coalesce("same.rate", "typical.rate").alias("rate"), F.when(F.col("same").isNotNull(), "exact").otherwise("item").alias("method"), F.col("same").isNull().alias("needs_check"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 1 THEN 'supply_only' WHEN 2 THEN 'install_only' WHEN 3 THEN 'supply_and_install' END AS basis, l_suppkey % 3 <> 0 AS has_supply, l_partkey % 11 = 0 AS given, CASE WHEN l_tax > 0 THEN l_tax * 100 END AS install, CASE WHEN l_discount > 0 AND l_partkey % 13 <> 0 THEN l_discount * 100 END AS supply FROM lineitem),
w AS (SELECT *, basis IS DISTINCT FROM 'supply_only' AS want_install, NOT (given OR basis IS NOT DISTINCT FROM 'install_only') AND (has_supply OR basis IS NOT DISTINCT FROM 'supply_only') AND NOT (supply IS NULL AND install IS NOT NULL AND basis IS NULL) AS want_supply FROM x),
v AS (SELECT *, CASE WHEN want_install THEN install END AS i, CASE WHEN want_supply THEN supply END AS s FROM w)
SELECT l_orderkey, l_linenumber, l_partkey, want_install, want_supply, round(i, 6) AS install_rate, round(s, 6) AS supply_rate, CASE WHEN (want_install AND i IS NULL) OR (want_supply AND s IS NULL) THEN CASE WHEN i IS NULL AND s IS NULL THEN 'NO PRICE' ELSE 'CHECK' END END AS flag FROM v""")
def line_basis(t: Tables):
    """What a line asks for by its basis and sheet, and the flag of what no reference has; conflicting descriptions give no supply rate."""
    basis = F.expr("CASE l_linenumber % 4 WHEN 1 THEN 'supply_only' WHEN 2 THEN 'install_only' WHEN 3 THEN 'supply_and_install' END")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", basis.alias("basis"), (F.col("l_suppkey") % 3 != 0).alias("has_supply"), (F.col("l_partkey") % 11 == 0).alias("given"), F.when(F.col("l_tax") > 0, F.col("l_tax") * 100).alias("install"), F.when((F.col("l_discount") > 0) & (F.col("l_partkey") % 13 != 0), F.col("l_discount") * 100).alias("supply"))
    is_ = lambda x: F.col("basis").eqNullSafe(F.lit(x))
    # an item that the reference has without a supply rate is install-only there
    installed = F.col("supply").isNull() & F.col("install").isNotNull() & F.col("basis").isNull()
    rows = rows.withColumns({"want_install": ~is_("supply_only"), "want_supply": ~(F.col("given") | is_("install_only")) & (F.col("has_supply") | is_("supply_only")) & ~installed})
    rows = rows.withColumns({"i": F.when(F.col("want_install"), F.col("install")), "s": F.when(F.col("want_supply"), F.col("supply"))})
    missing = (F.col("want_install") & F.col("i").isNull()) | (F.col("want_supply") & F.col("s").isNull())
    flag = F.when(missing, F.when(F.col("i").isNull() & F.col("s").isNull(), "NO PRICE").otherwise("CHECK"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "want_install", "want_supply", F.round("i", 6).alias("install_rate"), F.round("s", 6).alias("supply_rate"), flag.alias("flag"))


@query("""SELECT l_suppkey, CASE WHEN l_returnflag = 'A' THEN 'emergency' WHEN l_linenumber % 3 = 0 THEN 'controls' WHEN l_linenumber % 3 = 1 THEN 'external' ELSE 'standard' END AS kind, count(*) AS n FROM lineitem GROUP BY ALL""")
def section_kind_counts(t: Tables):
    """Kinds of sections by words in their titles and sheet names."""
    section = F.when(F.col("l_returnflag") == "A", "Exit signs, controls").when(F.col("l_linenumber") % 3 == 0, "Lighting Controls")
    sheet = F.when(F.col("l_linenumber") % 3 == 1, "EXT works").otherwise("Next")
    return t("lineitem").groupBy("l_suppkey", section_kind(section, sheet).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_suppkey AS sheet, round(sum(CASE WHEN l_tax > 0.04 THEN l_extendedprice::DECIMAL(18,2) ELSE (coalesce(nullif(l_quantity, 7), 0) * 10)::DECIMAL(18,2) END)::DOUBLE, 2) AS total FROM lineitem GROUP BY 1""")
def stored_or_computed_totals(t: Tables):
    """Totals of sheets: a stored total counts, else quantity times unit price; a missing quantity is zero."""
    stored = F.when(F.col("l_tax") > 0.04, F.col("l_extendedprice"))
    product = F.coalesce(F.nullif("l_quantity", F.lit(7.0)), F.lit(0.0)) * 10
    return t("lineitem").groupBy(F.col("l_suppkey").alias("sheet")).agg(F.round(F.sum(F.coalesce(stored, product).cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@query("""WITH a AS (SELECT l_orderkey AS section, arg_min(l_quantity, (l_linenumber, l_partkey, l_extendedprice)) FILTER (WHERE l_quantity >= 20) AS anchor FROM lineitem GROUP BY 1),
q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 50 AS item, round(l_quantity / anchor, 4) AS ratio FROM lineitem JOIN a ON section = l_orderkey WHERE anchor IS NOT NULL AND l_quantity < 20),
ref AS (SELECT item, arg_min(ratio, (l_suppkey, l_orderkey, l_linenumber, l_partkey, ratio)) AS ref FROM q WHERE l_suppkey % 2 = 0 AND ratio > 0 GROUP BY item)
SELECT l_orderkey, l_linenumber, l_partkey, ratio, ref, coalesce(abs(ratio - ref) / ref > 0.05, false) AS deviates FROM q LEFT JOIN ref USING (item)""")
def accessory_deviations(t: Tables):
    """Ratios of accessories against the best-ranked reference's, marked beyond five per cent."""
    order, big = F.struct("l_linenumber", "l_partkey", "l_extendedprice"), F.col("l_quantity") >= 20
    lines = t("lineitem")
    anchors = lines.groupBy(F.col("l_orderkey").alias("section")).agg(F.min_by(F.when(big, F.col("l_quantity")), F.when(big, order)).alias("anchor")).where("anchor IS NOT NULL")
    q = lines.where("l_quantity < 20").join(anchors, F.col("section") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 50).alias("item"), F.round(F.col("l_quantity") / F.col("anchor"), 4).alias("ratio"))
    ref = q.where("l_suppkey % 2 = 0 AND ratio > 0").groupBy("item").agg(F.min_by("ratio", F.struct("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "ratio")).alias("ref"))
    off = F.coalesce(F.abs(F.col("ratio") - F.col("ref")) / F.col("ref") > 0.05, F.lit(False))
    return q.join(ref, "item", "left").select("l_orderkey", "l_linenumber", "l_partkey", "ratio", "ref", off.alias("deviates"))


@query("""SELECT l_suppkey AS file_id, l_linenumber AS sheet, sum(l_quantity) AS install, greatest(1, floor(sum(l_quantity) / (52.0 / 12) + 0.5))::BIGINT AS months, arg_max(l_quantity, (l_orderkey, l_partkey, l_extendedprice)) FILTER (WHERE l_returnflag = 'A') AS anchor_weeks FROM lineitem GROUP BY 1, 2""")
def sheet_programmes(t: Tables):
    """Install totals of sheets, their weeks as months of at least one, and the last manager's row as anchor."""
    manager = F.col("l_returnflag") == "A"
    anchor = F.max_by(F.when(manager, F.col("l_quantity")), F.when(manager, F.struct("l_orderkey", "l_partkey", "l_extendedprice")))
    g = t("lineitem").groupBy(F.col("l_suppkey").alias("file_id"), F.col("l_linenumber").alias("sheet")).agg(F.sum("l_quantity").alias("install"), anchor.alias("anchor_weeks"))
    return g.select("file_id", "sheet", "install", F.greatest(F.lit(1), F.floor(F.col("install") / (52.0 / 12) + 0.5)).cast("long").alias("months"), "anchor_weeks")


@query("""WITH c AS (SELECT l_orderkey AS sheet, l_linenumber AS row_no, (l_partkey % 12)::INTEGER AS col, min(l_returnflag) AS label, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3)
SELECT a.sheet, a.row_no, a.col, arg_min(b.value, b.col) AS value FROM c a LEFT JOIN c b ON b.sheet = a.sheet AND b.row_no = a.row_no AND b.col BETWEEN a.col + 1 AND a.col + 5 WHERE a.label = 'R' GROUP BY 1, 2, 3""")
def summary_neighbours(t: Tables):
    """The value beside each label of a summary: the nearest cell within five columns to the right."""
    c = t("lineitem").groupBy(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row_no"), (F.col("l_partkey") % 12).cast("int").alias("col")).agg(F.min("l_returnflag").alias("label"), F.max("l_quantity").alias("value"))
    w = Window.partitionBy("sheet", "row_no").orderBy("col")
    near = F.when(F.lead("col").over(w) <= F.col("col") + 5, F.lead("value").over(w))
    return c.withColumn("near", near).where("label = 'R'").select("sheet", "row_no", "col", F.col("near").alias("value"))


@query("""WITH c AS (SELECT l_suppkey AS sheet, l_orderkey, l_partkey, l_linenumber, l_extendedprice, (l_partkey % 12)::INTEGER AS col FROM lineitem), g AS (SELECT s_suppkey AS sheet, unnest([s_nationkey % 4, s_nationkey % 4 + 3, s_nationkey % 4 + 6]) AS col FROM supplier)
SELECT l_orderkey, l_linenumber, l_partkey, max(g.col) AS phase_col FROM c LEFT JOIN g ON g.sheet = c.sheet AND g.col <= c.col GROUP BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, c.sheet, c.col""")
def phase_columns(t: Tables):
    """The rightmost phase column at or before each cell's column: an as-of match within the sheet's few phases."""
    n = F.col("s_nationkey") % 4
    groups = t("supplier").select(F.col("s_suppkey").alias("sheet"), F.array(n, n + 3, n + 6).alias("cols"))
    cells = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("sheet"), (F.col("l_partkey") % 12).alias("col"))
    at = F.array_max(F.filter("cols", lambda x: x <= F.col("col")))
    return cells.join(groups, "sheet", "left").select("l_orderkey", "l_linenumber", "l_partkey", at.alias("phase_col"))
