"""Technical attributes of items, the filters over them, and the matches that rest on both."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rubicost.functions.attributes import attributes_agree, first_rule, leftmost_keyword, parse_attributes, web_attributes_match, with_attributes
from rubicost.functions.text import lexical_similarity, match_key, tokens
from rubicost.functions.units import normalise_unit, units_compatible, with_labels
from rubicost.operators.joins import lexical_join
from rubicost.operators.topk import first_of
from rubicost.registry import query
from rubicost.sources.files import stored
from rubicost.tables import Tables, with_views


def item_text():
    """Eight ways to describe an item, with numbers that follow its size."""
    s = F.col("p_size").cast("string")
    four = (F.col("p_size") % 4 + 1).cast("string")
    c = F.concat
    texts = [
        c(F.lit("Cable NYM-J "), four, F.lit("x2,5 mm²")),
        c(F.lit("Socket "), four, F.lit(" gang IP4"), four, F.lit(" 16A")),
        c(F.lit("Circuit breaker "), four, F.lit("P C16")),
        c(F.lit("Distribution board "), s, F.lit("M 400V")),
        c(F.lit("Conduit d2"), four),
        c(F.lit("Cable tray "), (F.col("p_size") + 100).cast("string"), F.lit(" x 60")),
        c(F.lit("RCD "), four, F.lit("P+N 40A 30mA")),
        c(F.lit("Data "), four, F.lit("×2×0,5 cat 6 UTP")),
    ]
    out = F.when(F.lit(False), F.lit(""))
    for i, x in enumerate(texts):
        out = out.when(F.col("p_partkey") % 8 == i, x)
    return out


@query("""WITH p AS (SELECT p_partkey, p_partkey % 8 AS k, p_size AS s, p_size % 4 + 1 AS f FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'cable' WHEN 1 THEN 'socket' WHEN 2 THEN 'breaker' WHEN 3 THEN 'distribution_board' WHEN 4 THEN 'conduit' WHEN 5 THEN 'cable_tray' WHEN 6 THEN 'rcd' ELSE 'cable' END AS category,
    CASE k WHEN 0 THEN f WHEN 7 THEN f * 2 END AS cores, CASE k WHEN 0 THEN 2.5::DOUBLE END AS cross_section_mm2, CASE k WHEN 7 THEN f END AS pairs, CASE k WHEN 0 THEN 'nymj' WHEN 7 THEN 'utp' END AS cable_type, CASE k WHEN 7 THEN '6' END AS data_cat,
    CASE k WHEN 5 THEN (s + 100) || 'x60' END AS size, CASE k WHEN 1 THEN '4' || f END AS ip, CASE k WHEN 3 THEN s END AS modules, CASE k WHEN 1 THEN f END AS gangs, CASE WHEN k = 2 THEN f WHEN k = 6 THEN CASE WHEN f < 4 THEN f ELSE 4 END END AS poles,
    CASE k WHEN 1 THEN 16.0::DOUBLE WHEN 2 THEN 16.0::DOUBLE WHEN 6 THEN 40.0::DOUBLE END AS amps, CASE k WHEN 2 THEN 'C' END AS curve, CASE k WHEN 6 THEN 30 END AS sensitivity_ma, CASE k WHEN 3 THEN 400 END AS volts, CASE k WHEN 4 THEN 20 + f END AS diameter_mm FROM p""")
def parsed_attributes(t: Tables):
    """Attributes of texts that state them in eight ways."""
    a = parse_attributes(t("part").select("p_partkey", item_text().alias("text")), "text")
    names = ("category", "cores", "cross_section_mm2", "pairs", "cable_type", "data_cat", "size", "ip", "modules", "gangs", "poles", "amps", "curve", "sensitivity_ma", "volts", "diameter_mm")
    return a.select("p_partkey", *(f"attrs.{n}" for n in names))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 'tool' WHEN p_name LIKE '% bolt' OR p_name LIKE '% ring' THEN 'fixing' WHEN p_name LIKE 'red %' OR p_name LIKE 'blue %' THEN 'coloured' END AS category FROM part""")
def detected_categories(t: Tables):
    """Category by the keyword that begins first; of those at one place the longest counts."""
    keywords = {"fixing": ("bolt", "ring"), "coloured": ("red paint", "blue paint"), "tool": ("boltcutter", "cutter")}
    n = F.col("p_partkey") % 3
    dyed = F.col("p_name").rlike("^(red|blue) ") & ~F.col("p_name").rlike(" (bolt|ring)$")
    text = F.when(n == 1, F.concat(F.lit("Boltcutter, "), "p_name")).when(dyed, F.concat("p_name", F.lit(": "), F.split("p_name", " ")[0], F.lit(" paint"))).otherwise(F.col("p_name"))
    return t("part").select("p_partkey", leftmost_keyword(F.lower(text), keywords).alias("category"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_size % 2 = 0 AS even FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN even WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true ELSE even END AS hard, CASE k WHEN 0 THEN even WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false ELSE even END AS strict FROM p""")
def attribute_filters(t: Tables):
    """The hard filter and the strict one of web prices, over pairs of texts that differ in one respect."""
    n, even = F.col("p_partkey") % 6, F.col("p_size") % 2 == 0
    pairs = [
        ("Cable 3x1.5", F.when(even, "cable 3 x 1,5 mm2").otherwise("cable 5x1.5")),
        ("Socket 16A IP44", F.lit("Socket 16A")),
        ("Socket 16A", F.lit("Socket 16A IP44 230V")),
        ("Conduit d25", F.lit("Cable tray 300x60")),
        ("Circuit breaker 3P", F.lit("Circuit breaker 3P 400V")),
        ("Something 16A", F.when(even, "Socket 16A").otherwise("Socket 32A")),
    ]
    pick = lambda i: F.coalesce(*(F.when(n == k, F.lit(p[0]) if i == 0 else p[1]) for k, p in enumerate(pairs)))
    rows = t("part").select("p_partkey", pick(0).alias("row"), pick(1).alias("product"))
    # each pair of texts is compared once
    both = with_attributes(with_attributes(rows.select("row", "product").distinct(), "row", "a"), "product", "b")
    said = both.select(F.col("row").alias("_row"), F.col("product").alias("_product"), attributes_agree(F.col("a"), F.col("b")).alias("hard"), web_attributes_match(F.col("a"), F.col("b")).alias("strict"))
    return rows.join(stored(said), F.col("row").eqNullSafe(F.col("_row")) & F.col("product").eqNullSafe(F.col("_product"))).select("p_partkey", "hard", "strict")


KEYED = """refs AS (SELECT p_name AS key, p_size AS size, CASE l_linenumber % 3 WHEN 0 THEN 'pcs' WHEN 1 THEN 'set' ELSE 'm' END AS unit, l_suppkey AS file_id, l_orderkey AS sheet, l_linenumber AS row_no, l_returnflag = 'A' AS is_reference,
    CASE WHEN l_discount > 0 THEN l_extendedprice END AS material, CASE WHEN l_tax > 0 THEN l_tax * 100 END AS labour FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query(f"""WITH {KEYED}, want AS (SELECT p_partkey, p_name AS key, p_size AS size, CASE p_partkey % 4 WHEN 0 THEN 'pcs' WHEN 1 THEN 'set' WHEN 2 THEN 'm' END AS unit FROM part),
c AS (SELECT p_partkey, r.*, row_number() OVER (PARTITION BY p_partkey, file_id % 5 IN (1, 2) ORDER BY CASE WHEN file_id % 5 IN (1, 2) THEN NOT is_reference END, CASE WHEN file_id % 5 IN (1, 2) THEN labour IS NULL END, file_id, sheet, row_no, material) AS k FROM want w JOIN refs r ON r.key = w.key AND r.size = w.size
    WHERE file_id % 5 <> 4 AND (material IS NOT NULL OR labour IS NOT NULL) AND (w.unit IS NULL OR w.unit = r.unit OR (w.unit IN ('pcs', 'set') AND r.unit IN ('pcs', 'set')))),
f AS (SELECT p_partkey, max(CASE WHEN file_id % 5 IN (1, 2) THEN file_id END) AS mine, max(CASE WHEN file_id % 5 IN (0, 3) THEN file_id END) AS other FROM c WHERE k = 1 GROUP BY p_partkey)
SELECT p_partkey, CASE WHEN mine IS NOT NULL THEN 'exact' WHEN other IS NOT NULL THEN 'blocked' ELSE 'none' END AS source, coalesce(mine, other) AS file_id FROM (SELECT p_partkey, mine, other FROM part LEFT JOIN f USING (p_partkey))""")
def exact_by_key(t: Tables):
    """The exact stage: same match key, compatible attributes and unit, a price; references and rows with labour first.

    Reference rows are reduced to the best of each text, unit and permission
    state, and request rows to their different texts and units, before they meet
    on the key; texts are parsed once each.
    """
    size = F.col("p_size").cast("string")
    parts = t("part").select("p_partkey", "p_name", F.concat(F.upper("p_name"), F.lit(" ABB, 3 × "), size, F.lit(" mm²")).alias("want_text"), F.concat("p_name", F.lit("; 3x"), size, F.lit(" mm2")).alias("ref_text"))
    lines = t("lineitem").select(
        "l_partkey",
        normalise_unit(F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'Gab.' WHEN 1 THEN 'kompl.' ELSE 'metres' END"), aliases=with_labels(pcs=("gab",), set=("kompl",))).alias("r_unit"),
        F.col("l_suppkey").alias("file_id"),
        F.struct(
            F.when(F.col("l_suppkey") % 5 >= 3, False).when(F.col("l_suppkey") % 5 == 0, False).otherwise(F.col("l_returnflag") != "A").alias("a"),
            F.when(F.col("l_suppkey") % 5 >= 3, False).when(F.col("l_suppkey") % 5 == 0, False).otherwise(~(F.col("l_tax") > 0)).alias("b"),
            F.col("l_suppkey").alias("c"), F.col("l_orderkey").alias("d"), F.col("l_linenumber").alias("e"),
        ).alias("rank"),
    ).where((F.col("l_discount") > 0) | (F.col("l_tax") > 0)).where("file_id % 5 <> 4")
    state = F.when((F.col("file_id") % 5).isin(1, 2), "allowed").otherwise("other")
    rows = lines.join(parts.select("p_partkey", "ref_text"), F.col("l_partkey") == F.col("p_partkey")).groupBy("ref_text", "r_unit", state.alias("state")).agg(F.min("rank").alias("rank"))
    keys = lambda df, text: df.select(text).distinct().withColumn("key", match_key(F.col(text), ("abb",)))
    refs = stored(with_attributes(rows, "ref_text", "r_attrs").join(keys(rows, "ref_text"), "ref_text"))
    unit = normalise_unit(F.expr("CASE p_partkey % 4 WHEN 0 THEN 'pcs' WHEN 1 THEN 'set' WHEN 2 THEN 'm' END"))
    asked = parts.select("p_partkey", "want_text", unit.alias("w_unit"))
    different = asked.select("want_text", "w_unit").distinct()
    want = stored(with_attributes(different, "want_text", "w_attrs").join(keys(different, "want_text"), "want_text"))
    fits = units_compatible(F.col("w_unit"), F.col("r_unit")) & attributes_agree(F.col("w_attrs"), F.col("r_attrs"))
    best = want.join(refs, "key").where(fits).groupBy("want_text", F.col("w_unit").alias("_unit")).agg(*(F.min(F.when(F.col("state") == s, F.col("rank"))).alias(s) for s in ("allowed", "other")))
    source = F.when(F.col("allowed").isNotNull(), "exact").when(F.col("other").isNotNull(), "blocked").otherwise("none")
    found = asked.join(best.withColumnRenamed("want_text", "_text"), F.col("want_text").eqNullSafe(F.col("_text")) & F.col("w_unit").eqNullSafe(F.col("_unit")), "left")
    return found.select("p_partkey", source.alias("source"), F.coalesce("allowed.c", "other.c").alias("file_id"))


#: An item tier needs this similarity; from ``SURE`` on it is surer.
NEAR, SURE = 0.6, 0.8
WEIGHTED = "list_sum(list_transform({x}, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END))"


def weighed(a: str, b: str) -> str:
    return f"coalesce(2 * {WEIGHTED.format(x=f'list_intersect({a}, {b})')} / ({WEIGHTED.format(x=a)} + {WEIGHTED.format(x=b)}), 0)"


@query(f"""WITH w AS (SELECT p_partkey, p_type AS category, p_size AS size, string_split(p_name || ' ' || p_size || ' ' || lower(p_brand), ' ') AS ws FROM part),
n AS (SELECT p_partkey AS norm_id, p_type AS category, p_size AS size, p_partkey % 3 AS level, string_split(p_name || ' ' || p_size, ' ') AS ns, round(p_retailprice / 1000, 6) AS hours FROM part WHERE p_partkey % 5 = 2),
t1 AS (SELECT p_partkey, 1 AS tier, 85 AS pct, min(norm_id) AS norm_id FROM w JOIN n ON level = 0 AND n.category = w.category AND n.size = w.size GROUP BY 1),
t2 AS (SELECT p_partkey, 2 AS tier, CASE WHEN max(s) >= {SURE} THEN 72 ELSE 64 END AS pct, arg_min(norm_id, (-s, norm_id)) AS norm_id FROM (SELECT p_partkey, norm_id, round({weighed('ws', 'ns')}, 9) AS s FROM w JOIN n ON level = 1 AND n.category = w.category) WHERE s >= {NEAR} GROUP BY 1),
t3 AS (SELECT p_partkey, 3 AS tier, 55 AS pct, min(norm_id) AS norm_id FROM w JOIN n ON level = 2 AND n.category = w.category GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY tier) AS k FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3))
SELECT p_partkey, tier, pct, norm_id FROM r WHERE k = 1""")
def norm_tiers(t: Tables):
    """Norms in three tiers: equal parameters, similar items, the category; the first tier with one counts."""
    part = t("part").select("p_partkey", F.col("p_type").alias("category"), F.col("p_size").alias("size"), "p_name", "p_brand")
    norms = part.where("p_partkey % 5 = 2").withColumnRenamed("p_partkey", "norm_id").withColumn("level", F.col("norm_id") % 3)
    one = norms.where("level = 0").groupBy("category", "size").agg(F.min("norm_id").alias("one"))
    three = norms.where("level = 2").groupBy("category").agg(F.min("norm_id").alias("three"))
    size = F.col("size").cast("string")
    # rows that are equal but for their key ask once
    alike = ["category", "size", "p_name", "p_brand"]
    named = part.select(*alike).distinct().withColumn("w_text", F.concat_ws(" ", "p_name", size, F.lower("p_brand")))
    left = named.select("w_text", "category").distinct().select(F.concat_ws("\x1f", "w_text", "category").alias("k"), "category", F.array_distinct(F.split("w_text", " ")).alias("toks"))
    items = norms.where("level = 1").groupBy(F.concat_ws(" ", "p_name", size).alias("n_text"), "category").agg(F.min("norm_id").alias("two"))
    right = items.select(F.concat_ws("\x1f", "n_text", "category").alias("n_k"), "category", F.array_distinct(F.split("n_text", " ")).alias("toks"), "two")
    near = lexical_join(left, right.drop("two"), "k", "n_k", on=["category"], least=NEAR).withColumn("s", F.round("similarity", 9)).where(F.col("s") >= NEAR)
    near = first_of(near.join(right.select(F.col("n_k").alias("r_key"), "two"), "r_key"), ["l_key"], F.desc("s"), F.col("two"))
    rows = named.withColumn("l_key", F.concat_ws("\x1f", "w_text", "category")).join(near.select("l_key", "two", "s"), "l_key", "left").join(one, ["category", "size"], "left").join(three, "category", "left")
    tier = F.when(F.col("one").isNotNull(), 1).when(F.col("two").isNotNull(), 2).when(F.col("three").isNotNull(), 3)
    pct = F.when(tier == 1, 85).when(tier == 2, F.when(F.col("s") >= SURE, 72).otherwise(64)).otherwise(55)
    told = stored(rows.where(tier.isNotNull()).select(*[F.col(c).alias(f"_{c}") for c in alike], tier.alias("tier"), pct.alias("pct"), F.coalesce("one", "two", "three").alias("norm_id")))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alike]
    return part.join(told, same).select("p_partkey", "tier", "pct", "norm_id")


ASKED = "('red bolt 7'), ('old ring 12 large'), ('gear'), ('hot plate 3'), ('nothing alike')"


@query(f"""{with_views("items")}, q AS (SELECT q, string_split(q, ' ') AS qs FROM (VALUES {ASKED}) v(q)), i AS (SELECT text || ' ' || size AS item, min(file_id) FILTER (WHERE file_id % 5 IN (1, 2)) AS mine, min(file_id) FILTER (WHERE file_id % 5 IN (0, 3)) AS other FROM items GROUP BY 1),
s AS (SELECT q, item, mine, other, round({weighed('qs', "string_split(item, ' ')")}, 9) AS s FROM q, i), h AS (SELECT * FROM s WHERE s > 0.3),
a AS (SELECT q, item, s, mine AS file_id, row_number() OVER (PARTITION BY q ORDER BY s DESC, item) AS rank FROM h WHERE mine IS NOT NULL), b AS (SELECT q, max(s) AS s FROM a GROUP BY q),
o AS (SELECT q, item, s, other AS file_id, row_number() OVER (PARTITION BY q ORDER BY s DESC, item) AS rank FROM h WHERE other IS NOT NULL)
SELECT q, item, s AS similarity, file_id, rank::INTEGER AS rank, true AS allowed FROM a WHERE rank <= 8 UNION ALL SELECT o.q, item, o.s, file_id, 1, false FROM o LEFT JOIN b ON b.q = o.q WHERE o.rank = 1 AND (b.s IS NULL OR o.s > b.s + 0.05)""")
def search_items(t: Tables):
    """For each question the eight most similar allowed items, and the best of an unselected file if it is better by a margin."""
    asked = t.rows([(x,) for x in ("red bolt 7", "old ring 12 large", "gear", "hot plate 3", "nothing alike")], "q string").withColumn("toks", F.split("q", " "))
    k = F.col("file_id") % 5
    named = F.concat_ws(" ", "text", F.col("size").cast("string"))
    items = t.items().groupBy(named.alias("item")).agg(F.min(F.when(k.isin(1, 2), F.col("file_id"))).alias("mine"), F.min(F.when(k.isin(0, 3), F.col("file_id"))).alias("other")).withColumn("toks", F.array_distinct(F.split("item", " ")))
    hits = lexical_join(asked, items, "q", "item", least=0.3).withColumn("s", F.round("similarity", 9)).where("s > 0.3").select(F.col("l_key").alias("q"), F.col("r_key").alias("item"), "s").join(items.select("item", "mine", "other"), "item")
    best = lambda c, n: first_of(hits.where(F.col(c).isNotNull()), ["q"], F.desc("s"), F.col("item"), rank="rank", n=n).select("q", "item", F.col("s").alias("similarity"), F.col(c).alias("file_id"), "rank")
    mine, other = best("mine", 8), best("other", 1)
    top = mine.where("rank = 1").select("q", F.col("similarity").alias("top"))
    better = other.join(top, "q", "left").where(F.col("top").isNull() | (F.col("similarity") > F.col("top") + 0.05)).drop("top")
    return mine.withColumn("allowed", F.lit(True)).unionByName(better.withColumn("allowed", F.lit(False)))


@query(f"""WITH i AS (SELECT p_partkey, p_name || ' ' || p_size AS text FROM part WHERE p_partkey % 9 = 4), r AS (SELECT DISTINCT p_name AS row_text, p_type AS section FROM part WHERE p_partkey % 9 <> 4),
s AS (SELECT text, section, max(round({weighed("string_split(text, ' ')", "string_split(row_text, ' ')")}, 9)) AS s FROM (SELECT DISTINCT text FROM i), r GROUP BY 1, 2), b AS (SELECT text, arg_min(section, (-s, section)) AS section, max(s) AS s FROM s GROUP BY text)
SELECT p_partkey, CASE WHEN s >= 0.35 THEN section ELSE 'Other works' END AS section FROM i JOIN b ON b.text = i.text""")
def section_assignment(t: Tables):
    """Each item goes to the template section with the most similar row, from 0.35 on, else to the other works."""
    part = t("part")
    items = part.where("p_partkey % 9 = 4").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("text"))
    rows = part.where("p_partkey % 9 <> 4").select(F.col("p_name").alias("row_text"), F.col("p_type").alias("section")).distinct()
    a = items.select("text").distinct().withColumn("toks", F.array_distinct(F.split("text", " ")))
    b = rows.select("row_text").distinct().withColumn("toks", F.array_distinct(F.split("row_text", " ")))
    near = lexical_join(a, b, "text", "row_text", least=0.35).withColumn("s", F.round("similarity", 9)).where("s >= 0.35")
    best = first_of(near.join(rows, F.col("r_key") == F.col("row_text")), ["l_key"], F.desc("s"), F.col("section")).select(F.col("l_key").alias("text"), "section")
    return items.join(best, "text", "left").select("p_partkey", F.coalesce("section", F.lit("Other works")).alias("section"))


#: An ordered set of header rules; real ones hold words of many languages and are a parameter.
HEADER_RULES = [
    ("no", r"^(nr|no|pos|ref|#)$"),
    ("hourly_rate", r"(hourly rate|rate per hour|timepris)"),
    ("hours", r"(\bhours?\b|\btimer\b|norm)"),
    ("item", r"(description|\bitem\b|\btekst\b)"),
    ("unit", r"^(unit|enhed|uom)$"),
    ("qty", r"(quantity|\bqty\b|\bantal\b)"),
    ("labour", r"(labou?r|\bwork\b)"),
    ("material", r"\bmaterials?\b"),
    ("price", r"(\bprice\b|\bpris\b)"),
    ("total", r"(\btotal\b|\bsum\b|amount)"),
]
TOTAL_WORDS, UNIT_WORDS = r"(\btotal\b|i alt|\bsum\b|amount)", r"(per unit|unit price|\beach\b|\bpr\b|\bper\b)"
GENERIC = ("labour", "material", "price", "total")


def classify_header(text, rules: list[tuple[str, str]] = HEADER_RULES, generic: tuple[str, ...] = GENERIC):
    """Meaning of a header cell by the first rule that holds, and whether a generic one is of a unit or a total."""
    meaning = first_rule(text, rules)
    # the generic word itself is no qualifier
    rest = F.when(meaning == "total", F.regexp_replace(F.regexp_replace(text, "^(.*?)" + TOTAL_WORDS, "$1 "), " +", " ")).otherwise(text)
    return meaning, F.when(meaning.isin(*generic), F.when(rest.rlike(TOTAL_WORDS), "total").when(text.rlike(UNIT_WORDS), "unit"))


HEADERS = ["No", "Description", "Unit", "Qty", "Hours per unit", "Hourly rate", "Labour per unit", "Materials, total", "Unit price", "Total", "Colour"]


@query("""WITH h AS (SELECT * FROM (VALUES (0, 'no', NULL), (1, 'item', NULL), (2, 'unit', NULL), (3, 'qty', NULL), (4, 'hours', NULL), (5, 'hourly_rate', NULL), (6, 'labour', 'unit'), (7, 'material', 'total'), (8, 'price', 'unit'), (9, 'total', NULL), (10, NULL, NULL)) v(k, meaning, qualifier))
SELECT p_partkey, meaning, qualifier FROM part JOIN h ON k = p_partkey % 11""")
def header_meanings(t: Tables):
    """Meaning and qualifier of header cells."""
    text = F.lower(F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("p_partkey") % 11 + 1).cast("int")))
    meaning, qualifier = classify_header(F.regexp_replace(text, ",", ""))
    return t("part").select("p_partkey", meaning.alias("meaning"), qualifier.alias("qualifier"))


@query("""WITH h AS (SELECT l_suppkey AS sheet, l_orderkey % 97 AS row_no, l_partkey % 11 AS col FROM lineitem WHERE l_orderkey % 97 < 40),
m AS (SELECT sheet, row_no, count(DISTINCT CASE WHEN col < 10 THEN col END) AS score FROM h GROUP BY 1, 2),
p AS (SELECT *, score + coalesce(CASE WHEN lead(row_no) OVER w = row_no + 1 THEN lead(score) OVER w END, 0) / 2.0 AS two FROM m WINDOW w AS (PARTITION BY sheet ORDER BY row_no))
SELECT sheet, arg_min(row_no, (-greatest(score, two), row_no)) AS header_row, max(greatest(score, two))::DOUBLE AS score FROM p GROUP BY sheet""")
def header_rows(t: Tables):
    """Header row of each sheet among its first forty: most different meanings, alone or with half of the next row's."""
    text = F.lower(F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("l_partkey") % 11 + 1).cast("int")))
    meaning, _ = classify_header(F.regexp_replace(text, ",", ""))
    cells = t("lineitem").select(F.col("l_suppkey").alias("sheet"), (F.col("l_orderkey") % 97).alias("row_no"), meaning.alias("meaning")).where("row_no < 40")
    m = cells.groupBy("sheet", "row_no").agg(F.count_distinct("meaning").alias("score"))
    w = Window.partitionBy("sheet").orderBy("row_no")
    below = F.when(F.lead("row_no").over(w) == F.col("row_no") + 1, F.lead("score").over(w))
    best = m.withColumn("s", F.greatest(F.col("score").cast("double"), F.col("score") + F.coalesce(below, F.lit(0)) / 2))
    return best.groupBy("sheet").agg(F.min_by("row_no", F.struct(-F.col("s"), "row_no")).alias("header_row"), F.max("s").alias("score"))


# Fixed patterns: lines of a work list.
QUANTITY = r"(\d+(?:[.,]\d+)?)\s*(m2|m²|m3|m|gab\.?|gb|pcs?|stk\.?|kompl\.?|kpl|set|sets|ea|each|obj\.?|lot|kg|l)\b\.?"
TRAILING, LEADING, BULLET = rf"(?i)^(.+?)[\s,;:–—-]+{QUANTITY}\s*$", rf"(?i)^{QUANTITY}\s*[x×]?\s+(.+)$", r"^\s*(?:\d+[.)]|[-•*])\s*"
REQUEST = r"(?i)\b(sagatavo|izveido|uztaisi|generate|create|make|build|prepare|price|estimate|budget|tilbud|overslag|please)\w*"


def work_list(df, keys: list[str], order: list[str], line: str):
    """Items of work lists: text, quantity, unit, and the section of the heading above.

    A line that ends with a colon is a heading, unless it is the request itself.
    """
    x = F.trim(F.regexp_replace(line, BULLET, ""))
    df = df.withColumn("_l", x).where(F.col("_l") != "")
    heading = F.col("_l").endswith(":") & (F.length("_l") < 80)
    title = F.when(heading & ~F.col("_l").rlike(REQUEST), F.trim(F.regexp_replace("_l", ":$", "")))
    df = df.withColumns({"_h": heading, "section": F.last(title, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))}).where("NOT _h")
    tail, lead = F.col("_l").rlike(TRAILING), F.col("_l").rlike(LEADING)
    pick = lambda a, b: F.when(tail, F.regexp_extract("_l", TRAILING, a)).when(lead, F.regexp_extract("_l", LEADING, b))
    text = F.when(tail | lead, F.btrim(pick(1, 3), F.lit(" -–—,;:"))).otherwise(F.col("_l"))
    return df.select(*keys, *order, text.alias("text"), F.translate(pick(2, 1), ",", ".").cast("double").alias("qty"), pick(3, 2).alias("unit"), "section")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity::INTEGER AS q, CASE WHEN l_returnflag = 'R' THEN 'Section ' || l_partkey END AS title FROM lineitem),
s AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS section FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, 'item ' || l_partkey AS text, CASE WHEN l_partkey % 3 < 2 THEN q::DOUBLE END AS qty, CASE l_partkey % 3 WHEN 0 THEN 'pcs' WHEN 1 THEN 'm' END AS unit, section FROM s WHERE title IS NULL""")
def work_list_items(t: Tables):
    """Lines of work lists with the quantity behind, in front or missing, below headings."""
    item, q = F.concat(F.lit("item "), F.col("l_partkey").cast("string")), F.col("l_quantity").cast("int").cast("string")
    k = F.col("l_partkey") % 3
    line = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Section "), F.col("l_partkey").cast("string"), F.lit(":"))).when(k == 0, F.concat(F.lit("• "), item, F.lit(" — "), q, F.lit(" pcs"))).when(k == 1, F.concat(q, F.lit(" m "), item)).otherwise(F.concat(F.lit("- "), item))
    return work_list(t("lineitem").withColumn("line", line), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], "line")


@query("""WITH w AS (SELECT p_partkey, p_name, string_split(p_name || ' ' || p_size, ' ') AS a, list_distinct(string_split(p_name || ' ' || lower(p_type), ' ')) AS b FROM part) SELECT p_partkey, round(""" + weighed("a", "b") + """, 9) AS similarity FROM w""")
def text_similarity(t: Tables):
    """Weighted Dice similarity of two texts of one row."""
    a, b = tokens(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))), tokens(F.concat_ws(" ", "p_name", F.lower("p_type")))
    return t("part").select("p_partkey", F.round(lexical_similarity(a, b), 9).alias("similarity"))
