"""The hourly-norm pricing cascade: exact, similar, parked, norm, fallback, web, run rate, no price.

Every stage aggregates the reference rows to one candidate per distinct text
before it meets the request rows, so a popular text costs one row, not one per
occurrence.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rubicost.functions.text import tokens
from rubicost.functions.units import attributes_compatible, units_compatible
from rubicost.operators.joins import knn_join, lexical_join
from rubicost.operators.statistics import exact_median
from rubicost.operators.topk import first_of, spread
from rubicost.registry import query
from rubicost.sources.files import stored
from rubicost.tables import Tables, with_views

# Similarity thresholds for texts, and the margin of an unselected file.
HIGH, MEDIUM, ACCEPT, MARGIN = 0.85, 0.66, 0.52, 0.04
TARGET_RATE = 25.0
ALLOWED, DENIED = (1, 2), (4,)

BASE = with_views("items", "specs")
STATE = f"CASE WHEN file_id % 5 IN {DENIED + DENIED} THEN 'denied' WHEN file_id % 5 IN {ALLOWED} THEN 'allowed' ELSE 'other' END"
PICK = f"""cand AS (SELECT text, category, {STATE} AS state, arg_min(struct_pack(file_id := file_id, sheet := sheet, row_no := row_no, price := unit_price), (tag <> 'A', file_id, sheet, row_no, unit_price)) AS c
    FROM items WHERE unit_price IS NOT NULL GROUP BY 1, 2, 3)"""


def candidates(t: Tables):
    """The preferred reference row of each text, category and permission state."""
    k = F.col("file_id") % 5
    state = F.when(k.isin(*DENIED), "denied").when(k.isin(*ALLOWED), "allowed").otherwise("other")
    row = F.struct("file_id", "sheet", "row_no", F.col("unit_price").alias("price"))
    return t.items().where("unit_price IS NOT NULL").groupBy("text", "category", state.alias("state")).agg(F.min_by(row, F.struct(F.col("tag") != "A", "file_id", "sheet", "row_no", "unit_price")).alias("c"))


@query(f"""{BASE}, {PICK}
SELECT s.spec_id, CASE WHEN a.c IS NOT NULL THEN 'exact' WHEN o.c IS NOT NULL THEN 'blocked' ELSE 'none' END AS source, coalesce(a.c.file_id, o.c.file_id) AS file_id,
    a.c.sheet AS sheet, a.c.row_no AS row_no, a.c.price AS price
FROM specs s LEFT JOIN cand a ON a.text = s.text AND a.category = s.category AND a.state = 'allowed' LEFT JOIN cand o ON o.text = s.text AND o.category = s.category AND o.state = 'other'""")
def exact_match(t: Tables):
    """Same text and attributes in an allowed file, else the unselected file that blocks the row; its price is not told."""
    cand = candidates(t)
    a = cand.where("state = 'allowed'").select("text", "category", F.col("c").alias("a"))
    o = cand.where("state = 'other'").select("text", "category", F.col("c").alias("o"))
    rows = t.specs().join(a, ["text", "category"], "left").join(o, ["text", "category"], "left")
    source = F.when(F.col("a").isNotNull(), "exact").when(F.col("o").isNotNull(), "blocked").otherwise("none")
    return rows.select("spec_id", source.alias("source"), F.coalesce("a.file_id", "o.file_id").alias("file_id"), "a.sheet", "a.row_no", "a.price")


TOKENS = """list_distinct(list_filter(regexp_extract_all({x}, '[a-z0-9]+(\\.[0-9]+)?'), lambda t: (NOT list_contains(['un','and','og','ar','with','med','the','a','an','of','for','uz','no','til','i','in','ieskaitot','incl','inkl','komplekts','kompl','montaza','montaža','uzstadisana','installation','levering','montage','piegade','supply'], t) AND length(t) > 1) OR regexp_full_match(t, '[0-9]+')))"""
WEIGHT = "list_sum(list_transform({x}, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END))"


def dice(a: str, b: str) -> str:
    return f"coalesce(2 * {WEIGHT.format(x=f'list_intersect({a}, {b})')} / ({WEIGHT.format(x=a)} + {WEIGHT.format(x=b)}), 0)"


LEXICAL = f"""texts AS (SELECT DISTINCT text, {TOKENS.format(x='text')} AS toks FROM specs), refs AS (SELECT DISTINCT text || ' ' || size AS text, category, {TOKENS.format(x="text || ' ' || size")} AS toks FROM items WHERE file_id % 5 <> 4),
sim AS (SELECT a.text AS spec_text, b.text AS item_text, b.category, {dice('a.toks', 'b.toks')} AS similarity FROM texts a, refs b WHERE len(list_intersect(a.toks, b.toks)) > 0)"""


@query(f"""{BASE}, {LEXICAL}, best AS (SELECT s.spec_id, item_text, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY s.spec_id ORDER BY round(similarity, 6) DESC, item_text) AS rank
    FROM specs s JOIN sim ON sim.spec_text = s.text AND sim.category = s.category WHERE similarity >= {ACCEPT * 0.8})
SELECT spec_id, rank::INTEGER AS rank, item_text, similarity FROM best WHERE rank <= 8""")
def lexical_candidates(t: Tables):
    """The eight most similar reference texts of the same category, over an inverted index of tokens."""
    specs = t.specs()
    left = specs.select("text", "category").distinct().select(F.concat_ws("\x1f", "text", "category").alias("k"), "category", tokens(F.col("text")).alias("toks"))
    named = F.concat_ws(" ", "text", F.col("size").cast("string"))
    right = t.items().where("file_id % 5 <> 4").select(named.alias("item_text"), "category").distinct().withColumn("toks", tokens(F.col("item_text")))
    sim = lexical_join(left, right, "k", "item_text", on=["category"], least=ACCEPT * 0.8).withColumn("similarity", F.round("similarity", 6))
    top = first_of(sim, ["l_key"], F.desc("similarity"), F.col("r_key"), rank="rank", n=8)
    rows = specs.select("spec_id", F.concat_ws("\x1f", "text", "category").alias("l_key"))
    return rows.join(top, "l_key").select("spec_id", "rank", F.col("r_key").alias("item_text"), "similarity")


@query("""WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, q.label AS q_label, x.vec_id, x.label, round(list_cosine_similarity(q.v, x.v), 6) AS similarity,
    round(list_cosine_similarity(q.v, x.v), 9) AS exact FROM n q JOIN n x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
top40 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, vec_id) AS r FROM s),
top8 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, vec_id) AS rank FROM top40 WHERE r <= 40 AND q_label = label)
SELECT query_id, rank::INTEGER AS rank, vec_id, similarity FROM top8 WHERE rank <= 8""")
def vector_candidates(t: Tables):
    """Top 40 by cosine first, the hard filter after, then the top 8, for a fiftieth of the rows; ``whole_vector_candidates`` asks for all."""
    return near_vectors(t, "vec_id % 50 = 0")


def near_vectors(t: Tables, asked: str):
    v = t("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    q = v.where(asked).select(F.col("vec_id").alias("query_id"), "v")
    near = knn_join(q, v.select("vec_id", "v"), 41, unrounded="cosine").where("query_id <> vec_id")
    near = first_of(near.drop("rank"), ["query_id"], F.desc("similarity"), F.col("vec_id"), n=40)
    labels = v.select("vec_id", "label")
    same = near.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id").where("label = q_label")
    return first_of(same, ["query_id"], F.desc("similarity"), F.col("vec_id"), rank="rank", n=8).select("query_id", "rank", "vec_id", F.round("cosine", 6).alias("similarity"))


@query("""WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, q.label AS q_label, x.vec_id, x.label, round(list_cosine_similarity(q.v, x.v), 6) AS similarity,
    round(list_cosine_similarity(q.v, x.v), 9) AS exact FROM n q JOIN n x ON q.vec_id <> x.vec_id),
top40 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, vec_id) AS r FROM s),
top8 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, vec_id) AS rank FROM top40 WHERE r <= 40 AND q_label = label)
SELECT query_id, rank::INTEGER AS rank, vec_id, similarity FROM top8 WHERE rank <= 8""")
def whole_vector_candidates(t: Tables):
    """``vector_candidates`` with every row as a query, against all others."""
    return near_vectors(t, "true")


NORMS = """norms AS (SELECT p_partkey AS norm_id, CASE p_partkey % 3 WHEN 0 THEN 'parameterised' WHEN 1 THEN 'item' ELSE 'category' END AS level, p_name AS text, p_type AS category, p_size AS size, round(p_retailprice / 1000, 6) AS hours FROM part WHERE p_partkey % 4 <> 0)"""


@query(f"""{with_views("specs")}, {NORMS},
hit AS (SELECT s.spec_id, 1 AS tier, 85 AS pct, n.norm_id, n.hours FROM specs s JOIN norms n ON n.level = 'parameterised' AND n.category = s.category AND n.size = s.size
    UNION ALL SELECT s.spec_id, 2, 72, n.norm_id, n.hours FROM specs s JOIN norms n ON n.level = 'item' AND n.text = s.text AND n.category = s.category
    UNION ALL SELECT s.spec_id, 3, 55, n.norm_id, n.hours FROM specs s JOIN norms n ON n.level = 'category' AND n.category = s.category),
r AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY tier, norm_id) AS k FROM hit)
SELECT spec_id, tier, pct, norm_id, hours FROM r WHERE k = 1""")
def norm_lookup(t: Tables):
    """The first tier that has a norm: parameterised, item, category; each tier is one row per key before its join."""
    norms = t("part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("norm_id"), (F.col("p_partkey") % 3).alias("k"), F.col("p_name").alias("text"), F.col("p_type").alias("category"), F.col("p_size").alias("size"), F.round(F.col("p_retailprice") / 1000, 6).alias("hours"))
    rows, out = t.specs(), None
    for tier, (k, keys) in enumerate(((0, ["category", "size"]), (1, ["text", "category"]), (2, ["category"])), 1):
        best = norms.where(F.col("k") == k).groupBy(*keys).agg(F.min(F.struct("norm_id", "hours")).alias(f"n{tier}"))
        rows = rows.join(best, keys, "left")
    tier = F.when(F.col("n1").isNotNull(), 1).when(F.col("n2").isNotNull(), 2).otherwise(3)
    out = rows.withColumn("n", F.coalesce("n1", "n2", "n3")).where(F.col("n").isNotNull())
    return out.select("spec_id", tier.alias("tier"), F.when(tier == 1, 85).when(tier == 2, 72).otherwise(55).alias("pct"), "n.norm_id", "n.hours")


CASCADE = f"""{BASE}, {PICK}, {NORMS}, hit AS (SELECT s.spec_id, s.qty, s.category, a.c AS a, o.c AS o FROM specs s
    LEFT JOIN cand a ON a.text = s.text AND a.category = s.category AND a.state = 'allowed' LEFT JOIN cand o ON o.text = s.text AND o.category = s.category AND o.state = 'other'),
nrm AS (SELECT category, arg_min(hours, norm_id) AS hours FROM norms WHERE level = 'category' GROUP BY category),
p AS (SELECT h.*, n.hours, CASE WHEN a IS NOT NULL THEN 'exact' WHEN o IS NOT NULL THEN 'pending_permission' WHEN n.hours IS NOT NULL THEN 'norm' ELSE 'none' END AS source FROM hit h LEFT JOIN nrm n ON n.category = h.category)
SELECT spec_id, source, CASE WHEN source = 'exact' THEN round(a.price, 8) END AS unit_material, CASE WHEN source IN ('exact', 'norm') THEN round(hours * {TARGET_RATE}, 4) END AS unit_labour,
    CASE source WHEN 'exact' THEN 95 WHEN 'norm' THEN 55 END AS pct, CASE source WHEN 'exact' THEN 'high' WHEN 'norm' THEN 'low' END AS confidence,
    CASE source WHEN 'norm' THEN 'CHECK' WHEN 'none' THEN 'NO PRICE' END AS flag, CASE WHEN source = 'pending_permission' THEN o.file_id END AS blocked_file,
    CASE WHEN source = 'exact' THEN round(qty * a.price, 7) END AS total_material FROM p"""


@query(CASCADE)
def hourly_cascade(t: Tables):
    """The stages that need no similar text, for all parts: exact, parked for permission, category norm, run rate, confidence, totals and no price."""
    cand = candidates(t)
    a = cand.where("state = 'allowed'").select("text", "category", F.col("c").alias("a"))
    o = cand.where("state = 'other'").select("text", "category", F.col("c").alias("o"))
    norms = t("part").where("p_partkey % 4 <> 0 AND p_partkey % 3 = 2").groupBy(F.col("p_type").alias("category")).agg(F.min_by(F.round(F.col("p_retailprice") / 1000, 6), "p_partkey").alias("hours"))
    rows = t.specs().join(a, ["text", "category"], "left").join(o, ["text", "category"], "left").join(norms, "category", "left")
    has_a, has_o = F.col("a").isNotNull(), F.col("o").isNotNull()
    rows = rows.withColumn("source", F.when(has_a, "exact").when(has_o, "pending_permission").when(F.col("hours").isNotNull(), "norm").otherwise("none"))
    exact, norm = F.col("source") == "exact", F.col("source") == "norm"
    pct = F.when(exact, 95).when(norm, 55)
    return rows.select(
        "spec_id",
        "source",
        F.when(exact, F.round("a.price", 8)).alias("unit_material"),
        F.when(exact | norm, F.round(F.col("hours") * TARGET_RATE, 4)).alias("unit_labour"),
        pct.alias("pct"),
        F.when(pct >= 80, "high").when(pct >= 60, "medium").when(pct.isNotNull(), "low").alias("confidence"),
        F.when(norm, "CHECK").when(F.col("source") == "none", "NO PRICE").alias("flag"),
        F.when(F.col("source") == "pending_permission", F.col("o.file_id")).alias("blocked_file"),
        F.when(exact, F.round(F.col("qty") * F.col("a.price"), 7)).alias("total_material"),
    )


@query(f"""WITH c AS ({CASCADE}) SELECT source, count(*) AS n FROM c GROUP BY source""")
def cascade_statistics(t: Tables):
    """Rows by source."""
    return hourly_cascade(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def nearest(t: Tables):
    """For each text and category of the request rows the most similar allowed and unselected reference row, from ACCEPT on."""
    k, named = F.col("file_id") % 5, F.concat_ws(" ", "text", F.col("size").cast("string"))
    state = F.when(k.isin(*ALLOWED), "allowed").otherwise("other")
    row = F.struct("file_id", F.col("unit_price").alias("price"))
    refs = t.items().where(~k.isin(*DENIED) & F.col("unit_price").isNotNull()).groupBy(named.alias("r_key"), "category", state.alias("state")).agg(F.min_by(row, F.struct(F.col("tag") != "A", "file_id", "sheet", "row_no", "unit_price")).alias("c"))
    key = F.concat_ws("\x1f", "text", "category")
    left = t.specs().select("text", "category").distinct().select(key.alias("k"), "category", tokens(F.col("text")).alias("toks"))
    right = refs.select("r_key", "category").distinct().withColumn("toks", tokens(F.col("r_key")))
    sim = lexical_join(left, right, "k", "r_key", on=["category"], least=ACCEPT).withColumn("similarity", F.round("similarity", 6))
    best = first_of(sim.join(refs, ["r_key", "category"]), ["l_key", "state"], F.desc("similarity"), F.col("r_key"))
    hit = F.struct("similarity", "c.file_id", "c.price")
    return best.groupBy("l_key").agg(*[F.max(F.when(F.col("state") == x, hit)).alias(n) for x, n in (("allowed", "a"), ("other", "o"))])


WHOLE = f"""{BASE}, {PICK}, {NORMS},
ex AS (SELECT s.spec_id, CASE WHEN a.c IS NOT NULL THEN 'exact' WHEN o.c IS NOT NULL THEN 'blocked' ELSE 'none' END AS first, coalesce(a.c.file_id, o.c.file_id) AS first_file, a.c.price AS first_price
    FROM specs s LEFT JOIN cand a ON a.text = s.text AND a.category = s.category AND a.state = 'allowed' LEFT JOIN cand o ON o.text = s.text AND o.category = s.category AND o.state = 'other'),
tier AS (SELECT s.spec_id, 1 AS tier, 85 AS pct, n.norm_id, n.hours FROM specs s JOIN norms n ON n.level = 'parameterised' AND n.category = s.category AND n.size = s.size
    UNION ALL SELECT s.spec_id, 2, 72, n.norm_id, n.hours FROM specs s JOIN norms n ON n.level = 'item' AND n.text = s.text AND n.category = s.category
    UNION ALL SELECT s.spec_id, 3, 55, n.norm_id, n.hours FROM specs s JOIN norms n ON n.level = 'category' AND n.category = s.category),
nr AS (SELECT spec_id, pct AS norm_pct, hours FROM (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY tier, norm_id) AS k FROM tier) WHERE k = 1),
web AS (SELECT page_id AS spec_id, min(length(html) % 90 + 10)::DOUBLE AS web FROM pages GROUP BY 1),
refs AS (SELECT text || ' ' || size AS r_key, category, CASE WHEN file_id % 5 IN {ALLOWED} THEN 'allowed' ELSE 'other' END AS state, arg_min(struct_pack(file_id := file_id, price := unit_price), (tag <> 'A', file_id, sheet, row_no, unit_price)) AS c
    FROM items WHERE file_id % 5 NOT IN {DENIED + DENIED} AND unit_price IS NOT NULL GROUP BY 1, 2, 3),
lt AS (SELECT DISTINCT text, category, {TOKENS.format(x='text')} AS toks FROM specs), rt AS (SELECT DISTINCT r_key, category, {TOKENS.format(x='r_key')} AS toks FROM refs),
sim AS (SELECT lt.text, lt.category, r_key, {dice('lt.toks', 'rt.toks')} AS s FROM lt JOIN rt ON rt.category = lt.category),
best AS (SELECT sim.text, sim.category, state, round(s, 6) AS s, c, row_number() OVER (PARTITION BY sim.text, sim.category, state ORDER BY round(s, 6) DESC, sim.r_key) AS k FROM sim JOIN refs ON refs.r_key = sim.r_key AND refs.category = sim.category WHERE s >= {ACCEPT}),
near AS (SELECT text, category, max(s) FILTER (WHERE state = 'allowed') AS a, max(c.price) FILTER (WHERE state = 'allowed') AS a_price, max(s) FILTER (WHERE state = 'other') AS o, max(c.file_id) FILTER (WHERE state = 'other') AS o_file FROM best WHERE k = 1 GROUP BY 1, 2),
st AS (SELECT s.spec_id, s.qty, ex.first, first_file, first_price, norm_pct, hours, web, a, a_price, o, o_file, coalesce(o >= {MEDIUM}, false) AND (a IS NULL OR o > a + {MARGIN}) AND NOT coalesce(a >= {HIGH}, false) AS blocks
    FROM specs s JOIN ex ON ex.spec_id = s.spec_id LEFT JOIN nr ON nr.spec_id = s.spec_id LEFT JOIN web ON web.spec_id = s.spec_id LEFT JOIN near ON near.text = s.text AND near.category = s.category),
sg AS (SELECT *, CASE WHEN first = 'exact' THEN 'exact' WHEN NOT blocks AND coalesce(a >= {MEDIUM}, false) THEN 'similar' WHEN blocks OR first = 'blocked' THEN 'pending_permission' WHEN hours IS NOT NULL THEN 'norm' WHEN a IS NOT NULL THEN 'weak' WHEN web IS NOT NULL THEN 'web' ELSE 'none' END AS stage FROM st),
pr AS (SELECT *, CASE WHEN stage = 'exact' THEN first_price WHEN stage IN ('similar', 'weak') THEN a_price WHEN stage IN ('norm', 'web') THEN web END AS material, CASE stage WHEN 'exact' THEN 95 WHEN 'similar' THEN CASE WHEN a >= {HIGH} THEN 88 ELSE 72 END WHEN 'norm' THEN norm_pct WHEN 'weak' THEN 50 WHEN 'web' THEN 40 END AS pct FROM sg)
SELECT spec_id, CASE WHEN stage IN ('similar', 'weak') THEN 'semantic' ELSE stage END AS source, round(material, 8) AS unit_material, CASE WHEN stage <> 'pending_permission' THEN round(hours * {TARGET_RATE}, 4) END AS unit_labour, pct,
    CASE WHEN pct >= 80 THEN 'high' WHEN pct >= 60 THEN 'medium' WHEN pct IS NOT NULL THEN 'low' END AS confidence, nullif(concat_ws(', ', CASE WHEN pct < 60 THEN 'CHECK' END, CASE WHEN stage IN ('norm', 'web') AND web IS NOT NULL THEN 'WEB' END, CASE WHEN stage = 'none' THEN 'NO PRICE' END), '') AS flag,
    CASE WHEN stage = 'pending_permission' THEN CASE WHEN first = 'blocked' THEN first_file ELSE o_file END END AS blocked_file, round(qty * material, 7) AS total_material FROM pr"""


@query(WHOLE)
def whole_hourly_cascade(t: Tables):
    """All stages for all parts: exact, similar, parked for permission, the norm tiers, weak match, web, run rate and no price.

    The best rows are taken from all similar ones, not from the first eight. The
    weak match is the fallback without a model.
    """
    exact = exact_match(t).select("spec_id", F.col("source").alias("first"), F.col("file_id").alias("first_file"), F.col("price").alias("first_price"))
    norms = norm_lookup(t).select("spec_id", F.col("pct").alias("norm_pct"), "hours")
    web = t("pages").groupBy(F.col("page_id").alias("spec_id")).agg(F.min(F.length("html") % 90 + F.lit(10.0)).alias("web"))
    rows = t.specs().withColumn("l_key", F.concat_ws("\x1f", "text", "category")).join(nearest(t), "l_key", "left")
    rows = rows.join(exact, "spec_id").join(norms, "spec_id", "left").join(web, "spec_id", "left")
    sure = lambda c: F.coalesce(c, F.lit(False))
    a, o = F.col("a.similarity"), F.col("o.similarity")
    blocks = sure(o >= MEDIUM) & (a.isNull() | (o > a + MARGIN)) & ~sure(a >= HIGH)
    stage = (
        F.when(F.col("first") == "exact", "exact")
        .when(~blocks & sure(a >= MEDIUM), "similar")
        .when(blocks | (F.col("first") == "blocked"), "pending_permission")
        .when(F.col("hours").isNotNull(), "norm")
        .when(a.isNotNull(), "weak")
        .when(F.col("web").isNotNull(), "web")
        .otherwise("none")
    )
    rows, at = rows.withColumn("stage", stage), F.col("stage")
    material = F.when(at == "exact", F.col("first_price")).when(at.isin("similar", "weak"), F.col("a.price")).when(at.isin("norm", "web"), F.col("web"))
    pct = F.when(at == "exact", 95).when(at == "similar", F.when(a >= HIGH, 88).otherwise(72)).when(at == "norm", F.col("norm_pct")).when(at == "weak", 50).when(at == "web", 40)
    flags = F.concat_ws(", ", F.when(pct < 60, "CHECK"), F.when(at.isin("norm", "web") & F.col("web").isNotNull(), "WEB"), F.when(at == "none", "NO PRICE"))
    return rows.select(
        "spec_id",
        F.when(at.isin("similar", "weak"), "semantic").otherwise(at).alias("source"),
        F.round(material, 8).alias("unit_material"),
        F.when(at != "pending_permission", F.round(F.col("hours") * TARGET_RATE, 4)).alias("unit_labour"),
        pct.alias("pct"),
        F.when(pct >= 80, "high").when(pct >= 60, "medium").when(pct.isNotNull(), "low").alias("confidence"),
        F.nullif(flags, F.lit("")).alias("flag"),
        F.when(at == "pending_permission", F.when(F.col("first") == "blocked", F.col("first_file")).otherwise(F.col("o.file_id"))).alias("blocked_file"),
        F.round(F.col("qty") * material, 7).alias("total_material"),
    )


@query(f"""WITH c AS ({WHOLE}) SELECT source, count(*) AS n FROM c GROUP BY source""")
def whole_cascade_statistics(t: Tables):
    """Rows of the cascade over all parts by source."""
    return whole_hourly_cascade(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{with_views("items")}, b AS (SELECT category, max(unit_price / 10000) FILTER (WHERE file_id % 5 IN (1, 2)) AS allowed, max(unit_price / 10000) FILTER (WHERE file_id % 5 IN (0, 3)) AS other,
    arg_max(file_id, (unit_price, -file_id)) FILTER (WHERE file_id % 5 IN (0, 3)) AS other_file FROM items WHERE qty > 10 GROUP BY category, size)
SELECT category, count(*) AS n, count(*) FILTER (WHERE other >= {MEDIUM} AND (allowed IS NULL OR other > allowed + {MARGIN}) AND NOT coalesce(allowed >= {HIGH}, false)) AS blocked, max(other_file) AS other_file FROM b GROUP BY category""")
def blocked_files(t: Tables):
    """Rows whose best match lies in an unselected file by more than the margin."""
    k = F.col("file_id") % 5
    score = F.col("unit_price") / 10000
    allowed, other = k.isin(1, 2), k.isin(0, 3)
    best = t.items().where("qty > 10").groupBy("category", "size").agg(F.max(F.when(allowed, score)).alias("a"), F.max(F.when(other, score)).alias("o"), F.max_by(F.when(other, F.col("file_id")), F.when(other, F.struct("unit_price", -F.col("file_id")))).alias("f"))
    blocked = (F.col("o") >= MEDIUM) & (F.col("a").isNull() | (F.col("o") > F.col("a") + MARGIN)) & ~F.coalesce(F.col("a") >= HIGH, F.lit(False))
    return best.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(blocked).alias("blocked"), F.max("f").alias("other_file"))


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 THEN NULL ELSE l_tax * 10 END AS norm, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount * 400 END AS rate, l_quantity AS labour FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN norm IS NOT NULL THEN round(norm, 4) WHEN rate IS NOT NULL THEN round(labour / rate, 4) END AS norm_h,
    CASE WHEN norm IS NOT NULL THEN round(norm * {TARGET_RATE}, 5) WHEN rate IS NOT NULL THEN round(round(labour / rate, 4) * {TARGET_RATE}, 5) ELSE labour END AS unit_labour FROM r""")
def labour_rerate(t: Tables):
    """Labour at the run's rate: from norm hours, or from a price through the source's own rate; zero counts as absent."""
    norm, rate = F.nullif("l_tax", F.lit(0.0)) * 10, F.nullif("l_discount", F.lit(0.0)) * 400
    r = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", norm.alias("norm"), rate.alias("rate"), F.col("l_quantity").alias("labour"))
    own = F.round(F.col("labour") / F.col("rate"), 4)
    has_norm, has_rate = F.col("norm").isNotNull(), F.col("rate").isNotNull()
    return r.select("l_orderkey", "l_linenumber", "l_partkey", F.when(has_norm, F.round("norm", 4)).when(has_rate, own).alias("norm_h"), F.when(has_norm, F.round(F.col("norm") * TARGET_RATE, 5)).when(has_rate, F.round(own * TARGET_RATE, 5)).otherwise(F.col("labour")).alias("unit_labour"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, greatest(1, least(99, (l_quantity * 3 - 20)::INTEGER)) AS pct FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, pct, CASE WHEN pct >= 80 THEN 'high' WHEN pct >= 60 THEN 'medium' ELSE 'low' END AS confidence, pct < 60 AS needs_check FROM c""")
def confidence_levels(t: Tables):
    pct = F.greatest(F.lit(1), F.least(F.lit(99), (F.col("l_quantity") * 3 - 20).cast("int")))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", pct.alias("pct"), F.when(pct >= 80, "high").when(pct >= 60, "medium").otherwise("low").alias("confidence"), (pct < 60).alias("needs_check"))


FILTER_SIDES = """a AS (SELECT p_type AS ca, p_size AS sa, CASE p_partkey % 4 WHEN 0 THEN 'pcs' WHEN 1 THEN 'set' WHEN 2 THEN 'lot' ELSE NULL END AS ua, count(*) AS n_a FROM part GROUP BY ALL),
b AS (SELECT CASE WHEN p_type = 'PROMO' THEN 'other' ELSE p_type END AS cb, nullif(p_size, 7) AS sb, CASE p_partkey % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'set' ELSE 'm' END AS ub, count(*) AS n_b FROM part GROUP BY ALL)"""


@query(f"""WITH {FILTER_SIDES} SELECT * FROM a JOIN b ON (ca = cb OR cb = 'other') AND (sb IS NULL OR sa = sb)
    AND (ua IS NULL OR ua = ub OR (ua IN ('pcs', 'set', 'point') AND ub IN ('pcs', 'set', 'point')) OR (ua IN ('set', 'lot') AND ub IN ('set', 'lot')))""")
def hard_filter_pairs(t: Tables):
    """Pairs of attribute classes that pass the hard filter, with the rows of each; the wildcard category is a key of its own."""
    a, b = filter_sides(t("part"), t("part"))
    a = a.groupBy("ca", "sa", "ua").agg(F.count(F.lit(1)).alias("n_a"))
    b = b.groupBy("cb", "sb", "ub").agg(F.count(F.lit(1)).alias("n_b"))
    return filtered(a, b).drop("k")


def filter_sides(a, b):
    """Both sides of the hard filter: id, category, size and unit."""
    unit_a = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'pcs' WHEN 1 THEN 'set' WHEN 2 THEN 'lot' END")
    unit_b = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'set' ELSE 'm' END")
    a = a.select(F.col("p_partkey").alias("a_id"), F.col("p_type").alias("ca"), F.col("p_size").alias("sa"), unit_a.alias("ua"))
    return a, b.select(F.col("p_partkey").alias("b_id"), F.when(F.col("p_type") == "PROMO", "other").otherwise(F.col("p_type")).alias("cb"), F.nullif("p_size", F.lit(7)).alias("sb"), unit_b.alias("ub"))


def filtered(a, b):
    """Pairs of rows of both sides that pass the hard filter."""
    both = a.withColumn("k", F.explode(F.array_distinct(F.array("ca", F.lit("other"))))).join(b, F.col("k") == F.col("cb"))
    ok = attributes_compatible({"category": F.col("ca"), "size": F.col("sa")}, {"category": F.col("cb"), "size": F.col("sb")}) & units_compatible(F.col("ua"), F.col("ub"))
    return both.where(ok)


@query()
def whole_hard_filter_pairs(t: Tables):
    """All parts on both sides, by classes of equal category, size and unit: the pairs of classes that pass and the members of each class.

    A row with ``a`` and ``b`` is a pair of classes, one with an id is a member of
    the class beside it. The pairs of rows are the members of the one with those
    of the other; their number grows with the square of the parts, that of the
    classes does not.
    """
    a, b = filter_sides(t("part"), t("part"))
    in_a, in_b = F.struct(F.col("ca").alias("category"), F.col("sa").alias("size"), F.col("ua").alias("unit")).alias("a"), F.struct(F.col("cb").alias("category"), F.col("sb").alias("size"), F.col("ub").alias("unit")).alias("b")
    pairs = filtered(a.drop("a_id").distinct(), b.drop("b_id").distinct()).select(in_a, in_b)
    members = a.select(in_a, "a_id").unionByName(b.select(in_b, "b_id"), allowMissingColumns=True)
    return pairs.unionByName(members, allowMissingColumns=True)


@query(f"""{BASE}, {LEXICAL}, per AS (SELECT s.spec_id, i.file_id, max(sim.similarity) AS best FROM specs s JOIN sim ON sim.spec_text = s.text AND sim.category = s.category
    JOIN (SELECT DISTINCT file_id, text || ' ' || size AS item_text, category FROM items WHERE file_id % 5 <> 4) i ON i.item_text = sim.item_text AND i.category = sim.category GROUP BY 1, 2)
SELECT file_id, round(sum(best) / (SELECT count(*) FROM specs), 6) AS score FROM per GROUP BY file_id""")
def template_ranking(t: Tables):
    """How well each file covers a work list: the mean over its items of the best similarity in the file."""
    specs = t.specs()
    left = specs.select("text", "category").distinct().select(F.concat_ws("\x1f", "text", "category").alias("k"), "category", tokens(F.col("text")).alias("toks"))
    named = F.concat_ws(" ", "text", F.col("size").cast("string"))
    texts = stored(t.items().where("file_id % 5 <> 4").select("file_id", named.alias("item_text"), "category").distinct())
    right = texts.select("item_text", "category").distinct().withColumn("toks", tokens(F.col("item_text")))
    # written, so that its size is known: pairs of distinct texts are few, and files' texts stay where they are
    sim = stored(lexical_join(left, right, "k", "item_text", on=["category"]))
    per = sim.join(spread(texts, "file_id").withColumnRenamed("item_text", "r_key"), ["r_key", "category"]).groupBy("l_key", "file_id").agg(F.max("similarity").alias("best"))
    times = specs.groupBy(F.concat_ws("\x1f", "text", "category").alias("l_key")).agg(F.count(F.lit(1)).alias("n"))
    total = specs.agg(F.count(F.lit(1)).alias("total"))
    sums = per.join(times, "l_key").groupBy("file_id").agg(F.sum(F.col("best") * F.col("n")).alias("s"))
    return sums.crossJoin(F.broadcast(total)).select("file_id", F.round(F.col("s") / F.col("total"), 6).alias("score"))


@query("""SELECT p_type, count(*) AS n, median(p_retailprice) AS median_price, round(stddev_pop(p_retailprice) / abs(avg(p_retailprice)), 6) AS spread FROM part GROUP BY p_type""")
def price_spread(t: Tables):
    """Median and coefficient of variation by category."""
    x = F.col("p_retailprice")
    variation = t("part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_pop(x) / F.abs(F.avg(x)), 6).alias("spread"))
    middle = exact_median(t("part"), ["p_type"], "p_retailprice", "median_price").drop("n")
    return variation.join(middle, "p_type", "left").select("p_type", "n", "median_price", "spread")


@query("""WITH w AS (SELECT page_id, (length(html) % 90 + 10)::DOUBLE AS price, page_id % 3 AS kind FROM pages), r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'norm' WHEN 2 THEN 'exact' ELSE 'none' END AS source FROM part)
SELECT p_partkey, CASE WHEN source = 'none' AND price IS NOT NULL THEN 'web' ELSE source END AS source, CASE WHEN source IN ('none', 'norm') THEN price END AS unit_material, CASE WHEN source = 'none' AND price IS NOT NULL THEN 40 END AS pct
FROM r LEFT JOIN w ON w.page_id = p_partkey""")
def web_prices(t: Tables):
    """Web prices fill rows that have no material price; only rows without any source change theirs."""
    w = t("pages").select("page_id", (F.length("html") % 90 + F.lit(10.0)).alias("price"))
    r = t("part").select("p_partkey", F.expr("CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'norm' WHEN 2 THEN 'exact' ELSE 'none' END").alias("source"))
    found = (F.col("source") == "none") & F.col("price").isNotNull()
    return r.join(w, F.col("page_id") == F.col("p_partkey"), "left").select("p_partkey", F.when(found, "web").otherwise(F.col("source")).alias("source"), F.when(F.col("source").isin("none", "norm"), F.col("price")).alias("unit_material"), F.when(found, 40).alias("pct"))


@query("""WITH r AS (SELECT l_orderkey AS run_id, l_linenumber, l_extendedprice, sum(l_extendedprice::DECIMAL(18,2)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS s FROM lineitem)
SELECT run_id, max(s)::DOUBLE AS total, count(*) FILTER (WHERE s <= 100000) AS within FROM r GROUP BY run_id""")
def running_totals(t: Tables):
    """Running totals of a run and the rows that fit under a limit."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    r = t("lineitem").select(F.col("l_orderkey").alias("run_id"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).over(w).alias("s"))
    return r.groupBy("run_id").agg(F.max("s").cast("double").alias("total"), F.count_if(F.col("s") <= 100000).alias("within"))
