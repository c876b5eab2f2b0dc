"""The unit-rate model: quotes from reference sheets by key, band, bracket and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rubicost.operators.joins import asof_nearest, overlap_join
from rubicost.operators.scan import ranks
from rubicost.operators.topk import first_of, mode_first_seen
from rubicost.registry import query
from rubicost.tables import Tables, with_views

ITEMS = with_views("items")
RANKED = with_views("files", "items")
# Preference: own market, own client, then the newest document; the file breaks what is left.
WANT_MARKET, WANT_CLIENT = "FRANCE", "EUROPE"
RANK = f"(CASE WHEN market = '{WANT_MARKET}' THEN 0 ELSE 1 END, CASE WHEN client = '{WANT_CLIENT}' THEN 0 ELSE 1 END, -newest, file_id)"
PREF = f"""pref AS (SELECT f.file_id, row_number() OVER (ORDER BY {RANK}) AS rank FROM (SELECT files.file_id, market, client, coalesce(max(epoch(doc_date))::BIGINT, 0) AS newest FROM files LEFT JOIN items ON items.file_id = files.file_id GROUP BY 1, 2, 3) f)"""


def preference(t: Tables):
    """file_id and the order of preference as a struct that compares."""
    newest = t("lineitem").groupBy(F.col("l_suppkey").alias("file_id")).agg(F.unix_timestamp(F.max("l_shipdate").cast("timestamp")).alias("newest"))
    f = t.files().join(newest, "file_id", "left")
    return f.select("file_id", F.struct(F.when(F.col("market") == WANT_MARKET, 0).otherwise(1).alias("m"), F.when(F.col("client") == WANT_CLIENT, 0).otherwise(1).alias("c"), (-F.coalesce("newest", F.lit(0))).alias("d"), F.col("file_id").alias("f")).alias("pref"))


@query(f"""{RANKED}, {PREF} SELECT file_id, rank FROM pref""")
def file_preference(t: Tables):
    """Order of preference among reference files, by range partitions."""
    return ranks(preference(t), [F.col("pref")]).select("file_id", F.col("rank").cast("long").alias("rank"))


@query(f"""{ITEMS}, c AS (SELECT file_id, category, qty, count(*) AS n, min((doc_date, sheet, row_no)) AS seen FROM items GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id, category ORDER BY n DESC, seen) AS k FROM c) SELECT file_id, category, qty, n FROM r WHERE k = 1""")
def mode_per_file(t: Tables):
    """Most common value of a file and category, the first seen of equals."""
    return mode_first_seen(t.items(), ["file_id", "category"], "qty", ["doc_date", "sheet", "row_no"]).select("file_id", "category", "qty", "n")


@query(f"""{RANKED}, {PREF}, c AS (SELECT file_id, category, qty AS rate, count(*) AS n, min((doc_date, sheet, row_no)) AS seen FROM items GROUP BY 1, 2, 3),
m AS (SELECT file_id, category, rate FROM (SELECT *, row_number() OVER (PARTITION BY file_id, category ORDER BY n DESC, seen) AS k FROM c) WHERE k = 1)
SELECT category, arg_min(rate, rank) AS rate, arg_min(m.file_id, rank) AS file_id, count(*) AS alternatives, min(rate) AS lowest, max(rate) AS highest FROM m JOIN pref ON pref.file_id = m.file_id GROUP BY category""")
def exact_quotes(t: Tables):
    """The preferred file's most common rate for each key, with how far the other files' rates go."""
    modes = mode_first_seen(t.items(), ["file_id", "category"], "qty", ["doc_date", "sheet", "row_no"])
    both = modes.join(preference(t), "file_id")
    return both.groupBy("category").agg(F.min_by("qty", "pref").alias("rate"), F.min_by("file_id", "pref").alias("file_id"), F.count(F.lit(1)).alias("alternatives"), F.min("qty").alias("lowest"), F.max("qty").alias("highest"))


@query("""WITH a AS (SELECT p_partkey AS want_id, p_type AS k1, nullif(p_size, 5) AS k2, p_brand AS k3 FROM part WHERE p_partkey % 10 = 1), b AS (SELECT p_type AS k1, nullif(p_size, 5) AS k2, p_brand AS k3, count(*) AS n, min(p_partkey) AS ref_id FROM part WHERE p_partkey % 10 <> 1 GROUP BY ALL)
SELECT want_id, b.ref_id, b.n FROM a JOIN b ON a.k1 IS NOT DISTINCT FROM b.k1 AND a.k2 IS NOT DISTINCT FROM b.k2 AND a.k3 IS NOT DISTINCT FROM b.k3""")
def install_key_join(t: Tables):
    """Equality on a composite key in which null equals null."""
    key = [F.col("p_type").alias("k1"), F.nullif("p_size", F.lit(5)).alias("k2"), F.col("p_brand").alias("k3")]
    a = t("part").where("p_partkey % 10 = 1").select(F.col("p_partkey").alias("want_id"), *key)
    b = t("part").where("p_partkey % 10 <> 1").select("p_partkey", *key).groupBy("k1", "k2", "k3").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("ref_id")).alias("b")
    return a.alias("a").join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("k1", "k2", "k3")]).select("want_id", "ref_id", "n")


@query("""SELECT p_type || ' ' || p_size AS label, count(*) AS n, list_sort(list_distinct(list(p_retailprice))) AS rates, min(p_retailprice) AS low, max(p_retailprice) AS high,
    CASE WHEN min(p_retailprice) = max(p_retailprice) THEN printf('%.2f', min(p_retailprice)) ELSE printf('%.2f', min(p_retailprice)) || '–' || printf('%.2f', max(p_retailprice)) END AS text FROM part GROUP BY 1""")
def rate_card(t: Tables):
    """One line per label: its distinct rates and their range as text."""
    x = F.col("p_retailprice")
    g = t("part").groupBy(F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(x)).alias("rates"), F.min(x).alias("low"), F.max(x).alias("high"))
    low, high = F.format_string("%.2f", F.col("low")), F.format_string("%.2f", F.col("high"))
    return g.withColumn("text", F.when(F.col("low") == F.col("high"), low).otherwise(F.concat(low, F.lit("–"), high)))


@query("""WITH pts AS (SELECT p_type, p_size::DOUBLE AS x, arg_min(p_retailprice, p_partkey) AS v FROM part WHERE p_size % 7 = 0 GROUP BY 1, 2), w AS (SELECT p_partkey AS want_id, p_type, p_size::DOUBLE AS x FROM part),
n AS (SELECT want_id, w.x, max(p.x) FILTER (WHERE p.x <= w.x) AS lo, min(p.x) FILTER (WHERE p.x >= w.x) AS hi, arg_max(p.v, p.x) FILTER (WHERE p.x <= w.x) AS lo_v, arg_min(p.v, p.x) FILTER (WHERE p.x >= w.x) AS hi_v FROM w JOIN pts p ON p.p_type = w.p_type GROUP BY 1, 2)
SELECT want_id, CASE WHEN lo = hi THEN lo_v WHEN lo IS NULL THEN hi_v WHEN hi IS NULL THEN lo_v WHEN lo_v = hi_v THEN lo_v WHEN hi - x <= x - lo THEN hi_v ELSE lo_v END AS rate,
    CASE WHEN lo = hi THEN 'exact' WHEN lo IS NULL OR hi IS NULL THEN 'nearest' ELSE 'band' END AS method FROM n""")
def band_interpolation(t: Tables):
    """The rate of the nearest size: exact, within a band, or the nearest end outside the range."""
    points = t("part").where("p_size % 7 = 0").groupBy("p_type", F.col("p_size").cast("double").alias("px")).agg(F.min_by("p_retailprice", "p_partkey").alias("v"))
    wanted = t("part").select(F.col("p_partkey").alias("want_id"), "p_type", F.col("p_size").cast("double").alias("x"))
    n = asof_nearest(points, ["p_type"], "px", "v", wanted, "x")
    lo, hi, x = F.col("lo"), F.col("hi"), F.col("x")
    rate = F.when(lo == hi, F.col("lo_value")).when(lo.isNull(), F.col("hi_value")).when(hi.isNull(), F.col("lo_value")).when(hi - x <= x - lo, F.col("hi_value")).otherwise(F.col("lo_value"))
    method = F.when(lo == hi, "exact").when(lo.isNull() | hi.isNull(), "nearest").otherwise("band")
    return n.where(lo.isNotNull() | hi.isNotNull()).select("want_id", rate.alias("rate"), method.alias("method"))


@query("""WITH pts AS (SELECT p_type, p_size::DOUBLE AS x, arg_min(p_retailprice, p_partkey) AS v FROM part WHERE p_size % 6 = 1 GROUP BY 1, 2), w AS (SELECT p_partkey AS want_id, p_type, p_size::DOUBLE AS x FROM part),
n AS (SELECT want_id, w.x, max(p.x) FILTER (WHERE p.x <= w.x) AS lo, min(p.x) FILTER (WHERE p.x >= w.x) AS hi FROM w JOIN pts p ON p.p_type = w.p_type GROUP BY 1, 2)
SELECT want_id, CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL OR lo = hi THEN lo WHEN hi <= 2 * x THEN hi WHEN hi / x <= x / lo THEN hi ELSE lo END AS size FROM n""")
def rating_round_up(t: Tables):
    """Ratings go up to the next size where that is at most double, else to the nearer one by ratio."""
    points = t("part").where("p_size % 6 = 1").groupBy("p_type", F.col("p_size").cast("double").alias("px")).agg(F.min_by("p_retailprice", "p_partkey").alias("v"))
    wanted = t("part").select(F.col("p_partkey").alias("want_id"), "p_type", F.col("p_size").cast("double").alias("x"))
    n = asof_nearest(points, ["p_type"], "px", "v", wanted, "x")
    lo, hi, x = F.col("lo"), F.col("hi"), F.col("x")
    size = F.when(lo.isNull(), hi).when(hi.isNull() | (lo == hi), lo).when(hi <= 2 * x, hi).when(hi / x <= x / lo, hi).otherwise(lo)
    return n.where(lo.isNotNull() | hi.isNotNull()).select("want_id", size.alias("size"))


GRID = "grid AS (SELECT p_size AS w, p_partkey % 5 AS t, round(arg_min(p_retailprice, p_partkey), 2) AS rate FROM part GROUP BY 1, 2)"


@query(f"""WITH {GRID}, step AS (SELECT coalesce(median(b.rate - a.rate), 10) AS step FROM grid a JOIN grid b ON b.w = a.w AND b.t = a.t + 1), want AS (SELECT DISTINCT p_size AS w0, p_partkey % 8 AS t0 FROM part),
pick AS (SELECT w0, t0, coalesce(min(w) FILTER (WHERE w >= w0), max(w)) AS wb FROM want, (SELECT DISTINCT w FROM grid) GROUP BY w0, t0),
near AS (SELECT w0, t0, wb, t, rate, row_number() OVER (PARTITION BY w0, t0 ORDER BY abs(t - t0), t) AS k FROM pick JOIN grid ON grid.w = wb)
SELECT w0, t0, wb, t, round(rate + step * (t0 - t), 4) AS rate FROM near, step WHERE k = 1""")
def bracket_grid(t: Tables):
    """Two-dimensional nearest: the width at or above, then the nearest tier and a step for each further one."""
    grid = t("part").groupBy(F.col("p_size").alias("w"), (F.col("p_partkey") % 5).alias("t")).agg(F.round(F.min_by("p_retailprice", "p_partkey"), 2).alias("rate"))
    nxt = grid.select("w", (F.col("t") - 1).alias("t"), F.col("rate").alias("next"))
    step = grid.join(nxt, ["w", "t"]).agg(F.coalesce(F.median(F.col("next") - F.col("rate")), F.lit(10.0)).alias("step"))  # a row per width and tier
    want = t("part").select(F.col("p_size").alias("w0"), (F.col("p_partkey") % 8).alias("t0")).distinct()
    widths = grid.select("w").distinct().withColumn("k", F.lit(0))
    n = asof_nearest(widths, ["k"], "w", "w", want.withColumn("k", F.lit(0)), "w0")
    pick = n.select("w0", "t0", F.coalesce("hi", "lo").alias("wb"))
    near = first_of(pick.join(grid, F.col("wb") == F.col("w")), ["w0", "t0"], F.abs(F.col("t") - F.col("t0")), F.col("t"))
    return near.crossJoin(F.broadcast(step)).select("w0", "t0", "wb", "t", F.round(F.col("rate") + F.col("step") * (F.col("t0") - F.col("t")), 4).alias("rate"))


@query("""WITH w AS (SELECT DISTINCT p_name AS a, string_split(p_name, ' ') AS ta FROM part), r AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS b, p_type, string_split(p_name || ' ' || lower(p_type), ' ') AS tb FROM part),
s AS (SELECT a, b, len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(list_concat(ta, tb))) AS j FROM w, r WHERE len(list_intersect(ta, tb)) > 0)
SELECT a, b, round(j, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS k FROM s) WHERE k = 1 AND j >= 0.5""")
def similar_text(t: Tables):
    """The reference text with the largest word overlap, at least one half; distinct texts meet through their rarest words."""
    a = t("part").select(F.col("p_name").alias("a")).distinct().withColumn("ta", F.split("a", " "))
    b = t("part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("b")).distinct().withColumn("tb", F.split("b", " "))
    scored = overlap_join(a, b, "a", "b", "ta", "tb", 0.5)
    return first_of(scored, ["a"], F.desc("overlap"), F.col("b")).select("a", "b", F.round("overlap", 6).alias("overlap"))


@query("""WITH a AS (SELECT l_orderkey AS section, arg_min(l_quantity, (l_linenumber, l_partkey, l_extendedprice)) FILTER (WHERE l_quantity >= 20) AS anchor FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / anchor, 6) AS ratio FROM lineitem JOIN a ON section = l_orderkey WHERE anchor IS NOT NULL AND l_quantity < 20""")
def accessory_ratios(t: Tables):
    """Quantity of each accessory against the first anchor row of its section."""
    order = F.struct("l_linenumber", "l_partkey", "l_extendedprice")
    big = F.col("l_quantity") >= 20
    anchors = t("lineitem").groupBy(F.col("l_orderkey").alias("section")).agg(F.min_by(F.when(big, F.col("l_quantity")), F.when(big, order)).alias("anchor")).where("anchor IS NOT NULL")
    return t("lineitem").where("l_quantity < 20").join(anchors, F.col("section") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_quantity") / F.col("anchor"), 6).alias("ratio"))


@query("""WITH s AS (SELECT l_suppkey, sum(l_extendedprice::DECIMAL(18,2)) FILTER (WHERE l_returnflag = 'R') AS amount, sum(l_extendedprice::DECIMAL(18,2)) AS supply, sum(l_extendedprice::DECIMAL(18,2)) FILTER (WHERE l_returnflag <> 'R') AS items FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(amount::DOUBLE / CASE WHEN supply - amount > 0 THEN supply - amount ELSE items END::DOUBLE, 6) AS share FROM s WHERE amount IS NOT NULL""")
def delivery_share(t: Tables):
    """Delivery as a share of the supply total without it."""
    x = F.col("l_extendedprice").cast("decimal(18,2)")
    s = t("lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", x)).alias("amount"), F.sum(x).alias("supply"), F.sum(F.when(F.col("l_returnflag") != "R", x)).alias("items")).where("amount IS NOT NULL")
    base = F.when(F.col("supply") - F.col("amount") > 0, F.col("supply") - F.col("amount")).otherwise(F.col("items"))
    return s.select("l_suppkey", F.round(F.col("amount").cast("double") / base.cast("double"), 6).alias("share"))


@query("""SELECT l_suppkey AS sheet, coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (WHERE l_returnflag = 'A'), 0)::DOUBLE AS install, coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (WHERE l_returnflag = 'N'), 0)::DOUBLE AS supply,
    coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (WHERE l_returnflag = 'R'), 0)::DOUBLE AS other, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM lineitem GROUP BY 1""")
def sheet_totals(t: Tables):
    x = F.col("l_extendedprice").cast("decimal(18,2)")
    part = lambda f: F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, x)), F.lit(0)).cast("double")
    return t("lineitem").groupBy(F.col("l_suppkey").alias("sheet")).agg(part("A").alias("install"), part("N").alias("supply"), part("R").alias("other"), F.sum(x).cast("double").alias("total"))


@query("""WITH r AS (SELECT l_suppkey AS file_id, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS class, l_linenumber AS phase, l_extendedprice AS rate, l_orderkey AS ord, l_partkey FROM lineitem),
best AS (SELECT class, min(file_id) AS file_id FROM r GROUP BY class), p AS (SELECT r.class, phase, arg_min(rate, (ord, l_partkey)) AS same, r.file_id FROM r JOIN best b ON b.class = r.class AND b.file_id = r.file_id GROUP BY 1, 2, 4),
f AS (SELECT r.class, arg_min(rate, (ord, phase, l_partkey)) AS first FROM r JOIN best b ON b.class = r.class AND b.file_id = r.file_id GROUP BY 1), want AS (SELECT DISTINCT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, (p_partkey % 9)::INTEGER AS phase FROM part)
SELECT w.class, w.phase, round(coalesce(same, first), 2) AS rate FROM want w LEFT JOIN p ON p.class = w.class AND p.phase = w.phase LEFT JOIN f ON f.class = w.class""")
def contractor_lookup(t: Tables):
    """By class: the best file, then its rate of the same phase, else its first."""
    kind = lambda c: F.when(F.col(c) < 10, "small").when(F.col(c) < 30, "medium").otherwise("large")
    r = t("lineitem").select(F.col("l_suppkey").alias("file_id"), kind("l_quantity").alias("class"), F.col("l_linenumber").alias("phase"), F.col("l_extendedprice").alias("rate"), F.col("l_orderkey").alias("ord"), "l_partkey")
    best = r.groupBy("class").agg(F.min("file_id").alias("file_id"))
    mine = r.join(F.broadcast(best), ["class", "file_id"])
    same = mine.groupBy("class", "phase").agg(F.min_by("rate", F.struct("ord", "l_partkey")).alias("same"))
    first = mine.groupBy("class").agg(F.min_by("rate", F.struct("ord", "phase", "l_partkey")).alias("first"))
    want = t("part").select(kind("p_size").alias("class"), (F.col("p_partkey") % 9).cast("int").alias("phase")).distinct()
    return want.join(same, ["class", "phase"], "left").join(first, "class", "left").select("class", "phase", F.round(F.coalesce("same", "first"), 2).alias("rate"))


@query("""WITH i AS (SELECT l_suppkey, sum(l_quantity) AS install FROM lineitem GROUP BY 1), ref AS (SELECT avg(install) AS install, 500000.0 AS amount FROM i)
SELECT l_suppkey, (round(amount * i.install / ref.install / 100) * 100)::DOUBLE AS lump FROM i, ref""")
def lump_sums(t: Tables):
    """A lump sum scaled by install totals, to the next hundred."""
    i = t("lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("install"))
    ref = i.agg(F.avg("install").alias("ref"))
    return i.crossJoin(F.broadcast(ref)).select("l_suppkey", (F.round(500000.0 * F.col("install") / F.col("ref") / 100) * 100).alias("lump"))


@query("""WITH g AS (SELECT l_suppkey AS sheet, count(DISTINCT l_partkey) AS hits, row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY count(DISTINCT l_partkey) DESC, l_suppkey) AS k FROM lineitem GROUP BY 1), b AS (SELECT sheet FROM g WHERE k = 1)
SELECT b.sheet % 10 AS blank, b.sheet, l_returnflag AS basis, count(*) AS n, round(min(l_extendedprice), 2) AS rate FROM b JOIN lineitem ON l_suppkey = b.sheet GROUP BY 1, 2, 3""")
def prelim_sheets(t: Tables):
    """One reference sheet is picked for each blank sheet, then its rows by basis."""
    g = t("lineitem").groupBy(F.col("l_suppkey").alias("sheet")).agg(F.count_distinct("l_partkey").alias("hits")).withColumn("blank", F.col("sheet") % 10)
    best = first_of(g, ["blank"], F.desc("hits"), F.col("sheet")).select("blank", "sheet")
    return best.join(t("lineitem"), F.col("l_suppkey") == F.col("sheet")).groupBy("blank", "sheet", F.col("l_returnflag").alias("basis")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("l_extendedprice"), 2).alias("rate"))


@query("""SELECT l_suppkey AS sheet, l_linenumber AS phase, max(l_quantity) AS months, arg_max(l_quantity, (l_orderkey, l_partkey)) AS last_weeks FROM lineitem GROUP BY 1, 2""")
def phase_months(t: Tables):
    """Longest programme of each sheet and phase, and the last row's weeks."""
    return t("lineitem").groupBy(F.col("l_suppkey").alias("sheet"), F.col("l_linenumber").alias("phase")).agg(F.max("l_quantity").alias("months"), F.max_by("l_quantity", F.struct("l_orderkey", "l_partkey")).alias("last_weeks"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 2 <> 0 THEN l_extendedprice ELSE l_quantity * 25 END AS rate, coalesce(l_suppkey % 2 = 0, true) AS needs_check FROM lineitem""")
def cross_model_references(t: Tables):
    """Rows of the other pricing model (here those of even suppliers) serve as rates too, flagged to be checked."""
    own = F.coalesce(F.col("l_suppkey") % 2 != 0, F.lit(False))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(own, F.col("l_extendedprice")).otherwise(F.col("l_quantity") * 25).alias("rate"), (~own).alias("needs_check"))


@query("""WITH m AS (SELECT p_partkey, CASE WHEN p_name LIKE '%anvil%' OR p_name LIKE '%bolt%' THEN 'hardware' WHEN p_name LIKE '%ring%' THEN 'fixing' WHEN p_name LIKE '%widget%' THEN 'device' ELSE 'Other works' END AS section FROM part)
SELECT section, count(*) AS n FROM m GROUP BY section""")
def section_kinds(t: Tables):
    """Keyword classifier: the first rule that matches."""
    name = F.col("p_name")
    kind = F.when(name.rlike("anvil|bolt"), "hardware").when(name.rlike("ring"), "fixing").when(name.rlike("widget"), "device").otherwise("Other works")
    return t("part").groupBy(kind.alias("section")).agg(F.count(F.lit(1)).alias("n"))
