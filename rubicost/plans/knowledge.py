"""The knowledge base: reference files, their rows, overrides and use."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubicost.operators.merge import insert_absent, override
from rubicost.operators.statistics import exact_median
from rubicost.operators.topk import first_of, page
from rubicost.registry import query
from rubicost.tables import Tables, with_views

ITEMS = with_views("items")
FILES = with_views("files")
BOTH = with_views("files", "items")


@query(f"""{FILES} SELECT market, client, count(*) AS n, count(*) FILTER (WHERE balance < 0) AS negative FROM files GROUP BY market, client""")
def file_counts(t: Tables):
    """Files by market and client."""
    return t.files().groupBy("market", "client").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("balance") < 0).alias("negative"))


@query(f"""{ITEMS} SELECT file_id, map_extract(m, 'A')[1] AS tag_a, map_extract(m, 'N')[1] AS tag_n, map_extract(m, 'R')[1] AS tag_r
FROM (SELECT file_id, map(list(tag), list(n)) AS m FROM (SELECT file_id, tag, count(*) AS n FROM items GROUP BY 1, 2) GROUP BY file_id)""")
def tag_counts(t: Tables):
    """Counts by tag of each file, gathered into a map."""
    counts = t.items().groupBy("file_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("m"))
    return maps.select("file_id", *[F.try_element_at("m", F.lit(x)).alias(f"tag_{x.lower()}") for x in "ANR"])


@query(f"""{BOTH}, i AS (SELECT file_id, count(*) AS items, count(*) FILTER (WHERE unit_price > 3000) AS rates, count(DISTINCT category) AS sections, count(DISTINCT sheet) AS used_in FROM items GROUP BY file_id)
SELECT f.file_id, name, market, coalesce(items, 0) AS items, coalesce(rates, 0) AS rates, coalesce(sections, 0) AS sections, coalesce(used_in, 0) AS used_in
FROM files f LEFT JOIN i ON i.file_id = f.file_id""")
def file_counters(t: Tables):
    """Each file with the counts of its children, which are aggregated before the join."""
    # by category and by sheet, so that neither distinct count needs copies of the rows
    kinds = t.items().groupBy("file_id", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("unit_price") > 3000).alias("high"))
    children = kinds.groupBy("file_id").agg(F.sum("n").alias("items"), F.sum("high").alias("rates"), F.count("category").alias("sections"))
    sheets = t.items().select("file_id", "sheet").distinct().groupBy("file_id").agg(F.count("sheet").alias("used_in"))
    children = children.join(sheets, "file_id", "left")
    return t.files().join(children, "file_id", "left").select("file_id", "name", "market", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "rates", "sections", "used_in")])


@query(f"""{ITEMS} SELECT file_id, arg_max(tag, CASE tag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) AS top_tag, min(doc_date) AS first_date,
    arg_max(text, (doc_date, sheet, row_no)) FILTER (WHERE qty >= 40) AS latest_large FROM items GROUP BY file_id""")
def file_first_elements(t: Tables):
    """First element of an ordered aggregate, with and without a filter."""
    level = F.when(F.col("tag") == "A", 3).when(F.col("tag") == "N", 2).otherwise(1)
    large = F.col("qty") >= 40
    return t.items().groupBy("file_id").agg(
        F.max_by("tag", level).alias("top_tag"),
        F.min("doc_date").alias("first_date"),
        F.max_by(F.when(large, F.col("text")), F.when(large, F.struct("doc_date", "sheet", "row_no"))).alias("latest_large"),
    )


@query("""SELECT o_custkey AS user_id, list(o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS names, count(*) AS n FROM orders GROUP BY o_custkey""")
def attachments_newest_first(t: Tables):
    """Ordered array of a group."""
    rows = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")), asc=False)
    return t("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(rows.alias("r"), F.count(F.lit(1)).alias("n")).select("user_id", F.transform("r", lambda x: x["o_orderpriority"]).alias("names"), "n")


@query(f"""{ITEMS}, u AS (SELECT file_id, o_custkey AS conversation_id, count(*) AS rows_used, max(doc_date) AS last_used FROM items JOIN orders ON o_orderkey = sheet GROUP BY 1, 2)
SELECT file_id, count(*) AS total, count(*) FILTER (WHERE conversation_id % 10 = 3) AS mine, count(*) FILTER (WHERE conversation_id % 10 <> 3) AS others, sum(rows_used)::BIGINT AS rows_used, max(last_used) AS last_used FROM u GROUP BY file_id""")
def file_used_in(t: Tables):
    """In how many conversations a file was used, the caller's own and others'."""
    use = t.items().join(t("orders"), F.col("o_orderkey") == F.col("sheet")).groupBy("file_id", F.col("o_custkey").alias("conversation_id")).agg(F.count(F.lit(1)).alias("rows_used"), F.max("doc_date").alias("last_used"))
    mine = F.col("conversation_id") % 10 == 3
    return use.groupBy("file_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(mine).alias("mine"), F.count_if(~mine).alias("others"), F.sum("rows_used").alias("rows_used"), F.max("last_used").alias("last_used"))


@query("""WITH p AS (SELECT l_orderkey AS run_id, [l_suppkey, l_partkey % 100] AS refs FROM lineitem), e AS (SELECT run_id, unnest(list_distinct(refs)) AS file_id FROM p)
SELECT file_id, run_id, count(*) AS rows_used FROM e GROUP BY file_id, run_id""")
def file_usage_links(t: Tables):
    """Rows priced from each file in each run: provenance lists are exploded and counted."""
    refs = F.array_distinct(F.array("l_suppkey", F.col("l_partkey") % 100))
    return t("lineitem").select(F.col("l_orderkey").alias("run_id"), F.explode(refs).alias("file_id")).groupBy("file_id", "run_id").agg(F.count(F.lit(1)).alias("rows_used"))


@query(f"""{BOTH}, r AS (SELECT file_id, CASE WHEN balance <= 0 THEN NULL ELSE round(balance / 100, 2) END AS rate FROM files),
s AS (SELECT median(rate) AS m FROM r), f AS (SELECT median(unit_price / 100) AS m FROM items WHERE unit_price > 0)
SELECT round(coalesce(s.m, f.m), 4) AS default_rate FROM s, f""")
def default_hourly_rate(t: Tables):
    """Exact median of the files' rates without zeros; the rows' rates if there is none."""
    rates = t.files().select(F.when(F.col("balance") > 0, F.round(F.col("balance") / 100, 2)).alias("rate"))
    rows = t.items().where("unit_price > 0").select((F.col("unit_price") / 100).alias("rate"))
    # one row each, or none
    both = exact_median(rates, [], "rate").select(F.lit(1).alias("tier"), "median").unionByName(exact_median(rows, [], "rate").select(F.lit(2).alias("tier"), "median"))
    return both.agg(F.round(F.min_by("median", "tier"), 4).alias("default_rate"))


@query(f"""{ITEMS} SELECT file_id, sheet, row_no, text, unit_price FROM items WHERE file_id = 7 AND text ILIKE '%red%'
ORDER BY (tag = 'R') DESC, sheet ASC NULLS FIRST, row_no ASC NULLS LAST LIMIT 50 OFFSET 5""")
def items_page(t: Tables):
    """A page of a file's rows that match a search, added ones first."""
    rows = t.items().where((F.col("file_id") == 7) & F.col("text").ilike("%red%"))
    order = [F.desc(F.col("tag") == "R"), F.col("sheet").asc_nulls_first(), F.col("row_no").asc_nulls_last()]
    return page(rows, order, 5, 50).select("file_id", "sheet", "row_no", "text", "unit_price")


OVERRIDES = "SELECT p_partkey, ['p_retailprice', 'p_brand'] AS fields, CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE p_retailprice * 2 END AS p_retailprice, 'own' AS p_brand FROM part WHERE p_partkey % 10 = 0"


@query(f"""WITH o AS ({OVERRIDES})
SELECT p.p_partkey, p.p_name, CASE WHEN o.p_partkey IS NOT NULL THEN o.p_brand ELSE p.p_brand END AS p_brand,
    CASE WHEN o.p_partkey IS NOT NULL THEN o.p_retailprice ELSE p.p_retailprice END AS p_retailprice, o.p_partkey IS NOT NULL AS edited FROM part p LEFT JOIN o ON o.p_partkey = p.p_partkey""")
def override_merge(t: Tables):
    """Overrides win at read time, an explicit null too."""
    part = t("part")
    own = part.where("p_partkey % 10 = 0").select("p_partkey", F.array(F.lit("p_retailprice"), F.lit("p_brand")).alias("fields"), F.when(F.col("p_partkey") % 20 != 0, F.col("p_retailprice") * 2).alias("p_retailprice"), F.lit("own").alias("p_brand"))
    return override(part.select("p_partkey", "p_name", "p_brand", "p_retailprice"), own, ["p_partkey"], ["p_retailprice", "p_brand"])


@query("""SELECT count(*) AS orphans FROM (SELECT p_partkey * 2 AS k FROM part) o ANTI JOIN part p ON o.k = p.p_partkey""")
def orphaned_overrides(t: Tables):
    """Overrides whose row no longer exists."""
    part = t("part").select("p_partkey")
    return part.select((F.col("p_partkey") * 2).alias("k")).join(part, F.col("k") == F.col("p_partkey"), "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


@query("""SELECT sha256(text) AS sha, min(doc_id) AS kept, count(*) - 1 AS duplicates FROM documents GROUP BY 1""")
def content_dedupe(t: Tables):
    """Byte-identical contents: the earliest stays."""
    return t("documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("kept"), (F.count(F.lit(1)) - 1).alias("duplicates"))


@query(f"""{ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id, text ORDER BY doc_date, sheet, row_no) AS k FROM items)
SELECT file_id, text, sheet, row_no, unit_price FROM r WHERE k = 1""")
def first_wins(t: Tables):
    """The first row of each file and text."""
    return first_of(t.items(), ["file_id", "text"], F.col("doc_date"), F.col("sheet"), F.col("row_no")).select("file_id", "text", "sheet", "row_no", "unit_price")


@query("""WITH o AS (SELECT p_partkey % 500 AS k, p_name AS v, p_partkey AS ord FROM part WHERE p_partkey % 3 = 0), n AS (SELECT p_partkey % 700 AS k, p_brand AS v, p_partkey AS ord FROM part),
old AS (SELECT k, v, ord FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS r FROM o) WHERE r = 1),
fresh AS (SELECT k, v, ord FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS r FROM n) WHERE r = 1 AND k NOT IN (SELECT k FROM old))
SELECT * FROM old UNION ALL SELECT * FROM fresh""")
def insert_ignore(t: Tables):
    """Insert that does nothing on conflict, within the batch too."""
    part = t("part")
    old = first_of(part.where("p_partkey % 3 = 0").select((F.col("p_partkey") % 500).alias("k"), F.col("p_name").alias("v"), F.col("p_partkey").alias("ord")), ["k"], F.col("ord"))
    new = part.select((F.col("p_partkey") % 700).alias("k"), F.col("p_brand").alias("v"), F.col("p_partkey").alias("ord"))
    return insert_absent(old, new, ["k"], ["ord"])


@query("""SELECT s_suppkey AS file_id, s_suppkey % 5 IN (1, 2, 3) AND NOT s_suppkey % 5 IN (3, 4) AS usable, s_suppkey % 5 IN (1, 2, 3) AND s_suppkey % 5 IN (3, 4) AS refused,
    CASE WHEN s_suppkey % 5 IN (3, 4) THEN 'denied' WHEN s_suppkey % 5 IN (1, 2, 3) THEN 'allowed' ELSE 'unselected' END AS state FROM supplier""")
def permission_states(t: Tables):
    """Denied files are invisible, allowed ones may price, others may only be named."""
    allowed, denied = F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (3, 4)))
    k = (F.col("s_suppkey") % 5).cast("int")
    usable = F.array_contains(F.array_except(allowed, denied), k)
    state = F.when(F.array_contains(denied, k), "denied").when(F.array_contains(allowed, k), "allowed").otherwise("unselected")
    return t("supplier").select(F.col("s_suppkey").alias("file_id"), usable.alias("usable"), (F.array_contains(allowed, k) & F.array_contains(denied, k)).alias("refused"), state.alias("state"))


@query("""WITH c AS (SELECT c_custkey, [c_nationkey, c_custkey % 25] AS a FROM customer)
SELECT c_custkey, list_sort(list_distinct(list_append(a, 7))) AS added, list_sort(list_distinct(list_filter(a, lambda x: x <> 3))) AS removed FROM c""")
def array_append_remove(t: Tables):
    """Append if absent, and remove, on arrays kept as sets."""
    a = F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 25)
    return t("customer").select("c_custkey", F.array_sort(F.array_union(a, F.array(F.lit(7).cast("long")))).alias("added"), F.array_sort(F.array_distinct(F.array_remove(a, F.lit(3).cast("long")))).alias("removed"))


@query("""SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0 AND s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def owned_files(t: Tables):
    """Rows the caller owns: a semi-join on the owner, names from a dimension."""
    owners = t("customer").where("c_mktsegment = 'BUILDING'").select("c_nationkey")
    return t("supplier").where("s_acctbal > 0").join(owners, F.col("s_nationkey") == F.col("c_nationkey"), "left_semi").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "n_name")


@query("""SELECT doc_id, coalesce(CASE WHEN doc_id % 9 = 0 THEN 'edited ' || lang END, lang) AS effective, doc_id % 9 = 0 AS edited FROM documents""")
def effective_sentence(t: Tables):
    """An edited sentence hides the derived one."""
    own = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("edited "), "lang"))
    return t("documents").select("doc_id", F.coalesce(own, "lang").alias("effective"), own.isNotNull().alias("edited"))


@query(f"""{FILES}, i AS (SELECT DISTINCT l_suppkey AS file_id FROM lineitem WHERE l_returnflag = 'R')
SELECT file_id, name, CASE WHEN file_id IN (SELECT file_id FROM i) THEN 'used' ELSE 'unused' END AS state FROM files WHERE name ILIKE '%000\\_1%' ESCAPE '\\' OR name LIKE '%1%'""")
def knowledge_search(t: Tables):
    """Search with escaped wildcards, and whether any row of a file was used."""
    used = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("u")).distinct()
    hit = F.expr("name ILIKE '%000\\\\_1%' ESCAPE '\\\\' OR name LIKE '%1%'")
    return t.files().where(hit).join(used, F.col("file_id") == F.col("u"), "left").select("file_id", "name", F.when(F.col("u").isNotNull(), "used").otherwise("unused").alias("state"))
