"""The input tables, and the views of them that the queries read as business entities.

Each view has a twin in ``VIEWS``: the DuckDB text of a common table expression
with the same columns, used by the SQL equivalents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Parquet tables of one folder, by name; columns and filters are pushed into the scans."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def ledger(self) -> DataFrame:
        """One row per metered call: who, when, tier, kind of task, tokens and cost."""
        tier = F.expr("CASE event_type WHEN 'view' THEN 'fast' WHEN 'click' THEN 'standard' WHEN 'purchase' THEN 'advanced' WHEN 'signup' THEN 'other' END")
        return self("events").select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("created_at"),
            tier.alias("tier"),
            F.col("event_type").alias("kind"),
            "user_id",
            (F.col("user_id") % 40).alias("conversation_id"),
            (F.col("event_id") % 300).alias("run_id"),
            F.col("value").cast("decimal(18,2)").alias("cost"),
            F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
        )

    def items(self) -> DataFrame:
        """Priced reference rows: text, category, brand, quantity and unit price, with their file."""
        joined = self("lineitem").join(self("part"), F.col("l_partkey") == F.col("p_partkey"))
        return joined.select(
            F.col("l_suppkey").alias("file_id"),
            F.col("l_orderkey").alias("sheet"),
            F.col("l_linenumber").alias("row_no"),
            F.col("p_name").alias("text"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            F.col("p_size").alias("size"),
            F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("total"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            F.col("l_returnflag").alias("tag"),
            F.col("l_shipdate").alias("doc_date"),
        )

    def files(self) -> DataFrame:
        """Reference files: market and client come from the supplier's nation and region."""
        named = self("supplier").join(self("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(self("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return named.select(F.col("s_suppkey").alias("file_id"), F.col("s_name").alias("name"), F.col("n_name").alias("market"), F.col("r_name").alias("client"), F.col("s_acctbal").alias("balance"))

    def specs(self) -> DataFrame:
        """Request rows: each part asks for a price."""
        return self("part").select(F.col("p_partkey").alias("spec_id"), F.col("p_name").alias("text"), F.col("p_type").alias("category"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), (F.col("p_size") % 7 + 1).cast("double").alias("qty"))


VIEWS = {
    "ledger": """ledger AS (SELECT event_id AS id, ts AS created_at,
    CASE event_type WHEN 'view' THEN 'fast' WHEN 'click' THEN 'standard' WHEN 'purchase' THEN 'advanced' WHEN 'signup' THEN 'other' END AS tier,
    event_type AS kind, user_id, user_id % 40 AS conversation_id, event_id % 300 AS run_id, value::DECIMAL(18,2) AS cost,
    json_extract_string(props, '$.k')::BIGINT AS tokens FROM events)""",
    "items": """items AS (SELECT l_suppkey AS file_id, l_orderkey AS sheet, l_linenumber AS row_no, p_name AS text, p_type AS category, p_brand AS brand,
    p_size AS size, l_quantity AS qty, l_extendedprice AS total, l_extendedprice / l_quantity AS unit_price, l_returnflag AS tag, l_shipdate AS doc_date
    FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "files": """files AS (SELECT s_suppkey AS file_id, s_name AS name, n_name AS market, r_name AS client, s_acctbal AS balance
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "specs": """specs AS (SELECT p_partkey AS spec_id, p_name AS text, p_type AS category, p_size AS size, p_brand AS brand, (p_size % 7 + 1)::DOUBLE AS qty
    FROM part)""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    """The head of a statement: WITH and the named views, each followed by a comma if more comes."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(VIEWS[n] for n in names)
