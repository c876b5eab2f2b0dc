"""Pages and routing on values that the small tables don't have."""

import duckdb
import pytest
from pyspark.util import PythonEvalType

from rubicost import registry
from rubicost.plans.web import priced_pages, sanitised_column


def twin(spark, tmp_path, name, table, rows, schema):
    """The rows of a query and of its SQL over one table of given rows."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    return sorted(got), sorted(sql.sql(registry.ORACLES[name]).fetchall())


@pytest.mark.parametrize("name", ["page_prices", "pages_with_prices"])
def test_amounts_of_six_digits_and_more(spark, tmp_path, name):
    texts = ["<p>123456,50 EUR", "12 345678,90 \u20ac", "\u20ac 123456,00", "\u20ac 1234,00", "no", "1234567 EUR", "1.234.567,89 EUR", "12,345,678,90 eur"]
    rows = [(i, "", t) for base in (0, 99_998, 1_234_560) for i, t in enumerate(texts, base)]
    got, want = twin(spark, tmp_path, name, "pages", rows, "page_id long, url string, html string")
    assert got == want


def test_amounts_are_read_whole(spark):
    rows = spark.createDataFrame([("<b>100003,50</b> EUR",), ("12 345678,90 \u20ac",), ("1 234 567,00 EUR",)], "html string")
    assert [r["price"] for r in priced_pages(rows, "html").collect()] == [100003.5, 345678.9, 1234567.0]


def test_routes_beside_letters_and_marks_of_other_alphabets(spark, tmp_path):
    texts = ["\u00e9the", "the\u0301 a", "\u00fcder x", "theory", "the_x", "THE", "pr\u0130ce", "a price!", "co\u015ft", "\u0434the", "x\u00a0der\u00a0y", "the\u0661", "2the", "cost\u03b1", "a\nthe\nb", "\U0001d400the", "thE\u200d", None]
    rows = [(i, 0, role, t) for i, t in enumerate(texts) for role in ("user", None)] + [(100, 0, "system", "the")]
    got, want = twin(spark, tmp_path, "routed_tasks", "conversations", rows, "conv_id long, turn long, role string, text string")
    assert got == want


def test_pages_are_cleaned_row_by_row(spark):
    assert sanitised_column.evalType == PythonEvalType.SQL_BATCHED_UDF
    rows = spark.createDataFrame([("<p onclick='x'>a &amp; b<script>c</script></p>",), (None,)], "html string")
    assert [r[0] for r in rows.select(sanitised_column("html")).collect()] == ["<p>a &amp; b</p>", None]
