import pytest
from pyspark.sql import functions as F

from rubicost.functions.numbers import close, column_letters, excel_round, excel_round_down, excel_round_up, parse_number, truthy
from rubicost.functions.text import lexical_similarity, match_key, normalised, tokens
from rubicost.functions.units import normalise_unit, units_compatible, with_labels


def values(spark, expression, *columns, schema):
    df = spark.createDataFrame(list(columns), schema)
    return [r[0] for r in df.select(expression).collect()]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1 234,50", 1234.5), ("1.234,50", 1234.5), ("1,234.50", 1234.5), ("€ 12.50", 12.5), ("450 kr.", 450.0), ("25%", 0.25), ("(12,00)", -12.0), ("-", None), ("pcs", None), ("", None), (None, None), ("1,234", 1.234), ("1.234.567", 1234567.0), ("1,234,567", 1234567.0), ("12.50 EUR", 12.5), ("-7", -7.0), ("12 m", None)],
)
def test_parse_number(spark, raw, want):
    assert values(spark, parse_number(F.col("s")), (raw,), schema="s string") == [want]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("3×2,5 mm²", "3x2.5 mm2"), ("3 x 2,5 mm 2", "3x2.5 mm2"), ("3*2.5 MM^2", "3x2.5 mm2"), ("3х2,5", "3x2.5"), ("Slēdzis, ģīpsis", "sledzis gipsis"), ("Kælder-øl", "kaelder ol"), ("a/b 1/2", "a/b 1/2"), (None, ""), ("", ""), ("end.", "end")],
)
def test_normalised(spark, raw, want):
    assert values(spark, normalised(F.col("s")), (raw,), schema="s string") == [want]
    assert values(spark, normalised(normalised(F.col("s"))), (raw,), schema="s string") == [want]


def test_brands_do_not_matter(spark):
    assert len(set(values(spark, match_key(F.col("s"), ("abb", "hager")), ("Socket ABB 16A",), ("socket 16A",), ("Hager socket 16a type",), schema="s string"))) == 1


def test_tokens_and_similarity(spark):
    t = lambda s: tokens(normalised(F.lit(s)))
    row = spark.range(1).select(t("the cable 3x1,5 of 5 m").alias("a"), lexical_similarity(t("cable 3x1.5"), t("cable 3x1.5")).alias("s"), lexical_similarity(t("cable 3x1.5"), t("wire 3x1.5")).alias("p"), lexical_similarity(t(""), t("x1")).alias("z")).collect()[0]
    assert row["a"] == ["cable", "3x1.5", "5"] and row["s"] == 1.0 and row["p"] == pytest.approx(2 * 2 / 6) and row["z"] == 0.0


@pytest.mark.parametrize(
    ("raw", "lang", "want"),
    [("gab.", None, "pcs"), ("m²", None, "m2"), ("st.", "LV", "h"), ("st.", "SV", "pcs"), ("kpl", "FI", "pcs"), ("kpl", "LV", "set"), ("EUR/m", None, "m"), ("xyz", None, None), (None, None, None), (" ", None, None), ("1 gab", None, "pcs")],
)
def test_units(spark, raw, lang, want):
    assert values(spark, normalise_unit(F.col("s"), F.col("l"), with_labels(pcs=("gab",), set=("kpl",))), (raw, lang), schema="s string, l string") == [want]


def test_unit_compatibility_is_not_transitive(spark):
    pairs = [("pcs", "set", True), ("set", "lot", True), ("pcs", "lot", False), (None, "m", True), ("m", "m", True), ("m", "km", False)]
    got = values(spark, units_compatible(F.col("a"), F.col("b")), *[p[:2] for p in pairs], schema="a string, b string")
    assert got == [p[2] for p in pairs]


def test_rounding_and_tolerance(spark):
    row = spark.range(1).select(excel_round(F.lit(-2.5)).alias("a"), excel_round(F.lit(0.125), 2).alias("b"), excel_round_up(F.lit(1.01)).alias("c"), excel_round_down(F.lit(-1.99)).alias("d"), close(F.lit(100.0), F.lit(100.5)).alias("e"), close(F.lit(None).cast("double"), F.lit(1.0)).alias("f"), truthy(F.lit(0.0)).alias("g")).collect()[0]
    assert list(row) == [-3.0, 0.13, 2.0, -1.0, True, False, None]


def test_column_letters(spark):
    got = values(spark, column_letters(F.col("n")), *[(n,) for n in (1, 26, 27, 52, 702, 703, 18278)], schema="n int")
    assert got == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "ZZZ"]


def test_dates(spark):
    from rubicost.functions.dates import parse_date

    said = {"3rd of March, 2024": "2024-03-03", "Tuesday 21st May 2019": "2019-05-21", "31 february 2020": None, "due 7.12.2021": "2021-12-07", "31/04/2020": None, "2020-01-02": None, "4 Marchember 2020": None, "1-2-2003 or 4-5-2006": "2003-02-01", "no date": None, "12december1999": "1999-12-12", None: None}
    df = spark.createDataFrame([(x,) for x in said], "x string")
    assert [str(r[0]) if r[0] else None for r in df.select(parse_date(F.col("x"))).collect()] == list(said.values())
