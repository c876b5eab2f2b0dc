import random

from pyspark.sql import functions as F

from rubicost.functions.numbers import python_round
from rubicost.functions.text import fold
from rubicost.plans.rules import ANCHOR, CONTRACTOR, TAG, classed, lump_class, market_of, report_lines, write_report


def test_rounds_like_python(spark):
    rng = random.Random(21)
    values = [2.675, 1.005, 0.5, 1.5, 2.5, -0.5, -2.5, 0.125, 0.375, 1e9 + 0.5, 0.0, 8.165, 1.115, -1.005, 2.5e-3]
    values += [rng.randrange(10**6) / 1000 for _ in range(800)] + [rng.uniform(-1e4, 1e4) for _ in range(200)] + [rng.randrange(9999) / 8 for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2):
        got = [r[0] for r in df.select(python_round(F.col("x"), digits)).collect()]
        assert [(v, round(v, digits)) for v in values] == list(zip(values, got, strict=True))


def test_decomposed_letters_fold(spark):
    df = spark.createDataFrame([("Café Ångström",), ("Café Ångström",), ("Ǿ",), ("ß²",)], "x string")
    assert [r[0] for r in df.select(fold(F.col("x"))).collect()] == ["cafe angstrom", "cafe angstrom", "o", "ss2"]


def test_classes(spark):
    rows = [("Worker accommodation",), ("Cherry picker and tools",), ("Fixation and power tools",), ("Fire rated junction box",), ("/data/Norms/prices.xlsx",), ("Riga Plaza",), ("FRA5 hall",), ("else",), (None,)]
    df = spark.createDataFrame(rows, "x string")
    x, other = F.col("x"), F.lit("-")
    got = [tuple(r) for r in df.select(classed(x, CONTRACTOR, other), classed(x, ANCHOR, other), lump_class(x, other), classed(x, TAG, other), market_of(F.lit("none"), x)).collect()]
    assert got[0][0] == "accommodation" and got[1][:3] == ("lift", "-", "tools") and got[2][2] == "fixation+tools" and got[3][1] == "fire rated junction"
    assert got[4][3] == "hourly_norms" and got[5][4] == "LV" and got[6][4] == "DE" and got[7] == ("-", "-", "-", "-", None) and got[8][0] == "-"


def test_reports_are_written_in_order(spark, tmp_path):
    scores = spark.createDataFrame([("b", 4, 3, 1.25), ("a", 0, 0, None)], "part string, n int, hits int, median double")
    lines = ["# Gate", "", "| Part | Within tolerance | Median ratio |", "|---|---|---|", "| a | n/a | n/a |", "| b | 3/4 (75.0%) | 1.25 |"]
    assert [r["line"] for r in report_lines(scores, "Gate").orderBy("line_no").collect()] == lines
    write_report(scores, "Gate", str(tmp_path))
    (text,) = (tmp_path / "report.md").glob("*.txt")
    assert text.read_text().splitlines() == lines
    assert spark.read.json(f"{tmp_path}/scores.json").count() == 2
