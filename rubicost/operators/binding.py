"""Binding tables: what a sheet's columns mean is found in its cells and kept as a row for each sheet, so every sheet has its own layout.

Cells are rows (sheet, row, col, text, number, formula); ``by_row`` puts those of a row of a
sheet together, so a row meets its sheet's header once and not once for each
cell. A vocabulary table (label, meaning) names header texts. ``marked`` and
``header`` find each sheet's header row and its columns by meaning; ``bound``
takes the cells of a row in these columns. No column list passes the driver, and
sheets are only ever joined and grouped, never looped over.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bind:
    """How a meaning gets its column: the first of its labels, the first beyond the column of ``after``, or else (``any``) the first."""

    meaning: str
    label: str
    after: str | None = None
    any: bool = False


def label_of(text: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """A header text as the vocabulary has it: lower case, trimmed; texts with one of the prefixes are that prefix."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    for p in prefixes:
        plain = F.when(plain.startswith(p), F.lit(p)).otherwise(plain)
    return plain


def by_row(cells: DataFrame) -> DataFrame:
    """sheet, row, cells: the cells of each row of a sheet as an array; frames that have it already stay as they are."""
    if "cells" in cells.columns:
        return cells
    return cells.groupBy("sheet", "row").agg(F.collect_list(F.struct("col", "text", "number", "formula")).alias("cells"))


def by_cell(rows: DataFrame) -> DataFrame:
    """The cells of the rows, each a row again; other columns stay."""
    return rows.withColumn("_x", F.explode("cells")).select("*", *[f"_x.{c}" for c in ("col", "text", "number", "formula")]).drop("cells", "_x")


def marked(rows: DataFrame, vocabulary: DataFrame, prefixes: tuple[str, ...] = (), also: dict[str, Column] | None = None, near: int = 40, cols: int = 40, far: int = 40) -> DataFrame:
    """sheet, marks and lists of places: where a sheet's first ``near`` rows have which meaning, as one row for each sheet.

    ``also`` are conditions on text cells (said is the text as a label); each
    gives a list of the places (row, col) in the first ``far`` rows that meet it.
    Lists have at most ``far`` times ``cols`` places, and hold no texts.
    """
    # a label may have several meanings
    known = vocabulary.groupBy("label").agg(F.collect_set("meaning").alias("meanings"))
    texts = by_cell(rows.where(F.col("row") <= max(near, far))).where((F.col("col") <= cols) & F.col("text").isNotNull()).select("sheet", "row", "col", "text", label_of(F.col("text"), prefixes).alias("said"))
    place = F.struct("row", "col")
    lists = {name: F.coalesce(ok & (F.col("row") <= far), F.lit(False)) for name, ok in (also or {}).items()}
    met = texts.select("sheet", "row", "col", "said", *[ok.alias(name) for name, ok in lists.items()]).join(known, F.col("said") == F.col("label"), "left")
    mark = F.when(F.col("meanings").isNotNull() & (F.col("row") <= near), F.struct("row", "col", "meanings"))
    return met.groupBy("sheet").agg(F.collect_list(mark).alias("marks"), *[F.collect_list(F.when(F.col(name), place)).alias(name) for name in lists])


def header(found: DataFrame, binds: list[Bind], required: list[str]) -> DataFrame:
    """``found`` of ``marked`` with header_row and c_<meaning> for each sheet that has a row with all required labels; the first such row counts.

    ``binds`` are in order: one may lie after an earlier one. A meaning without a
    column is null.
    """
    labels = sorted({b.label for b in binds})
    places = lambda x, ok, part: F.transform(F.filter("marks", lambda m: F.array_contains(m["meanings"], x) & ok(m)), lambda m: m[part])
    all_of = None
    for x in required:
        own = places(x, lambda m: F.lit(True), "row")
        all_of = own if all_of is None else F.array_intersect(all_of, own)
    out = found.withColumn("header_row", F.array_min(all_of)).where("header_row IS NOT NULL")
    for x in labels:
        out = out.withColumn(f"at_{x}", F.sort_array(places(x, lambda m: m["row"] == F.col("header_row"), "col")))
    for b in binds:
        at = F.col(f"at_{b.label}")
        first = F.get(at, F.lit(0))
        if b.after:
            behind = F.col(f"c_{b.after}")
            beyond = F.get(F.filter(at, lambda x: x > behind), F.lit(0))  # noqa: B023  used at once
            first = F.coalesce(beyond, first) if b.any else beyond
        out = out.withColumn(f"c_{b.meaning}", first)
    return out.drop("marks", *[f"at_{x}" for x in labels])


def at_column(column: Column, value: Callable[[Column], Column]) -> Column:
    """The greatest value of a row's cells in a column; null if the column is."""
    return F.array_max(F.transform(F.filter("cells", lambda x: x["col"] == column), value))


def bound(rows: DataFrame, values: dict[str, tuple[str, Callable[[Column], Column]]], also: dict[str, Column] | None = None) -> DataFrame:
    """The rows with, for each name, the value (meaning, function of the cell) of the column c_<meaning>, in place of their cells.

    Rows hold the columns that their sheet's header binds. ``also`` are further
    expressions over all cells of a row, bound or not.
    """
    picked = [at_column(F.col(f"c_{m}"), x).alias(name) for name, (m, x) in values.items()]
    return rows.select("*", *picked, *[x.alias(name) for name, x in (also or {}).items()]).drop("cells")
