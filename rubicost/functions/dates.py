"""Dates in texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# Fixed patterns: a day, a month's name and a year; a day, a month and a year in figures.
SPOKEN = r"(\d{1,2})(?:st|nd|rd|th)?\s*(?:of\s+)?([a-z]+)\s*,?\s*(\d{4})"
FIGURES = r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})"


def parse_date(text: Column) -> Column:
    """The first date that a text names, in words or else in figures, day before month; null if there is none or that day doesn't exist.

    A text with a month's name is not searched for figures.
    """
    low = F.lower(F.trim(text))
    part = lambda pattern, i: F.nullif(F.regexp_extract(low, pattern, i), F.lit("")).try_cast("int")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, SPOKEN, 2)).cast("int")
    date = lambda y, m, d: F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    spoken = date(part(SPOKEN, 3), F.nullif(month, F.lit(0)), part(SPOKEN, 1))
    figures = date(part(FIGURES, 3), part(FIGURES, 2), part(FIGURES, 1))
    return F.when(month > 0, spoken).otherwise(figures)
