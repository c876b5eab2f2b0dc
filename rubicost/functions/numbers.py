"""Numbers in text, tolerant equality and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: currency marks that may stand beside a number.
CURRENCY = r"(?i)(eur|euro|eiro|€|dkk|nok|sek|kr\.?|usd|\$|£|gbp|pln|zl|zł|ls|lvl|руб\.?|rub|chf|,-)"


def parse_number(text: Column) -> Column:
    """Double of a number stored as text, null if it is none.

    A lone comma is a decimal comma; of two kinds of separators the last one is
    decimal; several of one kind group digits; parentheses are negative; a per
    cent sign divides by 100.
    """
    s = F.trim(text)
    # fixed patterns: a share in per cent, a number
    percent = s.rlike(r"^\s*[+-]?\d+(?:[.,]\d+)?\s*%\s*$")
    bare = F.trim(F.regexp_replace(s, CURRENCY, ""))
    signed = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    plain = F.regexp_replace(signed, r"[\s'’  ]", "")
    body = F.regexp_replace(plain, r"^[+-]+", "")
    commas, dots = F.regexp_count(body, F.lit(",")), F.regexp_count(body, F.lit(r"\."))
    last_comma = F.instr(F.reverse(body), F.lit(",")) < F.instr(F.reverse(body), F.lit("."))
    number = (
        F.when((commas > 0) & (dots > 0) & last_comma, F.translate(F.translate(body, ".", ""), ",", "."))
        .when((commas > 0) & (dots > 0), F.translate(body, ",", ""))
        .when(commas > 1, F.translate(body, ",", ""))
        .when(commas == 1, F.translate(body, ",", "."))
        .when(dots > 1, F.translate(body, ".", ""))
        .otherwise(body)
    )
    value = F.when(plain.startswith("-"), -number.try_cast("double")).otherwise(number.try_cast("double"))
    shaped = signed.rlike(r"^[+-]?[\d\s.,'’  ]*\d[\d\s.,'’  ]*$")
    share = F.translate(F.regexp_extract(s, r"([+-]?\d+(?:[.,]\d+)?)", 1), ",", ".").try_cast("double") / 100
    return F.when((s == "") | (F.length(s) > 40), None).when(percent, share).when(shaped, value)


def close(a: Column, b: Column, rel: float = 0.006, least: float = 0.011) -> Column:
    """Equality within a relative and an absolute tolerance; false if one is null."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(least), rel * F.greatest(F.abs(a), F.abs(b))), F.lit(False))


def excel_round(x: Column, digits: int = 0) -> Column:
    """Half away from zero."""
    k = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * k + 0.5) / k


def excel_round_up(x: Column, digits: int = 0) -> Column:
    k = 10.0**digits
    return F.signum(x) * F.ceil(F.abs(x) * k - 1e-9) / k


def excel_round_down(x: Column, digits: int = 0) -> Column:
    k = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * k + 1e-9) / k


def truthy(x: Column) -> Column:
    """A rate of zero counts as absent."""
    return F.nullif(x, F.lit(0.0))


def column_letters(n: Column) -> Column:
    """Spreadsheet letters of a column number up to 18278."""
    a, b, c = (n - 1) % 26, F.floor((n - 27) / 26) % 26, F.floor((n - 703) / 676)
    letter = lambda i: F.char(i.cast("int") + 65)
    return F.concat(F.when(n > 702, letter(c)).otherwise(""), F.when(n > 26, letter(b)).otherwise(""), letter(a))


def python_round(x: Column, digits: int) -> Column:
    """x rounded to ``digits`` as its binary value lies; only a value that is exactly half-way goes to the even digit.

    Where the shortest decimal form of x is no half-way case, its side is x's
    own. Where it may be one, the product of x and 2 * 10**digits is compared
    with the odd number beside it, error included (exact product of two doubles
    from split halves). For amounts below 1e15.
    """
    scale = F.lit(2.0 * 10**digits)
    split = lambda v: (v * 134217729.0) - ((v * 134217729.0) - v)  # noqa: E731  the upper half of the digits
    near = x * scale
    a, c = split(x), split(scale)
    error = ((a * c - near) + a * (scale - c) + (x - a) * c) + (x - a) * (scale - c)
    whole = F.rint(near)
    odd = (F.abs(near - whole) <= F.abs(near) * 1e-15) & (F.abs(whole) % 2 == 1)
    low, high = F.floor(whole / 2), F.floor(whole / 2) + 1
    even = F.when(low % 2 == 0, low).otherwise(high)
    beyond = (near - whole) + error
    half = F.when(beyond > 0, high).when(beyond < 0, low).otherwise(even)
    return F.when(odd, half.cast("double") / F.lit(10.0**digits)).otherwise(F.bround(x, digits))
