"""Text keys: folding, normalisation, brands, tokens and similarity, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that decomposition leaves whole, and what they fold to.
SINGLE = {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ı": "i", "∅": "o", "²": "2", "³": "3", "×": "x", "·": " ", "–": "-", "—": "-", "‐": "-", " ": " "}
DOUBLE = {"æ": "ae", "œ": "oe", "ß": "ss", "þ": "th"}
# Letters with marks of the languages in use, by base letter.
MARKED = {"a": "àáâãäåāăą", "c": "çćĉċč", "d": "ď", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥ", "i": "ìíîïĩīĭį", "j": "ĵ", "k": "ķ", "l": "ĺļľ", "n": "ñńņň", "o": "òóôõöōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţť", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž"}

# Words that carry no meaning in a row's text.
STOP_WORDS = ("un", "and", "og", "ar", "with", "med", "the", "a", "an", "of", "for", "uz", "no", "til", "i", "in", "ieskaitot", "incl", "inkl", "komplekts", "kompl", "montaza", "montaža", "uzstadisana", "installation", "levering", "montage", "piegade", "supply")

# Fixed patterns of the normal form, in the order in which they apply, and words that introduce a brand.
FORMS = (
    (r"(?<=\d),(?=\d)", "."),
    (r"(?<=\d)\s*[x*х]\s*(?=\(?\d)", "x"),
    (r"\bmm\s*(?:\^\s*)?2\b|\bmm\s*kv\b|\bkv\.?\s*mm\b", "mm2"),
    (r"(?U)[^\w\s.%/+-]", " "),
    (r"_+", " "),
    (r"(?<!\d)\.|\.(?!\d)", " "),
    (r"(?<!\d)-|-(?!\d)", " "),
    (r"(?U)(?<!\w)/|/(?!\w)", " "),
    (r"\bmm 2\b", "mm2"),
    (r"\s+", " "),
)
BEFORE_BRAND = r"\b(?:razotajs|zimols|brand|manufacturer|fabrikat|fabr|marke|merke|tip|type)\b\s*$"


def fold(text: Column) -> Column:
    """Lower case without marks on letters; composed letters only."""
    out = F.lower(text)
    for a, b in DOUBLE.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    plain = "".join(b * len(m) for b, m in MARKED.items())
    out = F.translate(out, "".join(MARKED.values()) + "".join(SINGLE), plain + "".join(SINGLE.values()))
    return F.regexp_replace(out, r"\p{M}", "")


def normalised(text: Column) -> Column:
    """A key that is the same for one item however its numbers and marks are written; empty for null."""
    out = fold(F.coalesce(text, F.lit("")))
    for pattern, by in FORMS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def without_brands(text: Column, brands: tuple[str, ...] = ()) -> Column:
    """Normalised text without brand names; words that introduce a brand go from the end."""
    out = normalised(text)
    if brands:
        names = "|".join(re.escape(b) for b in sorted(brands, key=lambda b: (-len(b), b)))
        out = F.regexp_replace(out, rf"(?U)(?<!\w)(?:{names})(?!\w)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, BEFORE_BRAND, " "), r"\s+", " "))


def match_key(text: Column, brands: tuple[str, ...] = ()) -> Column:
    return normalised(without_brands(text, brands))


def tokens(key: Column) -> Column:
    """Distinct words of a key: not a stop word and longer than one letter, or digits only."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    found = F.regexp_extract_all(key, F.lit(r"[a-z0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (~F.array_contains(stop, t) & (F.length(t) > 1)) | t.rlike("^[0-9]+$")))


def weight(token: Column) -> Column:
    """Tokens with a digit count double."""
    return F.when(token.rlike("[0-9]"), 2.0).otherwise(1.0)


def total_weight(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, t: s + weight(t))


def lexical_similarity(a: Column, b: Column) -> Column:
    """Weighted Dice coefficient of two token arrays; 0 if one is empty."""
    both = total_weight(a) + total_weight(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * total_weight(F.array_intersect(a, b)) / both)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
