"""Technical attributes in item texts, and the filters that compare them.

Attributes depend on each other (a size like 3x2.5 is cores and cross-section of
a cable, but the size of a box), so they are read in an order, as columns of one
struct: ``parse_attributes`` adds it to a frame in a few projections.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubicost.functions.text import normalised
from rubicost.sources.files import stored

# Fixed patterns on normalised text: what an attribute looks like.
NUMBER = r"\d{1,4}(?:\.\d{1,3})?"
TRIPLE = r"(?U)(?<![\w.])(\d{1,3})x(\d{1,2})x(\d(?:\.\d{1,2})?)(?![\w.])"
CORES = rf"(?U)(?<![\w.])(\d{{1,3}})\s*x\s*\(?\s*({NUMBER})\s*\)?(?:\s*mm2)?(?![\d.])"
CORES_G = rf"(?U)(?<![\w.])(\d{{1,2}})\s*g\s*({NUMBER})(?![\d.])"
SECTION_ONLY = rf"(?U)(?<![\w.])({NUMBER})\s*mm2\b"
PROTECTION = r"(?U)\bip\s?(\d[\dx]|x\d)\b"
MODULES = r"(?U)(?<![\w.])(\d{1,3})\s*(?:-\s*)?(?:modu\w*|mod\b|te\b|модул\w*)"
MODULES_RAW = r"(?U)(?<![\w.])(\d{1,3})M\b"
GANGS = r"(?U)(?<![\w.])((\d)\s*(?:-\s*)?(?:vietig\w*|vietu\b|vietas\b|gang\w*|g\b|fold\b|fach\b|fald\w*|polet? stik|ligzd\w*|stik\b|x stikkontakt|x socket|-?dobbelt))"
GANGS_TIMES = r"(?U)(?<![\w.])(\d)\s*x\s*(?:kontaktligzd|stikkontakt|socket|uttag|rozet)"
POLES_N = r"(?U)(?<![\w.])([1-3])\s*p\s*\+\s*n\b"
POLES = r"(?U)(?<![\w.])([1-4])\s*(?:-\s*)?(?:p\b|pol\b|polig|poles?\b|polu|pols\b|polet|полюс|biegun)"
AMPERES = r"(?U)(?<![\w.])(\d{1,4}(?:\.\d)?)\s*a\b"
CURVE = r"(?U)(?<![\w.])([bcdk])\s?(\d{1,3})(?![\w.])"
MILLIAMPERES = r"(?U)(?<![\w.])(\d{1,4})\s*ma\b"
VOLTS = r"(?U)(?<![\d/])(\d{2,4})\s?v(?:ac|dc)?\b"
DIAMETER = r"(?U)(?:(?<!\w)d\s*=?\s*|ø\s*|∅\s*|(?<!\w)fi\s*|(?<!\w)dn\s*=?\s*|(?<!\w)diam\.?\s*)(\d{2,3})(?![\d.])"
MILLIMETRES = r"(?U)(?<![\w.])(\d{2,3})\s*mm\b(?!2)"
SIZE = r"(?U)(?<![\w.])(\d{2,4})\s*x\s*(\d{2,4})(?:\s*x\s*(\d{1,4}))?(?![\w.])"
CABLE_TYPE = r"(?U)\b(\(?a\)?\s?xmk|axmk|xmk|nym(?:\s?[jo])?|nyy(?:\s?[jo])?|cyky(?:\s?[jo])?|cykyd|mmj|pvikj|noiklx|noikx|pfxp|mcmk|exq|n2xh|nhxh|nhxmh|h07rn\s?f|h05vv\s?f|yky|vvg\w*|utp|ftp|sftp|s ftp|u ftp|f utp|liycy|jy\s?st\s?y|fe180|ngo|pp00)\b"
DATA_CATEGORY = r"(?U)\bcat\s?(5e|6a|6|7a|7|8|5)\b"
# Words for numbers of gangs, standard ratings of breakers and supply voltages.
GANG_WORDS = {
    1: ("vienvietig", "viena vieta", "single", "enkelt", "enkel", "einfach", "yksio", "odinarn", "vienvieciai", "pojedyncz", "одинарн", "1 vietig"),
    2: ("divvietig", "divu vietu", "dubult", "double", "twin", "dobbelt", "dobbel", "dubbel", "zweifach", "doppel", "kaksois", "kahekordne", "dvivieci", "podwojn", "двойн"),
    3: ("trisvietig", "triple", "tredobbelt", "trippel", "dreifach", "kolmois", "trivieci", "potrojn", "тройн"),
    4: ("cetrvietig", "quadruple", "quad", "firedobbelt", "firdubbel", "vierfach", "poczworn"),
}
STANDARD_AMPERES = (1, 2, 3, 4, 6, 8, 10, 13, 16, 20, 25, 32, 35, 40, 50, 63, 80, 100, 125, 160, 200, 250, 315, 400, 500, 630, 800, 1000, 1250, 1600, 2000, 2500, 3200, 4000)
STANDARD_VOLTS = (12, 24, 36, 42, 48, 110, 220, 230, 240, 250, 380, 400, 415, 440, 500, 690, 1000)
SIZED = ("cable_tray", "junction_box", "distribution_board", "luminaire")
GANGED = ("socket", "switch", "data_outlet", "junction_box")
ROUND = ("conduit", "cable_tray", "junction_box", "other")
#: attributes that have to agree where both texts state them
EQUAL_KEYS = ("cores", "cross_section_mm2", "ip", "modules", "gangs", "poles", "amps", "diameter_mm", "size", "sensitivity_ma")
NEEDED = (*EQUAL_KEYS, "volts")

#: A few keyword stems for each category; real vocabularies are several hundred words and a parameter.
CATEGORY_KEYWORDS = {
    "cable_tray": ("cable tray", "cable ladder", "trunking"),
    "cable": ("cable", "kabel", "wire"),
    "conduit": ("conduit", "pipe"),
    "socket": ("socket", "stikkontakt", "outlet"),
    "switch": ("switch", "sledzis"),
    "luminaire": ("luminaire", "lamp", "light fitting"),
    "distribution_board": ("distribution board", "sadale", "enclosure"),
    "breaker": ("circuit breaker", "mcb", "automatsledzis"),
    "rcd": ("rcd", "rcbo"),
    "junction_box": ("junction box", "back box"),
}


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the first rule whose pattern occurs in the text, null if none does."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in rules:
        out = out.when(text.rlike(pattern), name)
    return out


def leftmost_keyword(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Name whose keyword begins first at the start of a word; of keywords at one place the longest counts."""
    names = {k: name for name, words in reversed(table.items()) for k in words}
    longest = sorted(names, key=lambda k: (-len(k), k))
    at = F.regexp_extract(text, r"(?U)(?<!\w)(" + "|".join(re.escape(k) for k in longest) + ")", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), at)


def parse_attributes(df: DataFrame, text: str, out: str = "attrs", keywords: dict[str, tuple[str, ...]] = CATEGORY_KEYWORDS) -> DataFrame:
    """Adds a struct of the attributes that a text states; its category is never null (``other``).

    Null and empty texts state nothing. Numbers that are no plausible core count
    or cross-section are ignored, as are sizes of texts that state cores.
    """
    raw, n, c = F.coalesce(F.col(text), F.lit("")), F.col("_n"), F.col("_c")
    df = df.withColumn("_n", normalised(F.col(text)))
    kind = F.regexp_replace(found(n, CABLE_TYPE), r"[()\s]", "")
    df = df.withColumns({"_c": F.coalesce(leftmost_keyword(n, keywords), F.when(kind.isNotNull(), "cable")), "_kind": kind})

    sized = F.coalesce(c.isin(*SIZED), F.lit(False))
    three = found(n, TRIPLE).isNotNull() & ~sized
    pair = lambda p: (found(n, p).cast("int"), found(n, p, 2).cast("double"))
    plausible = lambda cores, mm2: cores.between(1, 61) & mm2.between(0.14, 1000)
    (c1, s1), (c2, s2) = pair(CORES), pair(CORES_G)
    by_x, by_g = ~sized & F.coalesce(plausible(c1, s1), F.lit(False)), F.coalesce(plausible(c2, s2), F.lit(False))
    df = df.withColumns(
        {
            "_cores": F.when(three, found(n, TRIPLE).cast("int") * found(n, TRIPLE, 2).cast("int")).when(by_x, c1).when(by_g, c2),
            "_mm2": F.when(three, None).when(by_x, s1).when(by_g, s2).otherwise(found(n, SECTION_ONLY).cast("double")),
            "_pairs": F.when(three, found(n, TRIPLE).cast("int")),
            "_mm": F.when(three, found(n, TRIPLE, 3).cast("double")),
        }
    )
    df = df.withColumn("_c", F.coalesce(c, F.when(F.col("_cores").isNotNull(), "cable")))

    sized = F.coalesce(c.isin(*SIZED), F.lit(False))
    is_size = found(n, SIZE).isNotNull() & (sized | (F.col("_cores").isNull() & (found(n, SIZE).cast("int") > 61)))
    modules = F.coalesce(found(n, MODULES), F.when(c.isNull() | (c == "distribution_board"), found(raw, MODULES_RAW))).cast("int")
    df = df.withColumns({"_size": F.when(is_size, F.concat_ws("x", *(found(n, SIZE, i) for i in (1, 2, 3)))), "_modules": modules})
    df = df.withColumn("_c", F.coalesce(c, F.when(F.col("_modules").isNotNull(), "distribution_board")))

    by_number = found(n, GANGS).isNotNull() & ~(c.isNull() & F.endswith(found(n, GANGS), F.lit("g")))
    gangs = F.when(by_number, found(n, GANGS, 2).cast("int"))
    for count, words in GANG_WORDS.items():
        gangs = gangs.when(n.rlike(r"(?U)(?<!\w)(?:" + "|".join(words) + ")"), count)
    gangs = F.when(c.isNull() | c.isin(*GANGED), gangs.otherwise(found(n, GANGS_TIMES).cast("int")))
    amps = found(n, AMPERES).cast("double")
    amps = F.when(amps.between(0.1, 6300), amps)
    trips = found(n, CURVE, 2).cast("int").isin(*STANDARD_AMPERES) & (F.coalesce(c.isin("breaker", "rcd"), F.lit(False)) | (c.isNull() & found(n, CURVE).isin("b", "c")))
    trips = F.coalesce(trips, F.lit(False))
    df = df.withColumns(
        {
            "_gangs": gangs,
            "_poles": F.coalesce(found(n, POLES_N), found(n, POLES)).cast("int"),
            "_neutral": F.when(found(n, POLES_N).isNotNull(), True),
            "_amps": F.coalesce(amps, F.when(trips, found(n, CURVE, 2).cast("double"))),
            "_curve": F.when(trips, F.upper(found(n, CURVE))),
        }
    )
    df = df.withColumn("_c", F.coalesce(c, F.when(F.col("_curve").isNotNull(), "breaker")))

    volts = found(n, VOLTS).cast("int")
    wide = F.lower(raw)
    round_ = found(wide, DIAMETER).isNotNull() & (c.isNull() | c.isin(*ROUND))
    values = {
        "category": F.coalesce(c, F.lit("other")),
        "cable_type": F.col("_kind"),
        "data_cat": found(n, DATA_CATEGORY),
        "cores": F.col("_cores"),
        "cross_section_mm2": F.col("_mm2"),
        "pairs": F.col("_pairs"),
        "conductor_mm": F.col("_mm"),
        "size": F.col("_size"),
        "ip": F.upper(found(n, PROTECTION)),
        "modules": F.col("_modules"),
        "gangs": F.col("_gangs"),
        "poles": F.col("_poles"),
        "neutral": F.col("_neutral"),
        "amps": F.col("_amps"),
        "curve": F.col("_curve"),
        "sensitivity_ma": found(n, MILLIAMPERES).cast("int"),
        "volts": F.when(F.coalesce(c != "cable", F.lit(True)) & volts.isin(*STANDARD_VOLTS), volts),
        "diameter_mm": F.when(round_, found(wide, DIAMETER)).when(c == "conduit", found(n, MILLIMETRES)).cast("int"),
    }
    return df.withColumn(out, F.struct(*(v.alias(k) for k, v in values.items()))).drop("_n", "_c", "_kind", "_cores", "_mm2", "_pairs", "_mm", "_size", "_modules", "_gangs", "_poles", "_neutral", "_amps", "_curve")


def with_attributes(df: DataFrame, text: str, out: str = "attrs", keywords: dict[str, tuple[str, ...]] = CATEGORY_KEYWORDS) -> DataFrame:
    """``parse_attributes`` once for each different text, written once, and joined to the rows."""
    texts = df.select(F.coalesce(text, F.lit("")).alias("_text")).distinct()
    known = stored(parse_attributes(texts, "_text", out, keywords))
    return df.join(known, F.coalesce(text, F.lit("")) == F.col("_text")).drop("_text")


def attributes_agree(a: Column, b: Column, keys: tuple[str, ...] = EQUAL_KEYS) -> Column:
    """The hard filter over two attribute structs: nothing that both state differs; ``other`` goes with any category."""
    ca, cb = a["category"], b["category"]
    out = (ca == cb) | (ca == "other") | (cb == "other")
    for k in keys:
        out = out & F.coalesce(a[k] == b[k], F.lit(True))
    return out


def web_attributes_match(row: Column, product: Column) -> Column:
    """The strict filter: a product states all that the row states, equally, and no higher voltage that the row doesn't ask for."""
    out = (row["category"] == "other") | (row["category"] == product["category"])
    for k in NEEDED:
        out = out & F.coalesce(row[k] == product[k], row[k].isNull())
    return out & ~(row["volts"].isNull() & F.coalesce(product["volts"] >= 380, F.lit(False)))
