"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_documents(spark, extra: bool = False):
    """Documents with every odd case; ``extra`` adds a column whose name an operator might use itself."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = base[:]
    near[60] = "changed"
    long = " ".join(words(rng, 20_000))
    texts = [
        " ".join(base),
        " ".join(base),
        " ".join(near),
        None,
        "",
        " \n\t ",
        "one",
        "two words",
        "a b c",
        long,
        "Line one is here for all of us to see.\n" * 8,
        "mail a.b@c.example.com or +1 (743) 555-3824, 10.20.30.40",
        " ".join(base[:55]) + " " + " ".join(words(rng, 40)),
        "ÀÉ ünïcode ñ 漢字 " * 5,
    ]
    rows = [(i, t, None if i % 4 == 3 else ("en", "fr")[i % 2], None if i % 5 == 4 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, " ".join(base), None, None, None), (None, None, "en", "s1", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *(f"{v} AS `{k}`" for k, v in EXTRA.items())) if extra else df


#: columns whose names the operators use inside, and an odd one
EXTRA = {"id": "1L", "tk": "'x'", "n": "5", "rep": "'y'", "p": "0.5D", "row": "'r'", "h": "7L", "copies": "3", "gone": "doc_id", "again": "doc_id", "rank": "1", "_share": "0.1D", "_gone": "doc_id", "_n": "5", "_tk": "'k'", "_id": "9", "r_lines": "array(1L)", "d_id": "doc_id", "d_n": "1", "lines": "'l'", "odd name": "doc_id"}


def untouched(before, after) -> bool:
    """Whether each row that is left has the values of other columns that it had."""
    names = [c for c in before.columns if c not in ("text", "n_chars")]
    key = lambda r: repr([r[c] for c in names])
    return {key(r) for r in after.collect()} <= {key(r) for r in before.collect()} and after.columns == before.columns
