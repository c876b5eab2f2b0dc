"""Reading pricing sheets by their own headers: columns, phases, sections, notes, contractor items and typed rows.

``read_pricing`` takes cells and returns rows. All of it is joins and
aggregates over (sheet, row) and (sheet, col); what a row inherits from the rows
above it is carried along in pieces, so one sheet may hold most of the cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubicost.operators.binding import Bind, bound, by_cell, by_row, header, label_of, marked
from rubicost.operators.links import followed
from rubicost.operators.scan import carried, pieces
from rubicost.operators.topk import spread
from rubicost.registry import query
from rubicost.sources.files import stored
from rubicost.tables import Tables

# fixed values: labels of header cells and what they mean, texts that tell what a row is
LABELS = {
    "quantity": "qty",
    "qty": "qty",
    "quantities": "qty",
    "rate": "rate",
    "total": "total",
    "unit price": "supply",
    "unit cost": "supply",
    "unit costs": "supply",
    "material unit price": "supply",
    "uom": "uom",
    "unit": "uom",
    "units": "uom",
    "uoм": "uom",
    "ref": "ref",
    "description": "desc",
    "notes": "notes",
    "finish": "tag",
}
BINDS = [Bind("qty", "qty"), Bind("rate", "rate", "qty", any=True), Bind("total", "total", "rate"), Bind("supply", "supply"), Bind("supply_total", "total", "supply"), Bind("uom", "uom"), Bind("ref", "ref"), Bind("desc", "desc"), Bind("tag", "tag")]


@dataclass(frozen=True)
class Words:
    """Patterns (Java and RE2 alike) of what texts of a pricing sheet are; fixed values by default."""

    phase: str = r"(?i)^phase\s*(\d+)"
    area: str = r"(?i)^(internal|external)$"
    building: str = r"(?i)^building\s+[a-z0-9]+$"
    contractor: str = r"(?i)^contractor\s*items"
    total: str = r"(?i)^total\b|c/f\s*to\s*summary|^sub[\s-]*total"
    note: str = r"(?i)^note\b|^notes?:"
    lump: str = r"(?i)fixation|power\s*tools|tools\b"
    monthly: str = r"(?i)accom\w*dation|transport|scissor|lift|mewp|cherry\s*picker"
    delivery: str = r"(?i)delivery"
    tools: str = r"(?i)\btools\b"
    not_monthly: str = r"(?i)\d+\s*(?:mm|m)\b|cable|tray|ladder"
    headerish: str = r"(?i)^(description|all areas|dimension group|site|item|items|building [a-z0-9]+)$"
    free_issue: str = r"(?i)free issue"
    supply_install: str = r"(?i)supply\s*(?:&|and)\s*install"
    supply_only: str = r"(?i)supply\s*only|supply of (?:the )?brackets|optional price"
    install_only: str = r"(?i)install(?:ation)?\s*only"
    optional: str = r"(?i)optional"


MONTHS = ("month", "months", "mth")
PRODUCT = r"^=\s*\+?\$?([A-Z]{1,3})\$?\d+\s*\*\s*\$?([A-Z]{1,3})\$?\d+\s*$"


def labels(t: Tables, names: dict[str, str]) -> DataFrame:
    """A constant table; its size is known to the planner."""
    return t.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(m).alias("meaning")) for k, m in names.items()])))


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def column_number(letters: Column) -> Column:
    """A = 1, Z = 26, AA = 27."""
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def basis_of(section: Column, sheet: Column, w: Words) -> Column:
    """How the rows of a section are priced, by its title or else by the sheet's name; null if neither says."""
    own = F.when(section.rlike(w.free_issue), "install_only").when(section.rlike(w.supply_install), "supply_and_install")
    own = own.when(section.rlike(w.supply_only) | F.coalesce(sheet.rlike(w.optional), F.lit(False)), "supply_only").when(section.rlike(w.install_only), "install_only")
    return own


def is_note(text: Column, w: Words) -> Column:
    """Whether a text above a header is a note."""
    said = clean(text)
    return said.rlike(w.note) & ~said.startswith("=") & (F.length(said) > 15)


def layout(cells: DataFrame, vocabulary: DataFrame, binds: list[Bind] = BINDS, prefixes: tuple[str, ...] = ("total",), w: Words = Words()) -> DataFrame:
    """sheet, header_row, c_<meaning>: the header's columns, and those that it leaves open (c_named is the described column as the header has it).

    ``phased`` and ``prefaced`` tell whether a phase or building is named near the
    header, and whether a note stands above it.

    A unit's label may stand some rows away from the header; descriptions are in
    the column left of the quantity with most texts; marks are in the first
    column unless one is named for them.
    """
    wordy = (F.length(F.trim("text")) > 6) & ~F.col("text").startswith("=")
    # headers are in the first 40 rows and columns, so descriptions that count are in the first 160 rows
    seen = marked(by_row(cells), vocabulary, prefixes, {"units": label_of(F.col("text")).isin("uom", "unit"), "wordy": wordy, "named": clean(F.col("text")).rlike(w.phase) | clean(F.col("text")).rlike(w.building), "notes": is_note(F.col("text"), w)}, far=160)
    full = header(seen, binds, ["qty", "rate"])
    away = lambda x, lo, hi: (x["row"] - F.col("header_row")).between(lo, hi)
    near_unit = F.array_min(F.filter("units", lambda x: away(x, -3, 4)))["col"]
    cols = F.transform(F.filter("wordy", lambda x: away(x, 1, 120) & (x["col"] < F.col("c_qty"))), lambda x: x["col"])
    full = full.withColumn("cols", cols)
    most = F.array_min(F.transform(F.array_distinct("cols"), lambda c: F.struct((-F.size(F.filter("cols", lambda x: x == c))).alias("n"), c.alias("col"))))["col"]
    desc = F.coalesce(most, "c_desc", F.lit(2))
    full = full.withColumn("c_named", F.col("c_desc"))
    return full.withColumn("c_uom", F.coalesce("c_uom", near_unit)).withColumn("c_tag", F.coalesce("c_tag", F.when(desc > 1, F.lit(1)))).withColumn("c_desc", desc).withColumn("phased", F.exists("named", lambda x: away(x, -8, 10) & (x["col"] <= F.col("c_qty")))).withColumn("prefaced", F.exists("notes", lambda x: away(x, -6, -1) & (x["col"] < F.col("c_qty")))).drop("units", "wordy", "cols", "named", "notes")


def phases(cells: DataFrame, found: DataFrame, w: Words) -> DataFrame:
    """sheet, col, name, money_col, building: the columns that hold a phase's, an area's or a building's quantities.

    A money column is a formula, quantity times rate; its other factor is a
    phase's quantity. Phase labels hold for the columns from theirs on.
    """
    h = found.select(F.col("sheet").alias("_s"), "header_row", "c_qty", "c_rate")
    # all that matters is near a header, which is in the first 40 rows
    own = by_cell(by_row(cells).where("row <= 120").join(h, F.col("sheet") == F.col("_s")))
    away = F.col("row") - F.col("header_row")
    near = own.where(away.between(-8, 10) & (F.col("col") <= F.col("c_qty")) & F.col("text").isNotNull() & (F.trim("text") != "")).select("sheet", "row", "col", "c_qty", clean(F.col("text")).alias("said"))
    first = near.where(F.col("said").rlike(w.phase)).groupBy(F.col("sheet").alias("_p")).agg(F.min("row").alias("prow"))
    named = near.join(first, (F.col("sheet") == F.col("_p")) & (F.col("row") == F.col("prow"))).where(~F.col("said").rlike(w.headerish) & (F.length("said") <= 30))
    groups = named.groupBy("sheet").agg(F.sort_array(F.collect_list(F.struct("col", "said"))).alias("groups"))
    areas = near.where(F.col("said").rlike(w.area)).groupBy("sheet", "col").agg(F.max_by(F.upper("said"), "row").alias("area"))
    buildings = near.where(F.col("said").rlike(w.building)).groupBy("sheet", "col").agg(F.max_by("said", "row").alias("name"))

    letters = [F.regexp_extract("formula", PRODUCT, i) for i in (1, 2)]
    a, b = (F.when(x != "", column_number(x)) for x in letters)
    rate = F.col("c_rate")
    other = F.when(a == rate, F.when(b != rate, b)).when(b == rate, a)
    money = own.where(away.between(1, 80) & (F.col("col") < F.col("c_qty")) & F.col("formula").isNotNull()).select("sheet", "row", "col", "c_qty", other.alias("factor")).where("factor IS NOT NULL")
    money = money.groupBy("sheet", "col", "c_qty").agg(F.max_by("factor", "row").alias("factor"))

    # each sheet's columns of interest, of which it has few
    columns = near.select("sheet", "c_qty").distinct()
    of = lambda df, value, name: df.groupBy(F.col("sheet").alias(f"_{name}")).agg(F.sort_array(F.collect_set(value)).alias(name))
    by_area, by_money = of(areas, F.struct("col", "area"), "areas"), of(money, F.struct("col", "factor"), "moneys")
    one = groups.join(columns, "sheet").join(by_area, F.col("sheet") == F.col("_areas"), "left").join(by_money, F.col("sheet") == F.col("_moneys"), "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    area_cols = none(F.col("areas.col"), "array<int>")
    marked = F.array_union(none(F.col("moneys.factor"), "array<int>"), F.filter(area_cols, lambda x: x < F.col("c_qty")))
    labelled = F.filter(F.col("groups.col"), lambda x: x < F.col("c_qty"))
    spread = one.withColumn("qcols", F.array_except(F.when(F.size(marked) > 0, marked).otherwise(labelled), none(F.col("moneys.col"), "array<int>")))
    each = spread.withColumn("col", F.explode("qcols"))
    at_left = F.filter("groups", lambda g: g["col"] <= F.col("col"))
    group = F.coalesce(F.get(at_left, F.size(at_left) - 1)["said"], F.col("groups")[0]["said"])
    number = F.regexp_extract(group, w.phase, 1)
    label = F.when(number != "", F.concat(F.lit("Phase "), number)).otherwise(group)
    area = F.get(F.filter("areas", lambda x: x["col"] == F.col("col")), F.lit(0))["area"]
    own_money = F.get(F.filter("moneys", lambda x: x["factor"] == F.col("col")), F.lit(0))["col"]
    beside = F.col("col") + 1
    free = (beside < F.col("c_qty")) & ~F.array_contains("qcols", beside) & ~F.array_contains(F.col("groups.col"), beside) & ~F.array_contains(area_cols, beside)
    name = F.concat_ws(" ", label, area)
    found_phases = each.select("sheet", "col", name.alias("name"), F.coalesce(own_money, F.when(free, beside)).alias("money_col"), F.lit(False).alias("building"))
    return found_phases.unionByName(buildings.select("sheet", "col", "name", F.lit(None).cast("int").alias("money_col"), F.lit(True).alias("building")))


def read_pricing(cells: DataFrame, vocabulary: DataFrame, names: DataFrame | None = None, w: Words = Words(), binds: list[Bind] = BINDS, prefixes: tuple[str, ...] = ("total",)) -> DataFrame:
    """sheet, row, kind, description, section, basis, tag, uom, qty, rate, supply, total, supply_total, percent, amount, notes, phase_qty.

    Kinds: item, contractor, delivery, lump_sum, and the rows section, note and
    total that say something about others. ``names`` (sheet, name) may give the
    sheets' names. Sheets without a header have no rows.

    Defined results: a blank cell is no cell; a row without a description is left
    out unless it is a total; of cells at one place the greatest value counts;
    texts in number columns count as no number.
    """
    cells = by_row(cells)
    found = layout(cells, vocabulary, binds, prefixes, w)
    if names is not None:
        found = found.join(names.select(F.col("sheet").alias("_n"), F.col("name").alias("sheet_name")), F.col("sheet") == F.col("_n"), "left").drop("_n")
    else:
        found = found.withColumn("sheet_name", F.lit(None).cast("string"))
    # a mark in the column of descriptions is the description
    heads = found.withColumn("c_tag", F.when(F.col("c_tag") != F.col("c_desc"), F.col("c_tag")))
    below = cells.join(heads.withColumnRenamed("sheet", "_h"), F.col("sheet") == F.col("_h")).where("row > header_row").drop("_h")
    plain = lambda x: clean(x["text"])
    said = lambda x: F.when((plain(x) != "") & ~plain(x).startswith("="), plain(x))
    number = lambda x: x["number"]
    values = {"d": ("desc", said), "uom": ("uom", plain), "tag": ("tag", said), "qty": ("qty", number), "qty_formula": ("qty", lambda x: x["formula"]), **{m: (m, number) for m in ("rate", "supply", "total", "supply_total")}}
    reals = lambda ok: F.transform(F.filter("cells", lambda x: (x["number"] != 0) & ok(x["col"])), number)
    also = {
        "totals": F.exists("cells", lambda x: F.coalesce(said(x).rlike(w.total), F.lit(False))),
        "most_right": F.array_max(reals(lambda c: c > F.col("c_desc"))),
        "n_right": F.size(reals(lambda c: (c > F.col("c_desc")) & (c <= 40))),
        "after_qty": F.array_distinct(reals(lambda c: c > F.col("c_qty"))),
    }
    heading = ["header_row", "c_qty", "c_rate", "phased", "prefaced"]
    rows = stored(bound(below, values, also).select("sheet", "row", *heading, "sheet_name", F.col("c_supply").isNotNull().alias("has_supply"), *values, *also))

    # sheets with such words, of which the rest need no second look
    phased, prefaced = (stored(rows.where(x).select("sheet", *heading).distinct()) for x in ("phased", "prefaced"))
    rows = rows.drop(*heading)

    d, upper = F.col("d"), F.upper("d") == F.col("d")
    shouted = upper & (F.lower("d") != F.col("d"))
    total = F.col("totals") & d.isNull()
    rows = rows.where(total | (d.isNotNull() & ~d.rlike(w.headerish))).withColumn("uom", F.nullif("uom", F.lit("")))
    priced = F.col("uom").isNotNull() | F.col("qty").isNotNull() | F.col("qty_formula").isNotNull() | F.col("rate").isNotNull() | F.col("supply").isNotNull()
    lines = (d.rlike(w.delivery) | d.rlike(w.lump)) & (~shouted | (F.col("n_right") > 0))
    first = rows.withColumn("role", F.when(total, "total").when(d.rlike(w.note), "note").when(d.rlike(w.contractor), "switch").when(priced | lines, "item"))
    turned = carried(pieces(first, "row"), ["sheet"], "row", {"contractor": F.when(F.col("role") == "switch", F.lit(True))})
    hired = F.coalesce("contractor", F.lit(False))
    turned = turned.withColumn("contractor", hired).withColumn("role", F.coalesce("role", F.when(F.col("contractor") & d.rlike(w.monthly) & ~shouted, "item"), F.lit("section")))
    heads = F.col("role").isin("section", "switch")
    title = F.when(F.col("role") == "section", d).when(F.col("role") == "switch", F.lit("Contractor Items"))
    placed = carried(turned, ["sheet"], "row", {"section": title, "since": F.when(heads, F.col("row")), "title_row": F.when(F.col("role") == "section", F.struct("row", "d"))})

    own_basis = basis_of(F.coalesce("title_row.d", F.lit("")), F.col("sheet_name"), w)
    placed = stored(placed.drop("_b").withColumn("section_basis", own_basis))

    # notes hold for their section from their row on; those before the first section, and above the header, for the sheet
    notes = placed.where("role = 'note' AND title_row IS NULL").select("sheet", "row", F.lit(0).alias("col"), F.col("d").alias("note"))
    if not prefaced.isEmpty():
        h = prefaced.select(F.col("sheet").alias("_s"), "header_row", "c_qty")
        above = by_cell(cells.where("row < 40").join(h, (F.col("sheet") == F.col("_s")) & (F.col("row") - F.col("header_row")).between(-6, -1))).where("col < c_qty")
        notes = notes.unionByName(above.where(is_note(F.col("text"), w)).select("sheet", (F.col("row") - (1 << 30)).alias("row"), "col", clean(F.col("text")).alias("note")))
    whole = notes.groupBy(F.col("sheet").alias("_w")).agg(F.sort_array(F.collect_list(F.struct("row", "col", "note"))).alias("whole"))
    of_sheet = placed.join(stored(whole), F.col("sheet") == F.col("_w"), "left").drop("_w")
    # a section's rows lie where its sheet's do
    ahead = Window.partitionBy("sheet", F.coalesce("since", F.lit(0))).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    noted = of_sheet.withColumn("part", F.collect_list(F.when((F.col("role") == "note") & F.col("title_row").isNotNull(), d)).over(ahead))
    earlier = F.coalesce(F.transform(F.filter("whole", lambda x: x["row"] < F.col("row")), lambda x: x["note"]), F.array().cast("array<string>"))
    noted = noted.withColumn("notes", F.when(F.col("role") == "item", F.concat(earlier, "part")))

    full = noted.withColumn("phase_qty", F.lit(None).cast("array<struct<name:string,q:double>>"))
    if not phased.isEmpty():
        # written, so that its size is known: most sheets have few such columns or none
        ph = stored(phases(cells, phased, w).groupBy(F.col("sheet").alias("_ps")).agg(F.collect_list(F.struct("col", "name", "building")).alias("ph")))
        ahead = phased.select(F.col("sheet").alias("_h"), "header_row")
        amounts = by_cell(cells.join(ph, F.col("sheet") == F.col("_ps")).join(ahead, F.col("sheet") == F.col("_h")).where("row > header_row")).where("number <> 0")
        amounts = amounts.withColumn("p", F.explode("ph")).where("p.col = col").select("sheet", "row", "p.name", "p.building", "number")
        summed = amounts.groupBy("sheet", "row", "name").agg(F.round(F.coalesce(F.max(F.when(F.col("building"), F.col("number"))), F.sum("number")), 6).alias("q"))
        quantities = summed.groupBy(F.col("sheet").alias("_qs"), F.col("row").alias("_qr")).agg(F.sort_array(F.collect_list(F.struct("name", "q"))).alias("phase_qty"))
        full = noted.join(quantities, (F.col("sheet") == F.col("_qs")) & (F.col("row") == F.col("_qr")), "left")

    uom = F.lower("uom")
    month = uom.isNull() | uom.isin(*MONTHS)
    monthly = d.rlike(w.monthly) & month & (F.col("rate").isNull() | (F.col("rate") >= 1000)) & ~d.rlike(w.not_monthly)
    delivery, lump = d.rlike(w.delivery), d.rlike(w.lump)
    special = F.col("contractor") | monthly | delivery | (lump & F.col("uom").isNull() & F.col("qty").isNull())
    lumped = lump & ~d.rlike(w.monthly)
    kind = F.when(F.col("role") != "item", F.when(F.col("role") == "switch", "section").otherwise(F.col("role"))).when(~special, "item").when(delivery, "delivery").when(lumped, "lump_sum").otherwise("contractor")
    percent = F.when((kind == "delivery") & (uom == "%"), F.col("qty"))
    said_amount = F.greatest(F.nullif("total", F.lit(0.0)), F.nullif("supply_total", F.lit(0.0)))
    others = F.array_max(F.filter("after_qty", lambda x: percent.isNull() | (x != percent)))
    large = F.when(F.col("rate").isNull() & (F.col("qty") > 100), F.col("qty"))
    amount = F.when(kind == "delivery", F.coalesce(said_amount, others)).when(kind == "lump_sum", F.coalesce(said_amount, F.col("most_right"), large)).when(kind == "total", F.col("total"))
    by_price = F.when(F.col("rate").isNotNull() & F.col("supply").isNotNull(), "supply_and_install").when(F.col("supply").isNotNull(), "supply_only").when(F.col("rate").isNotNull(), "install_only")
    basis = F.when(kind == "item", F.coalesce("section_basis", by_price)).when(kind == "delivery", "percent").when(kind == "lump_sum", "lump_sum")
    basis = basis.when(kind == "contractor", F.when(month & d.rlike(w.monthly), "monthly").when(d.rlike(w.tools), "lump_sum").otherwise("monthly"))
    moved = (kind == "item") & (basis == "supply_only") & F.col("rate").isNotNull() & ~F.col("has_supply")
    item = F.col("role") == "item"
    only = lambda c: F.when(item, c)
    return full.select(
        "sheet",
        "row",
        kind.alias("kind"),
        d.alias("description"),
        only(F.col("section")).alias("section"),
        basis.alias("basis"),
        only(F.col("tag")).alias("tag"),
        only(F.col("uom")).alias("uom"),
        only(F.col("qty")).alias("qty"),
        only(F.when(~F.coalesce(moved, F.lit(False)), F.col("rate"))).alias("rate"),
        only(F.when(F.coalesce(moved, F.lit(False)), F.col("rate")).otherwise(F.col("supply"))).alias("supply"),
        F.when(item | (F.col("role") == "total"), F.col("total")).alias("total"),
        F.when(item | (F.col("role") == "total"), F.col("supply_total")).alias("supply_total"),
        percent.alias("percent"),
        amount.alias("amount"),
        F.col("notes"),
        only(F.col("phase_qty")).alias("phase_qty"),
    )


# fixed values: names of sheets and what they hold, labels of a summary's cells
UNIT_WORDS = {"week": "week", "weeks": "week", "wk": "week", "month": "month", "months": "month", "mth": "month"}
SUMMARY_LABELS = {"project": "project", "date": "doc_date", "package": "package", "name of subcontractor": "subcontractor", "date of offer": "offer_date", "offer valid to date": "validity", "offer validity": "validity"}
PACKAGES = [(r"containment|ladder|tray|bracket|optional", "containment"), (r"lighting", "lighting"), (r"general\s*services|gs[\s-]*sp|small\s*power|\bgs\b|socket", "gs_sp"), (r"\bcable\b", "cable"), (r"prelim", "prelims")]
LINK = r"=\s*(?:\[\d+\])?'?([^'!]+)'?!\$?([A-Z]+)\$?(\d+)"


def package_of(text: Column) -> Column:
    """The trade that a name says, by the first pattern that it has; null if none."""
    low, out = F.lower(text), F.lit(None).cast("string")
    for pattern, package in reversed(PACKAGES):
        out = F.when(low.rlike(pattern), package).otherwise(out)
    return out


def sheet_kinds(cells: DataFrame, names: DataFrame, found: DataFrame) -> DataFrame:
    """sheet, kind, package of every named sheet: takeoff, summary, attendance, prelims, pricing, calc or other, the first that holds.

    ``found`` are the headers of ``layout``; sheets may have no cells.
    """
    tops = cells.where((F.col("row") == 1) & (F.col("col") <= 12)).groupBy(F.col("sheet").alias("_t")).agg(F.collect_set(F.lower(clean(F.col("text")))).alias("top"))
    h = found.select(F.col("sheet").alias("_h"), "header_row", F.col("c_ref").isNotNull().alias("has_ref"))
    low = F.lower(F.trim("name"))
    full = names.join(tops, F.col("sheet") == F.col("_t"), "left").join(h, F.col("sheet") == F.col("_h"), "left")
    takeoff = F.coalesce(F.array_contains("top", "folder") & F.array_contains("top", "dimension group"), F.lit(False))
    header = F.col("header_row").isNotNull()
    kind = F.when(takeoff, "takeoff").when(low == "summary", "summary").when(low.contains("attendance"), "attendance").when(header & F.col("has_ref") & low.contains("prelim"), "prelims").when(header, "pricing").when(low.rlike(r"calc|total|sheet\d"), "calc").otherwise("other")
    return full.select("sheet", kind.alias("kind"), package_of(F.col("name")).alias("package"))


def attendance(cells: DataFrame) -> DataFrame:
    """sheet, items, by_subcontractor: the lines below the first row that names a subcontractor, and those with a tick in that column.

    Sheets without such a row have zeros.
    """
    said = clean(F.col("text"))
    heads = cells.where((F.col("row") <= 40) & (F.col("col") <= 10) & F.lower(said).rlike("sub-?contractor")).groupBy(F.col("sheet").alias("_s")).agg(F.min(F.struct("row", "col")).alias("at"))
    below = cells.join(heads, (F.col("sheet") == F.col("_s")) & (F.col("row") > F.col("at.row"))).where(said != "")
    rows = below.groupBy("sheet", "row").agg(F.bool_or(F.col("col") == 2).alias("item"), F.bool_or(F.col("col") == F.col("at.col")).alias("tick")).where("item")
    counts = rows.groupBy(F.col("sheet").alias("_c")).agg(F.count(F.lit(1)).alias("items"), F.count_if("tick").alias("by_subcontractor"))
    return cells.select("sheet").distinct().join(counts, F.col("sheet") == F.col("_c"), "left").select("sheet", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("by_subcontractor", F.lit(0)).alias("by_subcontractor"))


def read_prelims(cells: DataFrame, found: DataFrame, total: str = r"(?i)total\s*-\s*c/f|^total", units: dict[str, str] = UNIT_WORDS) -> DataFrame:
    """sheet, row, ref, description, qty, uom, rate, total, basis, rate_is_formula: the preliminaries above the first total.

    ``found`` are headers of ``layout``. Rows without quantity, rate and unit are
    headings and left out. Weekly and monthly units say the basis, all else is a
    lump sum.
    """
    heads = found.withColumn("c_desc", F.coalesce("c_named", F.lit(2))).withColumn("c_ref", F.coalesce("c_ref", F.lit(1))).withColumnRenamed("sheet", "_s")
    below = by_row(cells).join(heads, (F.col("sheet") == F.col("_s")) & (F.col("row") > F.col("header_row")))
    said = lambda x: F.nullif(clean(x["text"]), F.lit(""))
    number = lambda x: x["number"]
    values = {"description": ("desc", said), "unit": ("uom", said), "ref": ("ref", said), "qty": ("qty", number), "rate": ("rate", number), "total": ("total", number), "formula": ("rate", lambda x: x["formula"])}
    rows = bound(below, values).select("sheet", "row", *values).where("description IS NOT NULL")
    ends = rows.where(F.col("description").rlike(total)).groupBy(F.col("sheet").alias("_e")).agg(F.min("row").alias("end"))
    known = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])
    unit = F.coalesce(F.try_element_at(known, F.lower("unit")), F.lower("unit"))
    basis = F.when(unit == "week", "weekly").when(unit == "month", "monthly").otherwise("lump_sum")
    some = rows.join(ends, F.col("sheet") == F.col("_e"), "left").where("(end IS NULL OR row < end) AND NOT (qty IS NULL AND rate IS NULL AND unit IS NULL)")
    return some.select("sheet", "row", "ref", "description", "qty", unit.alias("uom"), "rate", "total", basis.alias("basis"), F.col("formula").isNotNull().alias("rate_is_formula"))


def summary_fields(cells: DataFrame) -> DataFrame:
    """sheet, field, value, row, col: what stands right of a summary's labels, within five columns; the first label of a kind counts."""
    said = clean(F.col("text"))
    known = F.create_map(*[F.lit(x) for pair in SUMMARY_LABELS.items() for x in pair])
    near = cells.where("row <= 60")
    marks = near.where("col <= 12").select("sheet", "row", "col", F.try_element_at(known, F.rtrim(F.regexp_replace(F.lower(said), r"[: ]+$", ""))).alias("field")).where("field IS NOT NULL")
    shown = F.coalesce(F.nullif(said, F.lit("")), F.col("number").cast("string"))
    values = near.select(F.col("sheet").alias("_s"), F.col("row").alias("_r"), F.col("col").alias("_c"), shown.alias("value")).where("value IS NOT NULL")
    beside = (F.col("sheet") == F.col("_s")) & (F.col("row") == F.col("_r")) & F.col("_c").between(F.col("col") + 1, F.col("col") + 5)
    each = marks.join(values, beside, "left").groupBy("sheet", "field", "row", "col").agg(F.min(F.struct("_c", "value")).alias("x"))
    # a field that has a value is not asked for again
    first = each.groupBy("sheet", "field").agg(F.min_by(F.struct("row", "x"), F.struct(F.col("x._c").isNull(), "row", "col")).alias("f"))
    return first.select("sheet", "field", F.col("f.x.value").alias("value"), F.col("f.row").alias("row"), F.col("f.x._c").alias("col"))


def cost_lines(cells: DataFrame) -> DataFrame:
    """sheet, row, label, code, link_sheet, link_cell, not_participating, package, supply, prelims, optional: the lines below "cost summary", up to the total.

    A label is the first text of more than three characters that is no formula
    and no code. A formula that refers to another sheet is the line's link;
    ``operators.links.followed`` leads such links on.
    """
    said = clean(F.col("text"))
    starts = cells.where((F.col("row") <= 80) & (F.col("col") <= 12) & (F.lower(said) == "cost summary")).groupBy(F.col("sheet").alias("_s")).agg(F.min("row").alias("start"))
    below = cells.join(starts, (F.col("sheet") == F.col("_s")) & F.col("row").between(F.col("start") + 1, F.col("start") + 40)).where("col <= 14")
    code = said.isin("Prelims", "E", "O")
    is_label = (F.length(said) > 3) & ~said.startswith("=") & ~F.lower(said).isin("prelims", "e", "o")
    linked = F.col("formula").contains("!") & (F.regexp_extract("formula", LINK, 1) != "")
    first = lambda ok, x: F.min_by(x, F.when(ok, F.col("col")))
    rows = below.groupBy("sheet", "row").agg(first(is_label, said).alias("label"), first(code, said).alias("code"), first(linked, F.col("formula")).alias("link"), F.count_if(is_label).alias("n_labels"), F.count_if(code).alias("n_codes"), F.count_if(linked).alias("n_links"), F.coalesce(F.bool_or(said.rlike(r"(?i)not\s*participat")), F.lit(False)).alias("not_participating"))
    rows = rows.where("n_labels > 0")
    label = F.col("label")
    ends = rows.where(F.lower(label).startswith("total")).groupBy(F.col("sheet").alias("_e")).agg(F.min("row").alias("end"))
    has = lambda p: label.rlike(f"(?i){p}")
    code_ = F.when(F.col("n_codes") > 0, F.col("code"))
    link = F.when(F.col("n_links") > 0, F.col("link"))
    part = lambda i: F.regexp_extract(link, LINK, i)
    return rows.join(ends, F.col("sheet") == F.col("_e"), "left").where("end IS NULL OR row < end").select("sheet", "row", "label", code_.alias("code"), F.trim(part(1)).alias("link_sheet"), F.concat(part(2), part(3)).alias("link_cell"), "not_participating", package_of(label).alias("package"), has("supply").alias("supply"), has("prelim").alias("prelims"), (F.coalesce(code_ == "O", F.lit(False)) | has("optional")).alias("optional"))


#: columns of the tables as columns of a sheet: name, text or number
SOURCES = [("l_quantity", False), ("p_retailprice", False), ("l_extendedprice", False), ("l_tax", False), ("l_discount", False), ("p_type", True), ("p_name", True), ("p_brand", True)]
COLUMN_LABELS = {"l_quantity": "qty", "p_retailprice": "rate", "l_extendedprice": "total", "l_tax": "supply", "p_type": "uom", "p_name": "desc", "p_brand": "tag"}
COLUMN_BINDS = [Bind("qty", "qty"), Bind("rate", "rate", "qty", any=True), Bind("total", "total", "rate"), Bind("supply", "supply"), Bind("supply_total", "total", "supply"), Bind("uom", "uom"), Bind("desc", "desc"), Bind("tag", "tag")]
#: what the words of part names stand for
PART_WORDS = Words(note="^red ", contractor="^green .*ring$", total="^Brand#1", lump="bolt$", monthly="widget$", delivery="^blue ", tools="^small ", not_monthly="^hot ", headerish="^small ring$", free_issue="bolt$", supply_install="gear$", supply_only="nut$", install_only="valve$", optional="URGENT")


def sheets_of_orders(t: Tables) -> DataFrame:
    """Orders as sheets, by row: the lines' columns in an order of each sheet's own, below a header with their names.

    Returned lines are headings (name alone) or totals (brand and total alone).
    """
    lines = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("l_orderkey", "sheet")
    lines = spread(lines, "sheet")
    k = F.row_number().over(Window.partitionBy("sheet").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    sheet = F.col("sheet")
    place = lambda j: (1 + (F.lit(j) * F.element_at(F.array(*map(F.lit, (1, 3, 5, 7))), (F.col("sheet") % 4 + 1).cast("int")) + F.col("sheet")) % 8).cast("int")
    rows = lines.withColumn("k", k).withColumn("row", (2 + sheet % 3 + F.col("k")).cast("int"))
    back = F.col("l_returnflag") == "R"
    heading = back & (F.col("l_linenumber") % 2 == 0)
    shown = {"p_name": ~back | heading, "p_brand": ~heading, "l_extendedprice": ~heading}
    none = F.lit(None).cast("string")
    made = lambda j, text, number: F.struct(place(j).alias("col"), text.alias("text"), number.cast("double").alias("number"), none.alias("formula"))
    cell = lambda j, name, text: F.when(shown.get(name, ~back), made(j, F.col(name) if text else none, F.lit(None) if text else F.col(name)))
    body = F.array_compact(F.array(*[cell(j, *x) for j, x in enumerate(SOURCES)]))
    # the header stands above a sheet's first line
    top = F.array(*[made(j, F.lit(name), F.lit(None)) for j, (name, _) in enumerate(SOURCES)])
    both = F.when(F.col("k") == 1, F.array(F.struct((F.col("row") - 1).alias("row"), top.alias("cells")), F.struct("row", body.alias("cells")))).otherwise(F.array(F.struct("row", body.alias("cells"))))
    return rows.select("sheet", F.inline(both))


CELLS = """lines AS (SELECT l_orderkey AS sheet, (2 + l_orderkey % 3 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice))::INTEGER AS row, l_returnflag = 'R' AS back, l_returnflag = 'R' AND l_linenumber % 2 = 0 AS heading, l_quantity, p_retailprice, l_extendedprice, l_tax, l_discount, p_type, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
flat AS (SELECT sheet, row, unnest([{'j': 0, 't': NULL, 'n': l_quantity, 'ok': NOT back}, {'j': 1, 't': NULL, 'n': p_retailprice, 'ok': NOT back}, {'j': 2, 't': NULL, 'n': l_extendedprice, 'ok': NOT heading}, {'j': 3, 't': NULL, 'n': l_tax, 'ok': NOT back}, {'j': 4, 't': NULL, 'n': l_discount, 'ok': NOT back}, {'j': 5, 't': p_type, 'n': NULL, 'ok': NOT back}, {'j': 6, 't': p_name, 'n': NULL, 'ok': NOT back OR heading}, {'j': 7, 't': p_brand, 'n': NULL, 'ok': NOT heading}]) AS c FROM lines),
tops AS (SELECT sheet, (2 + sheet % 3)::INTEGER AS row, unnest([{'j': 0, 't': 'l_quantity'}, {'j': 1, 't': 'p_retailprice'}, {'j': 2, 't': 'l_extendedprice'}, {'j': 3, 't': 'l_tax'}, {'j': 4, 't': 'l_discount'}, {'j': 5, 't': 'p_type'}, {'j': 6, 't': 'p_name'}, {'j': 7, 't': 'p_brand'}]) AS c FROM (SELECT DISTINCT sheet FROM lines)),
cells AS (SELECT sheet, row, 1 + (c.j * (1 + 2 * (sheet % 4)) + sheet) % 8 AS col, c.t AS text, c.n::DOUBLE AS number FROM flat WHERE c.ok UNION ALL SELECT sheet, row, 1 + (c.j * (1 + 2 * (sheet % 4)) + sheet) % 8, c.t, NULL FROM tops)"""

PRICING = f"""WITH {CELLS},
voc AS (SELECT * FROM (VALUES ('l_quantity', 'qty'), ('p_retailprice', 'rate'), ('l_extendedprice', 'total'), ('l_tax', 'supply'), ('p_type', 'uom'), ('p_name', 'desc'), ('p_brand', 'tag')) v(label, meaning)),
met AS (SELECT sheet, row, col, meaning FROM cells JOIN voc ON lower(trim(text)) = label),
h0 AS (SELECT sheet, min(row) AS header_row FROM (SELECT sheet, row FROM met GROUP BY sheet, row HAVING bool_or(meaning = 'qty') AND bool_or(meaning = 'rate')) GROUP BY sheet),
hm AS (SELECT m.* FROM met m JOIN h0 ON m.sheet = h0.sheet AND m.row = header_row),
h1 AS (SELECT sheet, min(col) FILTER (WHERE meaning = 'qty') AS qty, min(col) FILTER (WHERE meaning = 'rate') AS rate, min(col) FILTER (WHERE meaning = 'total') AS tot, min(col) FILTER (WHERE meaning = 'supply') AS supply, min(col) FILTER (WHERE meaning = 'uom') AS uom, min(col) FILTER (WHERE meaning = 'desc') AS named, min(col) FILTER (WHERE meaning = 'tag') AS tag FROM hm GROUP BY sheet),
wordy AS (SELECT c.sheet, c.col, count(*) AS n FROM cells c JOIN h0 USING (sheet) JOIN h1 USING (sheet) WHERE c.row - header_row BETWEEN 1 AND 120 AND c.col < qty AND length(trim(text)) > 6 AND NOT starts_with(text, '=') GROUP BY c.sheet, c.col),
most AS (SELECT sheet, arg_min(col, (-n, col)) AS col FROM wordy GROUP BY sheet),
h AS (SELECT h1.sheet, header_row, qty, rate, CASE WHEN tot > rate THEN tot END AS total, supply, CASE WHEN tot > supply THEN tot END AS supply_total, uom, coalesce(most.col, named, 2) AS "desc", CASE WHEN coalesce(tag, 1) <> coalesce(most.col, named, 2) THEN tag END AS tag FROM h1 JOIN h0 USING (sheet) LEFT JOIN most USING (sheet)),
r0 AS (SELECT c.sheet, c.row, max(trim(text)) FILTER (WHERE col = "desc") AS d, max(text) FILTER (WHERE col = h.uom) AS uom, max(text) FILTER (WHERE col = h.tag) AS tag, max(number) FILTER (WHERE col = h.qty) AS qty, max(number) FILTER (WHERE col = h.rate) AS rate,
    max(number) FILTER (WHERE col = h.supply) AS supply, max(number) FILTER (WHERE col = h.total) AS total, max(number) FILTER (WHERE col = h.supply_total) AS supply_total, coalesce(bool_or(regexp_matches(text, '^Brand#1')), false) AS totals,
    max(number) FILTER (WHERE col > "desc" AND number <> 0) AS most_right, count(*) FILTER (WHERE col > "desc" AND number <> 0) AS n_right, max(number) FILTER (WHERE col > h.qty AND number <> 0) AS after_qty FROM cells c JOIN h ON h.sheet = c.sheet AND c.row > header_row GROUP BY c.sheet, c.row),
r1 AS (SELECT *, CASE WHEN totals AND d IS NULL THEN 'total' WHEN regexp_matches(d, '^red ') THEN 'note' WHEN regexp_matches(d, '^green .*ring$') THEN 'switch' WHEN uom IS NOT NULL OR qty IS NOT NULL OR rate IS NOT NULL OR supply IS NOT NULL OR ((regexp_matches(d, '^blue ') OR regexp_matches(d, 'bolt$')) AND (NOT (upper(d) = d AND lower(d) <> d) OR n_right > 0)) THEN 'item' END AS role0
    FROM r0 WHERE (totals AND d IS NULL) OR (d IS NOT NULL AND NOT regexp_matches(d, '^small ring$'))),
r2 AS (SELECT *, coalesce(bool_or(role0 = 'switch') OVER (PARTITION BY sheet ORDER BY row), false) AS contractor FROM r1),
r3 AS (SELECT *, coalesce(role0, CASE WHEN contractor AND regexp_matches(d, 'widget$') AND NOT (upper(d) = d AND lower(d) <> d) THEN 'item' END, 'section') AS role FROM r2),
r4 AS (SELECT r3.*, o_orderpriority AS sheet_name, last_value(CASE role WHEN 'section' THEN d WHEN 'switch' THEN 'Contractor Items' END IGNORE NULLS) OVER w AS section, last_value(CASE WHEN role IN ('section', 'switch') THEN row END IGNORE NULLS) OVER w AS since,
    last_value(CASE WHEN role = 'section' THEN d END IGNORE NULLS) OVER w AS title, min(CASE WHEN role = 'section' THEN row END) OVER (PARTITION BY sheet) AS begun FROM r3 LEFT JOIN orders ON o_orderkey = sheet WINDOW w AS (PARTITION BY sheet ORDER BY row ROWS UNBOUNDED PRECEDING)),
r5 AS (SELECT *, CASE WHEN regexp_matches(coalesce(title, ''), 'bolt$') THEN 'install_only' WHEN regexp_matches(coalesce(title, ''), 'gear$') THEN 'supply_and_install' WHEN regexp_matches(coalesce(title, ''), 'nut$') OR coalesce(regexp_matches(sheet_name, 'URGENT'), false) THEN 'supply_only' WHEN regexp_matches(coalesce(title, ''), 'valve$') THEN 'install_only' END AS section_basis,
    CASE WHEN role = 'note' THEN CASE WHEN coalesce(row > begun, false) THEN coalesce(since, 0) ELSE -1 END END AS level FROM r4),
nt AS (SELECT i.sheet, i.row, count(*) AS n, string_agg(n.d, ' | ' ORDER BY n.level >= 0, n.row) AS notes FROM r5 i JOIN r5 n ON n.role = 'note' AND n.sheet = i.sheet AND n.row < i.row AND (n.level = -1 OR n.level = coalesce(i.since, 0)) WHERE i.role = 'item' GROUP BY i.sheet, i.row),
r6 AS (SELECT *, lower(uom) = '%' AS pct, uom IS NULL OR lower(uom) IN ('month', 'months', 'mth') AS month FROM r5),
r7 AS (SELECT *, contractor OR (regexp_matches(d, 'widget$') AND month AND (rate IS NULL OR rate >= 1000) AND NOT regexp_matches(d, '^hot ')) OR regexp_matches(d, '^blue ') OR (regexp_matches(d, 'bolt$') AND uom IS NULL AND qty IS NULL) AS special FROM r6),
r8 AS (SELECT *, CASE WHEN role = 'switch' THEN 'section' WHEN role <> 'item' THEN role WHEN NOT special THEN 'item' WHEN regexp_matches(d, '^blue ') THEN 'delivery' WHEN regexp_matches(d, 'bolt$') AND NOT regexp_matches(d, 'widget$') THEN 'lump_sum' ELSE 'contractor' END AS kind FROM r7),
r9 AS (SELECT *, CASE kind WHEN 'item' THEN coalesce(section_basis, CASE WHEN rate IS NOT NULL AND supply IS NOT NULL THEN 'supply_and_install' WHEN supply IS NOT NULL THEN 'supply_only' WHEN rate IS NOT NULL THEN 'install_only' END) WHEN 'delivery' THEN 'percent' WHEN 'lump_sum' THEN 'lump_sum' WHEN 'contractor' THEN CASE WHEN month AND regexp_matches(d, 'widget$') THEN 'monthly' WHEN regexp_matches(d, '^small ') THEN 'lump_sum' ELSE 'monthly' END END AS basis,
    greatest(nullif(total, 0), nullif(supply_total, 0)) AS said FROM r8)
SELECT r9.sheet, r9.row, kind, d AS description, CASE WHEN role = 'item' THEN section END AS section, basis, CASE WHEN role = 'item' THEN tag END AS tag, CASE WHEN role = 'item' THEN uom END AS uom, CASE WHEN role = 'item' THEN qty END AS qty, CASE WHEN role = 'item' THEN rate END AS rate, CASE WHEN role = 'item' THEN supply END AS supply,
    CASE WHEN role IN ('item', 'total') THEN total END AS total, CASE WHEN role IN ('item', 'total') THEN supply_total END AS supply_total,
    CASE kind WHEN 'delivery' THEN coalesce(said, after_qty) WHEN 'lump_sum' THEN coalesce(said, most_right, CASE WHEN rate IS NULL AND qty > 100 THEN qty END) WHEN 'total' THEN total END AS amount, CASE WHEN role = 'item' THEN coalesce(notes, '') END AS notes FROM r9 LEFT JOIN nt ON nt.sheet = r9.sheet AND nt.row = r9.row"""


@query(PRICING)
def pricing_rows(t: Tables):
    """Orders read as pricing sheets whose columns lie in another order in each."""
    names = t("orders").select(F.col("o_orderkey").alias("sheet"), F.col("o_orderpriority").alias("name"))
    read = read_pricing(sheets_of_orders(t), labels(t, COLUMN_LABELS), names, PART_WORDS, COLUMN_BINDS, ())
    return read.withColumn("notes", F.array_join("notes", " | ")).drop("percent", "phase_qty")


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS s, o_totalprice, CASE WHEN o_orderpriority <> '5-LOW' THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS t FROM orders),
f AS (SELECT s, t AS e, 1::BIGINT AS n FROM o WHERE t IS NOT NULL UNION ALL SELECT f.s, o.t, n + 1 FROM f JOIN o ON o.s = f.e WHERE o.t IS NOT NULL), l AS (SELECT s, arg_max(e, n) AS e, max(n) AS n FROM f GROUP BY s)
SELECT l.s AS line, l.e AS "end", l.n AS steps, o.o_totalprice AS amount FROM l JOIN o ON o.s = l.e""")
def linked_costs(t: Tables):
    """Cost lines that refer to another sheet take their amount from where the references lead at last."""
    o = t("orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    links = o.select(F.col("o_orderkey").alias("line"), F.when(F.col("o_orderpriority") != "5-LOW", before).alias("target"))
    ends = followed(links, "line", "target")
    return ends.join(o.select(F.col("o_orderkey").alias("_o"), F.col("o_totalprice").alias("amount")), F.col("end") == F.col("_o")).select("line", "end", "steps", "amount")


HEADS = PRICING.split("r0 AS (")[0]


@query(f"""{HEADS}p AS (SELECT c.sheet, c.row, max(text) FILTER (WHERE col = coalesce(named, 2)) AS description, max(lower(text)) FILTER (WHERE col = h1.uom) AS unit, max(text) FILTER (WHERE col = 1) AS ref, max(number) FILTER (WHERE col = h1.qty) AS qty, max(number) FILTER (WHERE col = h1.rate) AS rate, max(number) FILTER (WHERE col = CASE WHEN h1.tot > h1.rate THEN h1.tot END) AS total
    FROM cells c JOIN h0 ON h0.sheet = c.sheet AND c.row > header_row JOIN h1 ON h1.sheet = c.sheet GROUP BY c.sheet, c.row), e AS (SELECT sheet, min(row) AS stop FROM p WHERE regexp_matches(description, '^hot ') GROUP BY sheet)
SELECT p.sheet, p.row, ref, description, qty, CASE unit WHEN 'economy' THEN 'week' WHEN 'standard' THEN 'month' ELSE unit END AS uom, rate, total, CASE unit WHEN 'economy' THEN 'weekly' WHEN 'standard' THEN 'monthly' ELSE 'lump_sum' END AS basis, false AS rate_is_formula
FROM p LEFT JOIN e ON e.sheet = p.sheet WHERE description IS NOT NULL AND (stop IS NULL OR p.row < stop) AND NOT (qty IS NULL AND rate IS NULL AND unit IS NULL)""")
def prelims_rows(t: Tables):
    """Orders read as sheets of preliminaries: rows up to the first total, priced by week, month or as a lump sum."""
    cells = sheets_of_orders(t)
    found = stored(layout(cells, labels(t, COLUMN_LABELS), COLUMN_BINDS, ())).withColumn("c_ref", F.lit(None).cast("int"))
    return read_prelims(cells, found, "^hot ", {"economy": "week", "standard": "month"})
