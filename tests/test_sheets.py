"""The pricing-sheet reader against one that reads a sheet at a time, on random layouts."""

import random
import re

from rubicost.operators.links import followed
from rubicost.plans.sheets import BINDS, LABELS, MONTHS, PRODUCT, Words, attendance, cost_lines, layout, read_prelims, read_pricing, sheet_kinds, summary_fields

W = Words()


def hit(pattern, text):
    return re.search(pattern, text or "", re.A) is not None


def letters(n):
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def number(text):
    n = 0
    for c in text:
        n = n * 26 + ord(c) - 64
    return n


def random_sheet(rng):
    """Cells (row, col) -> (text, number, formula) of a sheet with a layout of its own."""
    cells = {}
    n_left = rng.randrange(2, 7)
    phases = rng.random() < 0.5
    left = [("description", "desc")] + ([("Ref", "ref")] if rng.random() < 0.5 else []) + ([("Finish", "tag")] if rng.random() < 0.5 else [])
    left += [(None, "free")] * n_left
    rng.shuffle(left)
    right = [("Quantity", "qty"), ("Rate", "rate")] + ([("TOTAL  €", "total")] if rng.random() < 0.8 else []) + ([("Unit price", "supply"), ("Total supply", "supply_total")] if rng.random() < 0.5 else [])
    if rng.random() < 0.8:
        right.insert(rng.randrange(1, len(right)), ("UoM", "uom"))
    columns = left + right
    r0 = rng.randrange(4, 10)
    at = {}
    for c, (label, meaning) in enumerate(columns, 1):
        if label:
            cells[r0, c] = (label, None, None)
        at.setdefault(meaning, c)
    free = [c for c, (_, m) in enumerate(columns, 1) if m == "free"]
    if "uom" not in at and rng.random() < 0.7:
        at["uom"] = len(columns) + 1
        cells[r0 + rng.choice((-2, 2)), at["uom"]] = ("Unit", None, None)
    if phases:
        for i, c in enumerate(free[: rng.randrange(1, 4)]):
            cells[r0 - 2, c] = (f"Phase {i + 1} works", None, None)
            if rng.random() < 0.4:
                cells[r0 - 1, c] = (rng.choice(("Internal", "EXTERNAL")), None, None)
    elif rng.random() < 0.4:
        cells[r0 - 1, free[0]] = ("Building B2", None, None)
    if rng.random() < 0.5:
        cells[r0 - 3, 1] = ("Note: prices are without tax", None, None)
    texts = ["LUMINAIRES", "Supply and install", "Cables (free issued for install)", "Optional price", "Note: see drawing", "Contractor items", "Accommodation", "Cherry picker 12m", "Delivery to site", "Fixation and power tools", "Transport phase 2", "Cable tray 100mm", "Double socket", "Site", "Small tools", "supply only items"]
    for r in range(r0 + 1, r0 + rng.randrange(8, 40)):
        kind = rng.random()
        if kind < 0.1:
            continue
        if kind < 0.18:
            cells[r, rng.choice(free)] = (rng.choice(("Total", "C/F to summary")), None, None)
            for m in ("total", "supply_total"):
                if m in at:
                    cells[r, at[m]] = (None, float(rng.randrange(1, 999)), None)
            continue
        cells[r, at["desc"]] = (rng.choice(texts) + rng.choice(("", "", " A", " 2")), None, None)
        if kind < 0.4:
            continue
        for m, p in (("qty", 0.7), ("rate", 0.6), ("supply", 0.4), ("total", 0.5), ("supply_total", 0.4)):
            if m in at and rng.random() < p:
                cells[r, at[m]] = (None, float(rng.choice((0, 1, 5, 120, 1500))), None)
        if "uom" in at and rng.random() < 0.6:
            cells[r, at["uom"]] = (rng.choice(("m", "pcs", "Month", "%")), None, None)
        if "tag" in at and rng.random() < 0.5:
            cells[r, at["tag"]] = ("Galvanised", None, None)
        for i, c in enumerate(free):
            if rng.random() < 0.3:
                q = free[i - 1]
                money = f"={letters(q)}{r}*{letters(at['rate'])}{r}" if i and rng.random() < 0.6 else None
                cells[r, c] = (None, float(rng.randrange(9)), money)
    return cells


def text(cell):
    t = re.sub(r"\s+", " ", (cell or (None,))[0] or "").strip()
    return t if t and not t.startswith("=") else None


def read_one(cells, name):
    """Rows of one sheet."""
    rows = {}
    for (r, c), cell in sorted(cells.items()):
        rows.setdefault(r, {})[c] = cell
    at = r0 = None
    for r in sorted(rows):
        places = {}
        for c, cell in sorted(rows[r].items()):
            said = re.sub(r"\s+", " ", cell[0] or "").strip().lower()
            said = "total" if said.startswith("total") else said
            if said in LABELS:
                places.setdefault(LABELS[said], []).append(c)
        if "qty" in places and "rate" in places:
            at, r0 = {}, r
            for b in BINDS:
                own = places.get(b.label, [])
                beyond = [c for c in own if b.after in at and c > at[b.after]] if b.after else own
                got = beyond or (own if b.any else [])
                if got:
                    at[b.meaning] = got[0]
            break
    if at is None:
        return []
    qty = at["qty"]
    if "uom" not in at:
        near = [(r, c) for r in range(r0 - 3, r0 + 5) for c in sorted(rows.get(r, {})) if (rows[r][c][0] or "").strip().lower() in ("uom", "unit")]
        if near:
            at["uom"] = near[0][1]
    counts = {}
    for (r, c), cell in cells.items():
        if 0 < r - r0 <= 120 and c < qty and len((cell[0] or "").strip()) > 6 and not cell[0].startswith("="):
            counts[c] = counts.get(c, 0) + 1
    desc = min(counts, key=lambda c: (-counts[c], c)) if counts else at.get("desc", 2)
    tag = at.get("tag", 1 if desc > 1 else None)
    # columns of phases
    near = [(r, c, text(cell)) for (r, c), cell in sorted(cells.items()) if -8 <= r - r0 <= 10 and c <= qty and (cell[0] or "").strip()]
    with_phase = [r for r, c, t in near if t and re.match(W.phase, t)]
    groups = {c: t for r, c, t in near if t and with_phase and r == min(with_phase) and not hit(W.headerish, t) and len(t) <= 30}
    areas = {c: t.upper() for r, c, t in near if t and hit(W.area, t)}
    quantity = [(c, t, True) for c, t in {c: t for r, c, t in near if t and hit(W.building, t)}.items()]
    money = {}
    for (r, c), cell in sorted(cells.items()):
        m = re.match(PRODUCT, cell[2] or "")
        if m and 0 < r - r0 <= 80 and c < qty:
            pair = [number(x) for x in m.groups()]
            if at["rate"] in pair and pair != [at["rate"]] * 2:
                money[c] = next(x for x in pair if x != at["rate"])
    if groups:
        cols = set(money.values()) | {c for c in areas if c < qty} or {c for c in groups if c < qty}
        for c in cols - set(money):
            before = [g for g in sorted(groups) if g <= c]
            label = groups[before[-1] if before else min(groups)]
            m = re.match(W.phase, label)
            quantity.append((c, (f"Phase {m.group(1)}" if m else label) + (f" {areas[c]}" if c in areas else ""), False))
    out, section, title, contractor, seen = [], None, None, False, False
    whole = [text(cells[r, c]) for r in range(r0 - 6, r0) for c in range(1, qty) if text(cells.get((r, c))) and hit(W.note, text(cells[r, c])) and len(text(cells[r, c])) > 15]
    part = []
    for r in sorted(x for x in rows if x > r0):
        row = rows[r]
        value = lambda m, row=row: row.get(at.get(m), (None, None, None))
        d = text(row.get(desc))
        q, rate, supply, total, supply_total = (value(m)[1] for m in ("qty", "rate", "supply", "total", "supply_total"))
        blank = dict.fromkeys(("section", "basis", "tag", "uom", "qty", "rate", "supply", "total", "supply_total", "percent", "amount", "notes", "phase_qty"))
        if any(text(c) and hit(W.total, text(c)) for c in row.values()) and not d:
            out.append(blank | {"row": r, "kind": "total", "description": None, "total": total, "supply_total": supply_total, "amount": total})
            continue
        if not d or hit(W.headerish, d):
            continue
        basis_title = title or ""
        if hit(W.note, d):
            (part if seen else whole).append(d)
            kind = "note"
        elif hit(W.contractor, d):
            contractor, section, part, kind = True, "Contractor Items", [], "section"
        else:
            uom = text(value("uom")) if "uom" in at else None
            right = [c[1] for k, c in row.items() if k > desc and c[1]]
            item = bool(uom) or q is not None or value("qty")[2] is not None or rate is not None or supply is not None
            item = item or ((hit(W.delivery, d) or hit(W.lump, d)) and (not d.isupper() or bool(right)))
            item = item or (contractor and hit(W.monthly, d) and not d.isupper())
            kind = "item" if item else "section"
            if not item:
                section, title, part, seen = d, d, [], True
                basis_title = d
        t = basis_title
        by_title = "install_only" if hit(W.free_issue, t) else "supply_and_install" if hit(W.supply_install, t) else "supply_only" if hit(W.supply_only, t) or hit(W.optional, name) else "install_only" if hit(W.install_only, t) else None
        if kind != "item":
            out.append(blank | {"row": r, "kind": kind, "description": d})
            continue
        month = uom is None or uom.lower() in MONTHS
        monthly = hit(W.monthly, d) and month and (rate is None or rate >= 1000) and not hit(W.not_monthly, d)
        percent = amount = None
        said = max([x for x in (total, supply_total) if x], default=None)
        if contractor or monthly or hit(W.delivery, d) or (hit(W.lump, d) and not uom and q is None):
            if hit(W.delivery, d):
                kind, basis = "delivery", "percent"
                percent = q if uom == "%" else None
                amount = said or max([c[1] for k, c in row.items() if k > qty and c[1] and (percent is None or c[1] != percent)], default=None)
            elif hit(W.lump, d) and not hit(W.monthly, d):
                kind, basis = "lump_sum", "lump_sum"
                amount = said or max(right, default=None) or (q if rate is None and q and q > 100 else None)
            else:
                kind, basis = "contractor", "lump_sum" if hit(W.tools, d) and not (month and hit(W.monthly, d)) else "monthly"
        else:
            basis = by_title or ("supply_and_install" if rate is not None and supply is not None else "supply_only" if supply is not None else "install_only" if rate is not None else None)
            if basis == "supply_only" and rate is not None and "supply" not in at:
                supply, rate = rate, None
        sums = {}
        for c, label, building in sorted(quantity, key=lambda x: x[2]):
            v = row.get(c, (None, None))[1]
            if v:
                sums[label] = v if building else sums.get(label, 0) + v
        mark = text(row.get(tag)) if tag and tag != desc else None
        out.append({"row": r, "kind": kind, "description": d, "section": section, "basis": basis, "tag": mark, "uom": uom, "qty": q, "rate": rate, "supply": supply, "total": total, "supply_total": supply_total, "percent": percent, "amount": amount, "notes": whole + part, "phase_qty": sorted(sums.items()) or None})
    return out


def flat(row):
    return {k: [tuple(x) for x in v] if k == "phase_qty" and v else v for k, v in row.items()}


def test_random_layouts_against_one_sheet_at_a_time(spark):
    rng = random.Random(12)
    sheets = {i: random_sheet(rng) for i in range(60)}
    names = {i: "Optional extras" if i % 9 == 0 else f"Sheet {i}" for i in sheets}
    rows = [(i, r, c, *cell) for i, s in sheets.items() for (r, c), cell in s.items()]
    rows += [(99, 1, 1, "no header here", None, None)]
    cells = spark.createDataFrame(rows, "sheet long, row int, col int, text string, number double, formula string")
    vocabulary = spark.createDataFrame(list(LABELS.items()), "label string, meaning string")
    named = spark.createDataFrame(list(names.items()), "sheet long, name string")
    got = {}
    for r in read_pricing(cells, vocabulary, named).collect():
        x = r.asDict(recursive=False)
        sheet = x.pop("sheet")
        got.setdefault(sheet, {})[x["row"]] = flat(x)
    assert 99 not in got
    seen = set()
    for i, s in sheets.items():
        want = {x["row"]: flat(x) for x in read_one(s, names[i])}
        for r in want:
            assert got[i].get(r) == want[r], (i, r)
            seen |= {want[r]["kind"]} | ({"phases"} if want[r]["phase_qty"] else set())
        assert len(got.get(i, {})) == len(want)
    assert seen >= {"item", "section", "note", "total", "delivery", "lump_sum", "contractor", "phases"}


def test_nothing(spark):
    cells = spark.createDataFrame([], "sheet long, row int, col int, text string, number double, formula string")
    vocabulary = spark.createDataFrame(list(LABELS.items()), "label string, meaning string")
    assert read_pricing(cells, vocabulary).count() == 0


def cells_of(spark, sheets):
    """Cells of sheets given as rows of texts and numbers; texts that begin with = are formulas."""
    rows = []
    for name, lines in sheets.items():
        for r, line in enumerate(lines, 1):
            for c, x in enumerate(line, 1):
                if x is not None:
                    formula = x if isinstance(x, str) and x.startswith("=") else None
                    rows.append((name, r, c, x if isinstance(x, str) and not formula else None, float(x) if isinstance(x, int | float) else None, formula))
    return spark.createDataFrame(rows, "sheet string, row int, col int, text string, number double, formula string")


WORKBOOK = {
    "Summary": [["Project:", None, "Goodman FRA5"], ["Date", 45000], ["Package", None, None, None, None, None, "too far"], ["Package", "Lighting"], ["Cost summary"], [None, "Containment supply", "E", "='Tray Pricing'!$F$9"], [None, "Optional lighting", "O", "=[2]Lights!B4", "not participating"], ["x", "abc"], ["Total", 5], ["Beyond the total", "O"]],
    "Attendance": [["", "Item", "Main contractor", "Sub-contractor"], [1, "Cranes", "x"], [2, "Skips", None, "x"], [3, None, None, "x"], [4, "Welfare", "x", " "]],
    "Prelims": [["Ref", "Description", "Quantity", "Unit", "Rate", "Total"], ["A"], [None, "Heading"], ["B", "Site manager", 12, "Weeks", "=X1", 900], ["C", "Cabin", 3, "month", 100.0], ["D", "Insurance", None, None, 5.0], [None, "Total - c/f", 1], ["E", "after", 1, "week", 2]],
    "Tray Pricing": [["Description", "Qty", "UoM", "Rate"], ["Cable tray 100mm", 5, "m", 3]],
    "Sheet7": [["nothing"]],
    "Takeoff": [["Folder", "Dimension Group", "Qty"]],
}


def test_a_workbook_is_routed_and_read(spark):
    cells = cells_of(spark, WORKBOOK)
    vocabulary = spark.createDataFrame(list(LABELS.items()), "label string, meaning string")
    names = spark.createDataFrame([(n, n) for n in [*WORKBOOK, "Notes"]], "sheet string, name string")
    found = layout(cells, vocabulary)
    assert {r["sheet"]: (r["kind"], r["package"]) for r in sheet_kinds(cells, names, found).collect()} == {"Summary": ("summary", None), "Attendance": ("attendance", None), "Prelims": ("prelims", "prelims"), "Tray Pricing": ("pricing", "containment"), "Sheet7": ("calc", None), "Takeoff": ("takeoff", None), "Notes": ("other", None)}
    assert {tuple(r) for r in attendance(cells).where("sheet IN ('Attendance', 'Sheet7')").collect()} == {("Attendance", 3, 1), ("Sheet7", 0, 0)}
    got = read_prelims(cells, found.where("sheet = 'Prelims'")).orderBy("row").collect()
    assert [tuple(r)[1:] for r in got] == [(4, "B", "Site manager", 12.0, "week", None, 900.0, "weekly", True), (5, "C", "Cabin", 3.0, "month", 100.0, None, "monthly", False), (6, "D", "Insurance", None, None, 5.0, None, "lump_sum", False)]
    fields = {r["field"]: r["value"] for r in summary_fields(cells.where("sheet = 'Summary'")).collect()}
    assert fields == {"project": "Goodman FRA5", "doc_date": "45000.0", "package": "Lighting"}
    lines = cost_lines(cells.where("sheet = 'Summary'")).orderBy("row").collect()
    assert [tuple(r)[1:] for r in lines] == [(6, "Containment supply", "E", "Tray Pricing", "F9", False, "containment", True, False, False), (7, "Optional lighting", "O", "Lights", "B4", True, "containment", False, False, True)]
    links = spark.createDataFrame([("Summary!D6", "Tray Pricing!F9"), ("Tray Pricing!F9", "Tray Pricing!F8"), ("Tray Pricing!F8", None)], "source string, target string")
    assert {tuple(r) for r in followed(links).collect()} == {("Summary!D6", "Tray Pricing!F8", 2), ("Tray Pricing!F9", "Tray Pricing!F8", 1)}


def test_a_row_meets_its_header_once_and_where_it_lies(spark, sf_dir):
    """Preliminaries of orders: the lines are placed by sheet, and nothing is placed again."""
    from rubicost import registry

    plan = registry.QUERIES["prelims_rows"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 4 and "Union" not in plan
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(sheet" in x and " col#" in x]
