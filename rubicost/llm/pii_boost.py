"""PII by candidate gradient boosting.

Fixed rules find base spans (``base_spans``); these always stay. High-recall
generators propose further, overlapping spans: obfuscated addresses, numbers
with other separators, national telephone formats. Each candidate gets format
features (digits, groups, separators, check sums) and context features (the
characters around it, key words before it). Gradient boosted trees, fitted with
logistic loss on all examples of the corpus, score them. Positives are candidates that a
validated base span of the kind covers for the most part, and base spans written
anew in the forms of the generators in their own place (``rewritten``), so that
what base rules cannot see is learned. Negatives are candidates that a check
rules out, that lie in a span of another kind, or that are ordinary prose or
numbers without a key word before them (``verdict``); all others are unknown and
are left out. For each kind the threshold is the lowest at which the precision
on a held-out part reaches ``precision``, counted without base spans, which stay
anyway; the precision of a kind with few held-out positives is shrunk to that of
all kinds together, and only a kind without any adds nothing. A candidate is at
most ``LONGEST`` characters long; no card, address or number reaches that. Rewritten spans are
more frequent there than in the corpus, so the precision on a corpus may be
lower. Selected spans that overlap a base span or a better one are dropped.

Offsets are code points, ends exclusive. Examples are counted by features and
label in tasks. A tree's level needs sums of gradients by node, feature and bin,
a threshold counts by score (in steps of 1 / GRID): these, of a fixed size
whatever the corpus, and the trees are all that goes through the driver.
Gradients are whole multiples of 1 / SCALE, so sums don't depend on how rows are
dealt. Every text is searched whole, none of its examples is left out.

Defined results: a null text is empty and has no spans; repeated rows get equal
results; null ids are kept; with no candidates in the corpus only base spans
remain; an empty table gives no rows; ``find`` ignores other columns and
``redact`` passes them through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubicost.llm.common import ddl, discard, map_slices, saved

KINDS = ("email", "ip", "card", "phone")
#: characters of a candidate
LONGEST = 200
#: steps of scores between 0 and 1
GRID = 1 << 14
#: steps of a gradient
SCALE = 1 << 24
#: distinct examples of a task
ROWS = 200_000
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

# Fixed patterns of the base rules. The look-behind starts a search for numbers
# at the head of a run of digits, where the leftmost match has to start anyway.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

GENERATORS = {
    "email": [
        re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z0-9-]{2,63}){1,4}"),
        re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\(dot\)|\[dot\]|\bdot\b) ?)[A-Za-z0-9-]{2,63}){1,4}"),
        re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{2,63}"),
    ],
    "ip": [re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9])")],
    "card": [re.compile(r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9]){12,18}(?![0-9])")],
    "phone": [
        re.compile(r"(?<![0-9+])(?:00|\+)?[(]?[0-9]{1,4}[)]?(?:[ ./-]{1,2}[(]?[0-9]{2,5}[)]?){1,5}(?![0-9])"),
        re.compile(r"(?<![0-9])[(]?[0-9]{2,4}[)]?[ ./-]{1,2}[0-9]{3,4}[ ./-]?[0-9]{3,4}(?![0-9])"),
    ],
}
# What each match of the generators for addresses holds.
AT = re.compile(r"@|\bat\b")
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "pay", "credit"),
    "phone": ("tel", "phone", "call", "mobile", "fax"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern: the longest run of local characters before an @ and a domain."""
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        floor = m.end() if m else at + 1
        if m:
            out.append((start, floor))
        at = text.find("@", floor)
    return out


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Validated spans of each kind; failing matches are dropped without a retry."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    out["email"] = emails(text)
    if DIGIT.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Proposed spans of all kinds, which may overlap; base spans are among them."""
    found = {(k, *s) for k, spans in base.items() for s in spans}
    has_digit = DIGIT.search(text)
    for kind, patterns in GENERATORS.items():
        if not (AT.search(text) if kind == "email" else has_digit):
            continue
        for p in patterns:
            found.update((kind, *m.span()) for m in p.finditer(text) if m.end() - m.start() <= LONGEST)
    return sorted(found)


def char_class(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isdigit() else 2 if c.isalpha() else 3


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = "".join(DIGIT.findall(span))
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g] or [0]
    octets = [int(g) <= 255 for g in re.split(r"[^0-9]+", span) if g and len(g) < 6]
    before = text[max(0, start - 30) : start].lower()
    return [
        float(KINDS.index(kind)), len(span), len(digits), sum(c.isalpha() for c in span), len(groups), max(groups), min(groups), groups[0], groups[-1],
        span.count(" "), span.count("-"), span.count("."), span.count("(") + span.count("["), span.count("/"), float("@" in span),
        float(luhn(digits)) if digits else 0.0, float(len(octets) == 4 and all(octets)),
        char_class(text[start - 1 : start] if start else ""), char_class(text[end : end + 1]), float(text[max(0, start - 2) : start].strip()[-1:] in "=\"'$#" and start > 0),
        float(any(w in before for w in CONTEXT[kind])), float(any(w in before for k, ws in CONTEXT.items() if k != kind for w in ws)),
        len(re.findall(r"\bdot\b", span)), span.count(". "), len(re.findall(r"[(\[]at[)\]]", span)),
    ]


def is_base(kind: str, start: int, end: int, base: dict[str, list[tuple[int, int]]]) -> bool:
    """Whether a base span of the kind covers most of a candidate."""
    return any(min(end, b) - max(start, a) >= 0.6 * (end - start) for a, b in base[kind])


def verdict(text: str, kind: str, start: int, end: int, base: dict[str, list[tuple[int, int]]]) -> bool | None:
    """Whether a candidate is a span of its kind: by base spans, checks, form and key words; None if unknown."""
    if is_base(kind, start, end, base):
        return True
    if any(a < end and start < b for spans in base.values() for a, b in spans):
        return False
    span = text[start:end]
    digits = DIGIT.findall(span)
    named = any(w in text[max(0, start - 30) : start].lower() for w in CONTEXT[kind])
    if kind == "email":
        bare = "@" not in span and not re.search(r"[(\[](?:at|dot)[)\]]|\bdot\b", span)
        return False if bare and (". " in span or not named) else None
    if kind == "ip":
        return False if any(int(g) > 255 for g in re.findall("[0-9]+", span)) else None
    if kind == "card":
        return None if luhn("".join(digits)) else False
    return None if named and 8 <= len(digits) <= 15 else False


def rewritten(kind: str, span: str) -> list[str]:
    """A base span in the forms that only generators find."""
    if kind == "email":
        local, _, domain = span.partition("@")
        forms = ((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", "."))
        # Without digits and with the last two labels only too, so that the shape of a corpus's addresses isn't taken for the mark of one.
        names = dict.fromkeys((local, x) for local in (local, re.sub("[0-9]+", "", local)) if local for x in (domain, ".".join(domain.split(".")[-2:])))
        return [name + at + x.replace(".", dot) for name, x in names for at, dot in forms]
    digits = "".join(DIGIT.findall(span))
    if kind == "ip":
        return [span.replace(".", dot) for dot in ("[.]", "(.)", " . ")]
    if kind == "card":
        return [by.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for by in (".", "/", "_", " - ")]
    groups = re.findall("[0-9]+", span)
    forms = [span[1:], "00" + span[1:], ".".join(groups), " ".join(groups)]
    return forms + ([re.sub(r"^[0-9]+[ .-]*", "", span[1:]), "-".join(groups[1:])] if len(groups) > 2 else [])


def plain_forms(kind: str, span: str) -> list[str]:
    """Prose with the words of an address; dates, years and amounts of the digits of a telephone number: none of the kinds."""
    d = "".join(DIGIT.findall(span))
    if kind == "email":
        local, _, domain = span.partition("@")
        words = [w for w in re.split(r"[^A-Za-z]+", span) if len(w) > 1]
        n = int(hashlib.blake2b(span.encode(), digest_size=2).hexdigest(), 16)
        return [f"{local} at {n % 90 + 10}.{n % 89 + 10}", f"{words[0]} at {n % 900}.{n % 89 + 10}", f"{words[0]} at {words[-1]}. {words[0].title()}"] if words else []
    if kind != "phone":
        return []
    return [f"{d[:4]}-{d[4:6]}-{d[6:8]}", f"{d[:2]}/{d[2:4]}/{d[4:8]}", f"{d[:2]}.{d[2:4]}.{d[4:8]}", f"{d[:4]}-{d[4:8]}", f"{d[0]}.{d[1:4]}.{d[4:7]}", f"{d[:2]} {d[2:5]} {d[5:8]}"]


def examples(text: str | None) -> list[tuple[int, int, list[float], bool, bool]]:
    """Labelled candidates of a text and of its rewritten base spans: place, fold, features, label, whether a base span."""

    def place(*key) -> int:
        return int.from_bytes(hashlib.blake2b(":".join(map(str, key)).encode(), digest_size=7).digest(), "big")

    base, out = base_spans(text), []
    for kind, a, b in candidates(text, base) if text else []:
        y = verdict(text, kind, a, b, base)
        if y is not None:
            at = place(kind, text[max(0, a - 20) : b + 20])
            out.append((at, at % 3, features(text, kind, a, b), y, y))
    for kind, spans in base.items():
        for a, b in spans:
            fold = place(kind, text[max(0, a - 20) : b + 20]) % 3
            left, after = text[max(0, a - 40) : a], text[b : b + 40]
            hidden_forms = rewritten(kind, text[a:b])
            forms = [(f, after, True) for f in hidden_forms] + [(f, after, False) for f in plain_forms(kind, text[a:b])]
            if kind == "email":  # the end of a sentence is no part of an address
                forms += [(f, f". And{after}", True) for f in hidden_forms]
            for form, tail, hidden in forms:
                near, start, end = left + form + tail, len(left), len(left) + len(form)
                own = base_spans(near)
                if any(x < end and start < y for spans in own.values() for x, y in spans):
                    continue
                for k, x, y in candidates(near, own):
                    right = hidden and (k, x, y) == (kind, start, end)
                    if right or x < end and start < y and (not hidden or k != kind or x < start or y > end):
                        out.append((place(k, "rewritten", near, x, y), fold, features(near, k, x, y), right, False))
    return out


def edges_of(values: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Upper ends of at most ``width`` bins of about as many rows each, but for the last one's; values in order, with their counts."""
    ends = np.cumsum(counts)
    return np.unique(values[np.searchsorted(ends, np.rint(np.linspace(0, 1, width) * (ends[-1] - 1)), side="right")])[:-1]


def level_sums(bins: np.ndarray, y: np.ndarray, n: np.ndarray, margin: np.ndarray, splits: dict[int, tuple[int, int]], nodes: list[int], width: int) -> np.ndarray:
    """Sums of gradients, of their derivatives (both times SCALE) and of rows: by node, kind of sum, feature and bin.

    Nodes are numbered as in a heap, from 1 on; ``splits`` are those above the level.
    """
    at = np.ones(len(bins), dtype=np.int64)
    for node, (f, b) in sorted(splits.items()):
        own = at == node
        at[own] = 2 * node + (bins[own, f] > b)
    p = 1 / (1 + np.exp(-margin))
    weights = [np.rint(v * SCALE) * n for v in (p - y, p * (1 - p))] + [n]
    slot = np.full(at.max(initial=1) + 1, -1)
    slot[[k for k in nodes if k < len(slot)]] = [i for i, k in enumerate(nodes) if k < len(slot)]
    slot = slot[at]
    own = slot >= 0
    out = np.zeros((len(nodes), 3, bins.shape[1], width), dtype=np.int64)
    for f in range(bins.shape[1]):
        place = slot[own] * width + bins[own, f]
        for i, w in enumerate(weights):
            out[:, i, f] = np.rint(np.bincount(place, w[own], minlength=len(nodes) * width)).astype(np.int64).reshape(-1, width)
    return out


def grow(sums: Callable[[dict, list[int]], np.ndarray], depth: int, l2: float = 1.0) -> tuple:
    """A regression tree over binned features, level by level: (value,) or (feature, bin, left, right)."""
    splits: dict[int, tuple[int, int]] = {}
    totals: dict[int, tuple[float, float]] = {}
    nodes = [1]
    for _ in range(depth):
        if not nodes:
            break
        below = []
        for node, (g, h, n) in zip(nodes, sums(splits, nodes), strict=True):
            g, h = g.cumsum(axis=1) / SCALE, h.cumsum(axis=1) / SCALE
            total_g, total_h = totals[node] = float(g[0, -1]), float(h[0, -1])
            if n[0].sum() < 20:
                continue
            gs, hs = g[:, :-1], h[:, :-1]
            gain = gs**2 / (hs + l2) + (total_g - gs) ** 2 / (total_h - hs + l2) - total_g**2 / (total_h + l2)
            best = (1e-6, None, None)
            for f, at in enumerate(gain.argmax(axis=1).tolist()):
                if gain[f, at] > best[0] + 1e-9:
                    best = (float(gain[f, at]), f, at)
            if best[1] is not None:
                _, f, at = best
                splits[node] = (f, at)
                totals[2 * node] = float(gs[f, at]), float(hs[f, at])
                totals[2 * node + 1] = total_g - float(gs[f, at]), total_h - float(hs[f, at])
                below += [2 * node, 2 * node + 1]
        nodes = below

    def tree(node: int) -> tuple:
        if node in splits:
            return (*splits[node], tree(2 * node), tree(2 * node + 1))
        return (-totals[node][0] / (totals[node][1] + l2),)

    return tree(1)


def tree_value(tree: tuple, bins: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(bins), tree[0])
    left = bins[:, tree[0]] <= tree[1]
    return np.where(left, tree_value(tree[2], bins), tree_value(tree[3], bins))


class Boosted:
    """Gradient boosted trees with logistic loss and a selection threshold for each kind."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, width: int = 32) -> None:
        self.rounds, self.depth, self.rate, self.width = rounds, depth, rate, width
        self.trees: list[tuple] = []
        self.edges: list[np.ndarray] = []
        self.prior = -20.0
        self.thresholds = dict.fromkeys(KINDS, np.inf)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.prior)
        for t in self.trees:
            total += self.rate * tree_value(t, bins)
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1 in steps of 1 / GRID."""
        return self.scored(self.bins(x)) if self.trees and len(x) else np.zeros(len(x))

    def scored(self, bins: np.ndarray) -> np.ndarray:
        return np.floor(GRID / (1 + np.exp(-np.clip(self.margin(bins), -35, 35)))) / GRID

    def boost(self, share: float, sums: Callable[[Boosted, dict, list[int]], np.ndarray]) -> None:
        """Grows the trees from the sums of each level; ``share`` of the rows are positive."""
        self.prior = float(np.log(share / (1 - share)))
        for _ in range(self.rounds):
            self.trees.append(grow(lambda splits, nodes: sums(self, splits, nodes), self.depth))

    def calibrate(self, kind: np.ndarray, scores: np.ndarray, positive: np.ndarray, rows: np.ndarray, precision: float, least: int = 20) -> Boosted:
        """Thresholds from the numbers of held-out positives and rows by kind and score."""

        def ranked(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Scores from the highest on, the positives and the rows up to each."""
            s, at = np.unique(-scores[own], return_inverse=True)
            return -s, *(np.cumsum(np.bincount(at, v[own], minlength=len(s))) for v in (positive, rows))

        all_s, all_t, all_n = ranked(rows > 0)
        for i, name in enumerate(KINDS):
            s, t, n = ranked((kind == i) & (rows > 0))
            good = np.flatnonzero((t / n >= precision) & (t >= least))
            if not len(good) and len(s):
                # few of a kind: as if it had ``least`` rows more, of the precision that all kinds have down to there
                at = np.searchsorted(-all_s, -s, side="right") - 1
                pooled = all_t[at] / all_n[at]
                good = np.flatnonzero(((t + least * pooled) / (n + least) >= precision) & (t > 0) & (all_t[at] >= least))
            if len(good):
                self.thresholds[name] = max(0.5, float(s[good[-1]]))
        return self

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, precision: float, least: int = 20, judged: np.ndarray | None = None) -> Boosted:
        """Fits on the rows of an array that aren't held out; calibrates the thresholds on those that are, of ``judged`` if given."""
        train = ~held
        if not y[train].any() or y[train].all():
            return self
        self.edges = [edges_of(*np.unique(x[train, f], return_counts=True), self.width) for f in range(x.shape[1])]
        bins, target, n = self.bins(x[train]), y[train].astype(float), np.ones(int(train.sum()))
        self.boost(target.mean(), lambda model, splits, nodes: level_sums(bins, target, n, model.margin(bins), splits, nodes, model.width))
        counted = held & (True if judged is None else judged)
        return self.calibrate(x[counted, 0], self.score(x[counted]), y[counted], np.ones(int(counted.sum())), precision, least)

    def fit_blocks(self, blocks: RDD, precision: float) -> Boosted:
        """The same from blocks in tasks: features, labels, held-out and base rows, and how many rows each stands for."""
        width = self.width

        def values(block: tuple) -> np.ndarray:
            x, y, held, _, n = block
            own = n * ~held
            by_value = np.stack([np.bincount(x[:, f], own, minlength=256) for f in range(x.shape[1])])
            return np.append(by_value.ravel(), (own * y).sum()).astype(np.int64)

        found = blocks.map(values).treeReduce(np.add)
        counts, positive = found[:-1].reshape(-1, 256), int(found[-1])
        rows = int(counts[0].sum())
        if positive in (0, rows):
            return self
        self.edges = [edges_of(np.flatnonzero(c), c[c > 0], width) for c in counts]
        edges = self.edges

        def binned(block: tuple) -> tuple:
            x = block[0]
            return (np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.uint8), x[:, 0], *block[1:])

        placed = blocks.map(binned).persist(StorageLevel.MEMORY_AND_DISK)

        def sums(model: Boosted, splits: dict, nodes: list[int]) -> np.ndarray:
            def own(block: tuple) -> np.ndarray:
                bins, _, y, held, _, n = block
                some = bins[~held]
                return level_sums(some, y[~held].astype(float), n[~held], model.margin(some), splits, nodes, width)

            return placed.map(own).treeReduce(np.add)

        self.boost(positive / rows, sums)
        model = self

        def judged(block: tuple) -> list[tuple]:
            bins, kind, y, held, base, n = block
            own = held & ~base
            if not own.any():
                return []
            at = kind[own].astype(np.int64) * (GRID + 1) + (model.scored(bins[own]) * GRID).astype(np.int64)
            places, inverse = np.unique(at, return_inverse=True)
            sums = (np.bincount(inverse, v).astype(np.int64).tolist() for v in (n[own] * y[own], n[own]))
            return list(zip(places.tolist(), zip(*sums, strict=True), strict=True))

        got = placed.flatMap(judged).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1])).collect()  # at most 4 * (GRID + 1) rows
        placed.unpersist()
        at, t, n = (np.array(v, dtype=np.int64) for v in ([k for k, _ in got], [v[0] for _, v in got], [v[1] for _, v in got]))
        return self.calibrate(at // (GRID + 1), at % (GRID + 1) / GRID, t, n, precision)


def counted_examples(documents: DataFrame) -> DataFrame:
    """x (a byte for each feature), y, held, base, n: the examples of all documents, those of one place once, counted by what a model sees of them."""

    def start():
        def work(cols):
            rows = [e for text in cols["text"] for e in examples(text)]
            x = np.minimum([e[2] for e in rows], 255).astype(np.uint8)  # only base spans are as long
            return {"place": [e[0] for e in rows], "x": [v.tobytes() for v in x], "y": [e[3] for e in rows], "held": [e[1] == 0 for e in rows], "base": [e[4] for e in rows]}

        return work

    some = documents.where(F.col("text").rlike("[0-9@]|at")).select("text")
    found = map_slices(some, start, "place long, x binary, y boolean, held boolean, base boolean")
    once = found.groupBy("place").agg(F.min(F.struct("x", "y", "held", "base")).alias("e"))
    return once.select("e.*").groupBy("x", "y", "held", "base").agg(F.count(F.lit(1)).alias("n"))


def fit(documents: DataFrame, precision: float = 0.98) -> Boosted:
    """Trees and thresholds from the examples of all documents."""
    counts = saved(counted_examples(documents))
    distinct = counts.count()
    if not distinct:
        discard(counts)
        return Boosted()

    def packed(rows):
        if rows := list(rows):
            x = np.frombuffer(b"".join(r["x"] for r in rows), np.uint8).reshape(len(rows), -1)
            yield (x, *(np.array([r[k] for r in rows]) for k in ("y", "held", "base", "n")))

    # dealt without a key: every level passes over all blocks, so there are no more than the rows need
    blocks = counts.repartition(-(-distinct // ROWS)).rdd.mapPartitions(packed)
    model = Boosted().fit_blocks(blocks, precision)
    discard(counts)
    return model


def spans_of(text: str | None, model: Boosted) -> tuple[dict, dict]:
    """Base spans and all selected spans of a text, by kind, in order of start."""
    base = base_spans(text)
    every = {k: list(v) for k, v in base.items()}
    proposed = [c for c in candidates(text, base) if model.thresholds[c[0]] <= 1 and c[1:] not in base[c[0]]] if text else []
    if proposed:
        scores = model.score(np.array([features(text, *c) for c in proposed]))
        taken = sorted(s for v in base.values() for s in v)
        for p, (kind, a, b) in sorted(zip(scores.tolist(), proposed, strict=True), key=lambda t: (-t[0], -(t[1][2] - t[1][1]), t[1])):
            if p >= model.thresholds[kind] and all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                every[kind].append((a, b))
    return base, {k: sorted(v) for k, v in every.items()}


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def find(documents: DataFrame, model: Boosted | None = None, **options) -> DataFrame:
    """doc_id, base counts by kind, digest of the base spans and all spans."""
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents, **options))

    def start():
        def work(cols):
            got = [spans_of(t, shared.value) for t in cols["text"]]
            counts = {f"n_{k}": [len(b[k]) for b, _ in got] for k in KINDS}
            return {"doc_id": cols["doc_id"]} | counts | {"base_sha256": [hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in got], "spans": [listed(e) for _, e in got]}

        return work

    return map_slices(documents.select("doc_id", "text"), start, SCHEMA)


def masked(text: str | None, spans: dict[str, list[tuple[int, int]]]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union is replaced."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, v in spans.items() for a, b in v):
        if b <= at:
            continue
        out.append(text[at : max(a, at)])
        if a >= at:
            out.append(f"[{kind.upper()}]")
        at = b
    return "".join(out) + text[at:]


def redact(documents: DataFrame, model: Boosted | None = None, **options) -> DataFrame:
    """The documents with personal data masked; ``n_chars``, where there is one, follows the text."""
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents, **options))

    def start():
        return lambda cols: cols | {"text": [masked(t, spans_of(t, shared.value)[1]) for t in cols["text"]]}

    out = map_slices(documents, start, ddl(documents))
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
