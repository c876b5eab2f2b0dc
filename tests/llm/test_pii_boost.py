import hashlib
import random
import re

import numpy as np

from rubicost.llm import pii_boost as pb
from rubicost.llm.queries import op5_pii_boost
from tests.llm.data import odd_documents, untouched

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TEXTS = [
    "a.b@c.example.com x@y @z.de q@@w.com a@b.c@d.e",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3 0000000000001.2.3.4",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 12 34 5",
    "+1 (743) 555-3824 +1(()) +12 3 +49 30 1234567 ext +",
    "mail é@x.de ü.a@b.co, +1.2.3.4.5.6.7.8",
]


def plain(text):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15],
    }


def test_base_spans():
    for text in TEXTS:
        assert pb.base_spans(text) == plain(text)
    assert pb.base_spans(None) == {k: [] for k in pb.KINDS}


def test_base_spans_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in docs.collect():
        assert pb.base_spans(r["text"]) == plain(r["text"])
    model = pb.fit(docs)
    for r in docs.limit(200).collect():
        base, every = pb.spans_of(r["text"], model)
        assert all(set(base[k]) <= set(every[k]) for k in pb.KINDS)


def test_trees_learn_and_thresholds_are_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 22))
    x[:, 0] = rng.integers(0, 4, 3000)
    y = (x[:, 3] > 0.3) & (x[:, 5] < 1)
    held = np.arange(3000) % 3 == 0
    m = pb.Boosted().fit(x, y, held, 0.95)
    s = m.score(x[held])
    assert ((s >= 0.5) == y[held]).mean() > 0.97
    for i, k in enumerate(pb.KINDS):
        own = x[held][:, 0] == i
        assert m.thresholds[k] <= 1 and y[held][own & (s >= m.thresholds[k])].mean() >= 0.95


def test_masking():
    text = "call +1 (743) 555-3824 or a@b.de"
    assert pb.masked(text, pb.base_spans(text)) == "call [PHONE] or [EMAIL]"
    assert pb.masked(None, {}) is None


def test_odd_rows(spark):
    for extra in (False, True):
        docs = odd_documents(spark, extra)
        rows = {r["doc_id"]: r for r in pb.find(docs).collect()}
        assert (rows[11]["n_email"], rows[11]["n_ip"], rows[11]["n_phone"]) == (1, 1, 1) and rows[3]["spans"] == ""
        clean = pb.redact(docs)
        assert untouched(docs, clean) and clean.count() == docs.count()
    assert pb.find(docs.limit(0)).count() == 0


def test_hidden_spans_are_added_and_plain_numbers_are_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pb.fit(docs)
    hidden = {
        "email": ["john.smith (at) example (dot) com", "bob [at] corp [dot] org", "jane at example dot com"],
        "ip": ["10[.]20[.]30[.]40"],
        "card": ["4111.1111.1111.1111", "4111/1111/1111/1111"],
        "phone": ["(743) 555-3824", "1 743 555 3824"],
    }
    for kind, spans in hidden.items():
        for span in spans:
            text = f"thon er {span}. Then we go"
            assert pb.base_spans(text) == {k: [] for k in pb.KINDS}
            assert [text[a:b] for a, b in pb.spans_of(text, model)[1][kind]] == [span], span
    for text in ("on 2024-01-15 we sold 1234567890123456 units at 12.50 each", "we met at noon. Then we left", "version 3.14.15, 10 000 people, 1999-2004, pages 12-15", "total 1.250.000 on 12/05/2023"):
        assert pb.spans_of(text, model)[1] == {k: [] for k in pb.KINDS}, text


def test_every_text_with_a_marker_is_searched():
    text = "write to jane at example.com"
    assert ("email", 9, 28) in pb.candidates(text, pb.base_spans(text))


def test_contract_on_a_corpus(spark):
    """Counts, digest and spans of the query against plain patterns; the sample is bounded and drawn by place."""
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_pii_boost(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        base = plain(docs[r["doc_id"]])
        listed = [f"{k}:{a}:{b}" for k in pb.KINDS for a, b in base[k]]
        assert [r[f"n_{k}"] for k in pb.KINDS] == [len(base[k]) for k in pb.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert set(listed) <= set(r["spans"].split(",")) and spans == sorted(spans, key=lambda x: (pb.KINDS.index(x[0]), x[1]))
        assert all(0 <= a < b <= len(docs[r["doc_id"]]) for _, a, b in spans)


def planted(rng, n):
    """Texts that hold spans the base rules can't see, and as many with look-alikes that are none."""
    hidden, plain_ = [], []
    word = lambda: "".join(rng.choice("aeioumnrstl") for _ in range(rng.randrange(3, 8)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    for _ in range(n):
        kind = rng.choice(pb.KINDS)
        if kind == "email":
            span = f"{word()}.{word()} (at) {word()} (dot) com"
        elif kind == "ip":
            span = "[.]".join(str(rng.randrange(1, 255)) for _ in range(4))
        elif kind == "card":
            body = "4" + digits(14)
            card = next(body + d for d in "0123456789" if pb.luhn(body + d))
            span = ".".join(card[i : i + 4] for i in range(0, 16, 4))
        else:
            span = f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{digits(4)}"
        hidden.append((kind, f"{word()} {word()} {span}. {word().title()} {word()}", span))
        plain_.append(f"{word()} {word()} at {word()}. {word().title()} {rng.randrange(1, 28)}/{rng.randrange(1, 12)}/{rng.randrange(1990, 2024)}, {digits(1)}.{digits(3)}.{digits(3)} {word()} {rng.randrange(1900, 2000)}-{rng.randrange(2000, 2024)}")
    return hidden, plain_


def test_added_spans_on_the_smaller_corpus(spark):
    model = pb.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert any(np.isfinite(t) for t in model.thresholds.values())
    hidden, plain_ = planted(random.Random(8), 300)
    hits = extra = 0
    by_kind = {k: [] for k in pb.KINDS}
    for kind, text, span in hidden:
        assert not any(pb.base_spans(text).values())
        found = [text[a:b] for a, b in pb.spans_of(text, model)[1][kind]]
        hits += span in found
        by_kind[kind].append(span in found)
        extra += any(x not in span for x in found)
    wrong = sum(any(pb.spans_of(t, model)[1].values()) for t in plain_)
    print("recall", hits / 300, "with other spans", extra / 300, "look-alikes taken", wrong / 300)
    assert all(sum(x) >= 0.9 * len(x) for x in by_kind.values()), {k: (sum(x), len(x)) for k, x in by_kind.items()}
    assert wrong <= 0.05 * 300


def test_the_model_comes_from_every_example(spark, monkeypatch):
    """Trees and thresholds of tasks are those of all examples in one array, however many and however they are dealt."""
    more = spark.createDataFrame([(f"write to name{i}.of{i * i}@host{i % 7}.example.com today",) for i in range(200)], "text string")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").unionByName(more)
    best = {}
    for text in {r["text"] for r in docs.select("text").collect() if r["text"] and re.search("[0-9@]|at", r["text"])}:
        for place, fold, x, y, base in pb.examples(text):
            row = (bytes(min(int(v), 255) for v in x), y, fold == 0, base)
            best[place] = min(row, best.get(place, row))
    rows = list(best.values())
    assert len(rows) > 20_000 and pb.counted_examples(docs).groupBy().sum("n").collect()[0][0] == len(rows)
    x = np.array([list(r[0]) for r in rows])
    y, held, base = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
    whole = pb.Boosted().fit(x, y, held, 0.98, judged=~base)
    monkeypatch.setattr(pb, "ROWS", 300)
    dealt = pb.fit(docs)
    assert len(whole.trees) == 40 and dealt.trees == whole.trees and dealt.thresholds == whole.thresholds


def test_no_more_blocks_than_the_examples_need(spark, monkeypatch):
    """Each of the 120 passes is a task for each block: few rows stay one block in a session that deals what goes by key to many tasks."""
    kind, seen = type(spark.range(0)), []
    repartition = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *cols: repartition(self, max(n, 60) if cols else n, *cols))
    monkeypatch.setattr(pb.Boosted, "fit_blocks", lambda self, blocks, precision: seen.append(sorted(int(b[-1].sum()) for b in blocks.collect())) or self)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = pb.counted_examples(docs).persist()
    distinct, rows = counts.count(), counts.groupBy().sum("n").collect()[0][0]
    pb.fit(docs)
    monkeypatch.setattr(pb, "ROWS", -(-distinct // 3))
    pb.fit(docs)
    counts.unpersist()
    assert [len(blocks) for blocks in seen] == [1, 3] and [sum(blocks) for blocks in seen] == [rows, rows]
