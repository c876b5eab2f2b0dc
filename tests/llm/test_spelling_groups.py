import random
import re
from collections import Counter
from zlib import crc32

from rubicost.llm import spelling_groups as sg
from tests.llm.data import odd_documents


def brute(rows, every=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 3}
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: best[w] if w in best and words[best[w]] >= 2 * words[w] else None for w in words}
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def corpus(seed, letters="abé", size=400):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(size)]
    return [(i, " ".join(rng.choice(base) + rng.choice(("", "", "X", "aa", " A")) for _ in range(120))) for i in range(30)]


def check(spark, rows, every=97, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in sg.groups(df, every=every, **options).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, every)
    return got


def test_against_brute_force(spark):
    # few letters: nearly all words are near many others, and bigrams repeat within a word
    assert any(r[1] and r[2] != r[1] for r in check(spark, corpus(1)))
    check(spark, corpus(2, "abcdefghijklmnopqrstuvwxyzß", 200), every=3)


def test_large_cells_are_dealt_out(spark):
    assert sorted(check(spark, corpus(3), block=4)) == sorted(check(spark, corpus(3)))


def test_near_words_share_a_cell():
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(5, 10)))
        i = rng.randrange(len(word) + 1)
        other = rng.choice((word[:i] + rng.choice("abc") + word[i:], word[:i] + rng.choice("abc") + word[i + 1 :]))
        if one_edit(word, other):
            frequency = Counter(w[i : i + 2] for w in (word, other) for i in range(len(w) - 1))
            assert set(sg.cells(word, frequency)) & set(sg.cells(other, frequency))


def test_odd_rows(spark):
    for extra in (False, True):
        docs = odd_documents(spark, extra)
        assert {tuple(r) for r in sg.groups(docs).collect()} == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sg.groups(docs.limit(0)).count() == 0
    long = [(1, "lettre " * 200_000 + "lettres " * 4)]
    check(spark, long)
