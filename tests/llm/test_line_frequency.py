from collections import Counter

from rubicost.llm import line_frequency as lf
from tests.llm.data import odd_documents, untouched


def test_base_stats():
    assert lf.base_stats(None) == (0, 0, 0, 0, 0)
    assert lf.base_stats("a b\na b\n\n \n#x") == (5, 6, 1, 1, 0)
    text = "a b c d e x a b c d e"
    assert lf.base_stats(text)[4] == 10
    assert lf.repeated_words("a a a a a a".split()) == 6


def test_frequent_lines_are_counted_by_host(spark):
    rows = [(i, f"Same  LINE here\nown line {i} of words", "h1") for i in range(6)] + [(10 + i, "Same line here", "h2") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["rejected"] for r in lf.remove_frequent_lines(docs, min_docs=3, share=0.1, depleted=0.3).collect()}
    assert all(got[i] for i in range(6)) and not got[10] and not got[11]
    kept = {r["doc_id"]: r["text"] for r in lf.cleaned_text(docs, min_docs=3, share=0.1).collect()}
    assert kept[0] == "own line 0 of words" and kept[10] == "Same line here"


def test_verdict_against_brute_force(spark):
    rows = [(i, "\n".join(f"line number {j} says things" for j in range(i % 7, i % 7 + 3)), f"h{i % 2}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["rejected"] for r in lf.remove_frequent_lines(docs, 5, 0.0, 0.7).collect()}
    counts = Counter((s, x) for _, t, s in rows for x in set(t.split("\n")))
    for i, t, s in rows:
        gone = sum(5 for x in t.split("\n") if counts[s, x] > 5)
        assert got[i] == (gone > 0.7 * 15)


def test_odd_rows(spark):
    for extra in (False, True):
        docs = odd_documents(spark, extra)
        got = lf.rules(docs)
        assert got.count() == docs.count()
        assert untouched(docs, lf.cleaned_text(docs))
        rows = {r["doc_id"]: r for r in got.collect()}
        assert rows[3]["base_failed"] and not rows[3]["kept"] and rows[0]["kept"]
    assert lf.rules(docs.limit(0)).count() == 0
