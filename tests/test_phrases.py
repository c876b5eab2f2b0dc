import random
import re

from rubicost.operators.phrases import labelled, phrase_join, stripped


def brute(texts, vocabulary):
    phrases = {}
    for phrase, label in vocabulary:
        words = tuple(re.findall(r"\w+", phrase.lower()))
        if words and (words not in phrases or (label, phrase) < phrases[words]):
            phrases[words] = (label, phrase)
    longest = max(map(len, phrases))
    out = set()
    for k, text in texts:
        words = re.findall(r"\w+", (text or "").lower())
        at = 0
        while at < len(words):
            n = next((n for n in range(longest, 0, -1) if tuple(words[at : at + n]) in phrases and at + n <= len(words)), 0)
            if n:
                label, phrase = phrases[tuple(words[at : at + n])]
                out.add((k, at, n, phrase, label))
            at += max(n, 1)
    return out


def test_fifty_thousand_phrases_against_brute_force(spark):
    rng = random.Random(14)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "x2"]
    vocabulary = [(" ".join(rng.choice(words) for _ in range(rng.choice((2, 2, 3, 4)))), f"l{rng.randrange(9)}") for _ in range(50_000)] + [("w7", "one"), ("W7", "two"), ("--", "none"), ("Ünï x2", "u")]
    texts = [(i, "; ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(80)] + [(99, None), (98, ""), (97, "w7 ünï, X2")]
    v = spark.createDataFrame(vocabulary, "phrase string, label string")
    t = spark.createDataFrame(texts, "k long, t string")
    found = phrase_join(t, "k", "t", v)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, vocabulary) and len(got) > 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "w299" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_labels_and_rests(spark):
    v = spark.createDataFrame([("red", "colour"), ("dark red", "colour"), ("steel", "stuff"), ("acme tools", "make")], "phrase string, label string")
    t = spark.createDataFrame([(1, "Dark-red steel, steel"), (2, "red steel"), (3, "acme tools"), (4, "none of it"), (5, None)], "k long, t string")
    assert {tuple(r) for r in labelled(t, "k", "t", v).collect()} == {(1, "stuff", 2), (2, "colour", 1), (3, "make", 1)}
    makes = v.where("label = 'make'")
    assert {tuple(r) for r in stripped(t, "k", "t", makes).collect()} == {(1, "dark red steel steel"), (2, "red steel"), (3, "acme tools"), (4, "none of it"), (5, "")}
    assert phrase_join(t, "k", "t", v.limit(0)).count() == 0


def test_single_words_of_a_long_text_are_counted_and_not_folded(spark):
    v = spark.createDataFrame([("red", "colour"), ("steel", "stuff")], "phrase string, label string")
    t = spark.createDataFrame([(1, "red steel red " * 5_000), (2, "steel")], "k long, t string")
    found = labelled(t, "k", "t", v)
    assert {tuple(r) for r in found.collect()} == {(1, "colour", 10_000), (2, "stuff", 1)}
    assert "array_append" not in found._jdf.queryExecution().optimizedPlan().toString()
