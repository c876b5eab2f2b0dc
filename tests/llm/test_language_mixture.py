import math
import random

import numpy as np
import pytest

from rubicost.llm import language_mixture as lm
from rubicost.llm.queries import op1_language_mixture
from tests.llm.data import odd_documents, untouched


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = op1_language_mixture(spark, sf).join(truth, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mixture_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lm.fit(docs)
    text = {r["lang"]: r["text"] for r in docs.where("n_chars between 1500 and 4000 and lang in ('en', 'de')").collect()}
    both = text["en"][:1200] + "\n" + text["de"][:1200]
    (names, shares), (one, _) = lm.infer([both, text["en"]], model, 4.0)
    assert set(names) == {"en", "de"} and abs(sum(shares) - 1) < 1e-6 and min(shares) > 0.2
    assert one[0] == "en"


def test_odd_rows(spark):
    for extra in (False, True):
        docs = odd_documents(spark, extra)
        got = lm.identify(docs).collect()
        assert len(got) == docs.count()
        assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"}
        kept = lm.keep_identified(docs)
        assert untouched(docs, kept) and kept.schema == docs.schema and not {3, 4, 5} & {r["doc_id"] for r in kept.collect()}
    assert lm.identify(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", docs["lang"].substr(9, 1)).replace("", None, ["lang"])
    assert {r["lang_pred"] for r in lm.identify(unlabelled).collect()} == {"und"}


def test_rare_languages_are_learned_and_none_is_dropped(spark):
    rng = random.Random(4)
    tongue = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(n))
    rows = [(i, tongue("abcde", 40), "aa") for i in range(3000)] + [(10_000 + i, tongue("vwxyz", 40), "zz") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lm.fit(docs, sample=100, each=20)
    assert model.names == ["aa", "zz"]
    got = {r["doc_id"]: r for r in lm.identify(docs, model).collect()}
    assert all(r["lang_pred"] == ("aa" if i < 10_000 else "zz") for i, r in got.items())
    with pytest.raises(ValueError):
        lm.fit(docs, max_languages=1)


def test_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("same words here", "bb"), ("same words here", "aa")] * 8)], "doc_id long, text string, lang string")
    got = lm.identify(docs).collect()
    assert len({(r["lang_pred"], r["score"]) for r in got}) == 1


def test_em_against_one_document_at_a_time():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 7, 40, 3, 200])
    lik = rng.random((4, sizes.sum())).astype(np.float32) ** 3 + 1e-4
    lik /= lik.max(axis=0)
    share, value = lm.em(lik, sizes, rounds=12)
    at = 0
    for i, n in enumerate(sizes):
        own = [[float(x) for x in lik[:, k]] for k in range(at, at + n)]
        at += n
        parts = [0.25] * 4
        for _ in range(12):
            sums = [0.0] * 4
            for word in own:
                joint = [p * x for p, x in zip(parts, word, strict=True)]
                sums = [s + j / sum(joint) for s, j in zip(sums, joint, strict=True)]
            parts = [max(s / n, 1e-9) for s in sums]
            parts = [p / sum(parts) for p in parts]
        assert np.allclose(share[:, i], parts, atol=1e-4)
        assert abs(value[i] - sum(math.log(sum(p * x for p, x in zip(parts, word, strict=True))) for word in own)) < 1e-2


def test_sets_of_languages_against_all_sets():
    """Languages are added while the penalised likelihood grows: with two clear ones no other set of those tried is likelier."""
    rng = np.random.default_rng(4)
    lik = np.full((3, 60), 1e-3, dtype=np.float32)
    lik[0, :40] = lik[1, 40:] = 1.0
    lik[2] = 0.05 * rng.random(60).astype(np.float32)
    best = {}
    for chosen in ([0], [1], [2], [0, 1], [0, 2], [1, 2], [0, 1, 2]):
        _, value = lm.em(lik[chosen], np.array([60]))
        best[tuple(chosen)] = float(value[0]) - 4.0 * math.log(61) * (len(chosen) - 1)
    assert max(best, key=best.get) == (0, 1)
