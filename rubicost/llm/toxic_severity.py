"""Toxicity severity by cumulative-link ordinal regression.

Features are the words of a text (letters only, lower-cased) and their stems (the
first ``STEMS`` letters, for inflected forms), each with 1 + log(count).
The model is P(grade <= j) = sigmoid(threshold_j - w . x): one weight vector is
shared by all ordered thresholds. Output is the expected grade.

Labels say only toxic or not, so grades come from them: 0 is not toxic; toxic
texts get 1 to 3 by their amount of features that go with the label (those whose
smoothed odds among toxic training texts are at least eightfold), cut at the
terciles of the toxic training texts.

Fitting uses a bounded sample: at most ``sample`` labelled documents, drawn by
a hash of the id, and at most ``vocabulary`` features found in ``min_df`` of them
whose presence depends on the label (likelihood ratio of at least ``evidence``).
It runs in one task over that sample; the weights (bounded by ``vocabulary``)
go to all tasks as a broadcast. Every document is scored over its whole text.

Defined results: a null text or one without letters has no features and gets
the grade of the bare thresholds; labels with a null id or flag are left out;
of contradicting labels of one id the toxic one counts; with no toxic label
every grade is 0; repeated rows get equal results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubicost.llm.common import map_slices

SAMPLE = 12_000
VOCABULARY = 50_000
GRADES = 3
STEMS = (4, 5)
LETTERS = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, severity int, expected_severity double, p_toxic double, toxic boolean"


def features(text: str | None) -> Counter:
    """Counts of the words and of their stems, which end in a hyphen."""
    words = Counter(LETTERS.findall(text.lower())) if text else Counter()
    out = Counter(words)
    for w, n in words.items():
        for k in STEMS:
            if len(w) >= k:
                out[w[:k] + "-"] += n
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def grade_probs(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Probability of each grade from scores w . x and ascending thresholds."""
    below = np.concatenate([np.zeros((len(score), 1)), sigmoid(cuts[None, :] - score[:, None]), np.ones((len(score), 1))], axis=1)
    p = np.maximum(np.diff(below, axis=1), 1e-12)
    return p / p.sum(axis=1, keepdims=True)


def severity_grades(counts: list[Counter], toxic: np.ndarray, words: list[str]) -> np.ndarray:
    """0 for texts that aren't toxic, else 1 to GRADES by tercile of the amount of label features."""
    df = Counter(w for c in counts for w in c)
    bad = Counter(w for c, t in zip(counts, toxic, strict=True) if t for w in c)
    n, m = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    odds = lambda w: ((bad[w] + 0.5) / n) / ((df[w] - bad[w] + 0.5) / m)
    lexicon = {w for w in words if odds(w) >= 8}
    amount = np.array([sum(1 + np.log(c[w]) for w in lexicon & c.keys()) for c in counts], dtype=float)
    cuts = np.quantile(amount[toxic], [i / GRADES for i in range(1, GRADES)]) if toxic.any() else np.zeros(GRADES - 1)
    return np.where(toxic, 1 + np.searchsorted(cuts, amount, side="left"), 0)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, width: int, l2: float = 0.3, rounds: int = 600, rate: float = 0.02, slow: float = 0.98) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by Adam on the penalised likelihood, all rows at each step."""
    n = len(y)
    w, first, gaps = np.zeros(width), np.array([2.0]), np.zeros(GRADES - 1)
    state = [np.zeros(width + GRADES), np.zeros(width + GRADES)]
    for t in range(1, rounds + 1):
        cuts = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        score = np.bincount(rows, vals * w[cols], minlength=n)
        low = np.where(y > 0, cuts[np.maximum(y - 1, 0)], -np.inf)
        high = np.where(y < GRADES, cuts[np.minimum(y, GRADES - 1)], np.inf)
        a, b = sigmoid(high - score), sigmoid(low - score)
        a, b = np.where(y == GRADES, 1.0, a), np.where(y == 0, 0.0, b)
        p = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        g_score = da - db  # of the negative log-likelihood, with respect to the score
        g_cut = np.bincount(np.minimum(y, GRADES), -da, minlength=GRADES + 1)[:GRADES] + np.bincount(np.maximum(y - 1, 0), np.where(y > 0, db, 0), minlength=GRADES)[:GRADES]
        g_w = np.bincount(cols, vals * g_score[rows], minlength=width) + l2 * w
        g = np.concatenate([g_w, [g_cut.sum()], [np.exp(gaps[k]) * g_cut[k + 1 :].sum() for k in range(GRADES - 1)]])
        state = [0.9 * state[0] + 0.1 * g, slow * state[1] + (1 - slow) * g * g]
        step = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - slow**t)) + 1e-8)
        w, first, gaps = w - step[:width], first - step[width : width + 1], gaps - step[width + 1 :]
    return w, np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def dependence(with_label: np.ndarray, found: np.ndarray, labelled: int, total: int) -> np.ndarray:
    """Likelihood ratio statistic of the presence of features against a label, from counts of texts."""
    cells = np.stack([with_label, found - with_label, labelled - with_label, total - labelled - found + with_label]).astype(float)
    share = np.array([labelled, total - labelled] * 2)[:, None] / total
    expected = share * np.stack([found, found, total - found, total - found])
    return 2 * (cells * np.log(np.maximum(cells, 1e-12) / np.maximum(expected, 1e-12))).sum(axis=0)


def train(texts: list[str | None], toxic: list[int], vocabulary: int = VOCABULARY, min_df: int = 3, evidence: float = 12.0) -> tuple[dict[str, float], list[float]]:
    """Weights by word and thresholds; no weights and far thresholds if nothing is toxic."""
    flags = np.array([bool(t) for t in toxic])
    if not flags.any():
        return {}, [50.0, 51.0, 52.0]
    counts = [features(t) for t in texts]
    df = Counter(w for c in counts for w in c)
    bad = Counter(w for c, t in zip(counts, flags, strict=True) if t for w in c)
    words = sorted(w for w, n in df.items() if n >= min_df)
    tied = dependence(np.array([bad[w] for w in words], dtype=int), np.array([df[w] for w in words], dtype=int), int(flags.sum()), len(flags))
    words = [words[i] for i in np.argsort(-tied, kind="stable")[:vocabulary] if tied[i] >= evidence]
    of = {w: i for i, w in enumerate(words)}
    y = severity_grades(counts, flags, words)
    triples = [(i, of[w], 1 + np.log(n)) for i, c in enumerate(counts) for w, n in c.items() if w in of]
    rows, cols, vals = (np.array(x) for x in zip(*triples, strict=True)) if triples else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    w, cuts = fit_ordinal(rows, cols, vals, y, len(words))
    return {x: float(v) for x, v in zip(words, w, strict=True) if abs(v) > 1e-4}, cuts.tolist()


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], list[float]]:
    """Draws the bounded sample, trains in one task and returns the bounded model."""
    flagged = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # about twice the sample is drawn by the hash first, so that no task has to sort labels of all partitions
    share = min(1.0, (2 * sample + 1000) / max(1, flagged.count()))
    place = F.xxhash64("doc_id", F.lit("severity"))
    drawn = flagged.where(place < int((share - 0.5) * (1 << 63) * 2) if share < 1 else F.lit(True)).orderBy(place, "doc_id").limit(sample)
    # at most ``sample`` rows, so both the broadcast and the one task are bounded; of rows with one id the first text counts
    texts = documents.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).limit(sample)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(i, t, x) for f in frames for i, t, x in zip(f["doc_id"], f["text"], f["toxic"], strict=True)]
        rows.sort(key=lambda r: r[0])
        weights, cuts = train([r[1] for r in rows], [r[2] for r in rows])
        yield pd.DataFrame({"word": [*weights, *[None] * len(cuts)], "value": [*weights.values(), *cuts]})

    got = texts.coalesce(1).mapInPandas(task, "word string, value double").collect()
    return {r["word"]: r["value"] for r in got if r["word"] is not None}, sorted(r["value"] for r in got if r["word"] is None)


def score_texts(texts: list[str | None], weights: dict[str, float], cuts: list[float]) -> np.ndarray:
    """Probability of each grade for each text."""
    total = np.array([sum(weights[w] * (1 + np.log(n)) for w, n in c.items() if w in weights) for c in map(features, texts)], dtype=float)
    return grade_probs(total, np.array(cuts))


def severity(documents: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """doc_id, severity (likeliest grade), expected_severity, p_toxic, toxic for each row of documents."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, **options))

    def start():
        weights, cuts = shared.value

        def work(cols):
            if not cols["doc_id"]:
                return {k: [] for k in ("doc_id", "severity", "expected_severity", "p_toxic", "toxic")}
            p = score_texts(cols["text"], weights, cuts)
            mean, any_ = np.minimum(p @ np.arange(p.shape[1]), GRADES), 1 - p[:, 0]
            return {"doc_id": cols["doc_id"], "severity": p.argmax(1).astype(np.int32), "expected_severity": mean, "p_toxic": any_, "toxic": any_ >= least}

        return work

    return map_slices(documents.select("doc_id", "text"), start, SCHEMA)
