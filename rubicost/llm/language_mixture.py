"""Language identification by inference of a multilingual mixture.

A model holds, for each language, log-likelihoods of hashed letter trigrams
(words are padded with a space). A document is a mixture of languages: each of
its words comes from one language, with the likelihood of its trigrams.
Expectation-maximisation estimates the proportions; the set of languages is the
one with the highest likelihood less ``penalty`` * log(words) for each language
beyond the first, found by adding the best language at a time.

Fitting counts trigrams over a bounded sample of labelled documents: about
``sample`` rows, drawn by a hash of the row, as many of each language but no
fewer than about ``each`` where it has them, so that rare languages are learned
at any size. The model is ``buckets`` counts for each language and goes to the
tasks as a broadcast; more than ``max_languages`` different labels raise an
error, none is dropped.

Defined results: a text that is null or has no letter gets ``und`` with score
0, as does every text when no language could be learned; ties between
languages go to the smaller code point order; repeated rows get the same
result; an empty table gives no rows; other columns are ignored. Texts are
read whole, long ones in one pass with memory in proportion to their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubicost.llm.common import keep_slices, map_slices, slices

BUCKETS = 1 << 15
SAMPLE = 20_000
EACH = 500
MAX_LANGUAGES = 1_000
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>"


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter, first letter of each word, and the word's text number."""
    parts = [(t or "").lower() + "\n" for t in texts]
    raw = "".join(parts).encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(raw, dtype=np.uint32)
    is_letter = letters()[code]
    at = np.flatnonzero(is_letter)
    if not len(at):
        return at, at, at
    code = np.where(is_letter, code, 32).astype(np.uint64)
    before = np.where(at > 0, code[at - 1], 32)
    mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (code[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (code[at + 1] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (mixed >> np.uint64(40)) % np.uint64(buckets)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    ends = np.cumsum([len(p) for p in parts])
    return bucket.astype(np.int64), first, np.searchsorted(ends, at[first], side="right")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document stands outside of the fit; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Names in code point order and log-likelihoods, languages by buckets."""

    def __init__(self, names: list[str], logs: np.ndarray) -> None:
        self.names, self.logs = names, logs


def fit(documents: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS, smoothing: float = 0.1, max_languages: int = MAX_LANGUAGES, each: int = EACH) -> Model:
    """Counts trigrams by language over a sample of labelled rows that aren't held out."""
    usable = documents.where(F.col("lang").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    by = usable.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(by) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    wanted = max(each, sample // max(1, len(by)))
    shares = F.broadcast(documents.sparkSession.createDataFrame([(r["lang"], min(1.0, wanted / r["count"])) for r in by], "l string, share double"))  # at most max_languages rows
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(1 << 53)) / float(1 << 53)
    chosen = usable.join(shares, F.col("lang") == F.col("l")).where(draw < F.col("share")).select("lang", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 128, 1 << 20):
                part = part.to_pydict()
                for lang in set(part["lang"]):
                    got, _, _ = trigrams([t for t, x in zip(part["text"], part["lang"], strict=True) if x == lang], buckets)
                    sums[lang] = sums.get(lang, 0) + np.bincount(got, minlength=buckets)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(counts[at].astype(np.int64))})

    names = sorted(r["lang"] for r in by)
    counts = chosen.mapInArrow(task, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((buckets, len(names)))
    if names:
        found = counts.toPandas()  # at most buckets * max_languages rows
        table[found["bucket"].to_numpy(), [names.index(x) for x in found["lang"]]] = found["n"]
    known = table.sum(0) > 0
    names, table = [x for x, k in zip(names, known, strict=True) if k], table[:, known]
    return Model(names, np.log((table + smoothing) / (table.sum(0) + smoothing * buckets)).T.astype(np.float32).copy())


def em(lik: np.ndarray, sizes: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (languages by documents) and log-likelihoods of consecutive documents of ``sizes`` words.

    lik has a row for each language and a column for each word, scaled to a largest entry of 1.
    """
    first = np.cumsum(sizes) - sizes
    share = np.full((len(lik), len(sizes)), 1 / len(lik), dtype=np.float32)
    for _ in range(rounds):
        joint = [x * np.repeat(s, sizes) for x, s in zip(lik, share, strict=True)]
        scale = 1 / sum(joint)
        share = np.stack([np.add.reduceat(x * scale, first) for x in joint]) / sizes.astype(np.float32)
        share = np.maximum(share, 1e-9)
        share /= share.sum(axis=0)
    mixed = sum(x * np.repeat(s, sizes) for x, s in zip(lik, share, strict=True))
    return share, np.add.reduceat(np.log(mixed), first)


def infer(texts: list[str | None], model: Model, penalty: float) -> list[tuple[list[str], list[float]]]:
    """Languages of each text with their proportions, largest first."""
    out: list[tuple[list[str], list[float]]] = [([], []) for _ in texts]
    bucket, first, doc = trigrams(texts, model.logs.shape[1])
    if not len(bucket) or not model.names:
        return out
    present, sizes = np.unique(doc, return_counts=True)
    starts = np.cumsum(sizes) - sizes
    log = np.stack([np.add.reduceat(x[bucket], first) for x in model.logs])
    log = np.maximum(log - log.max(axis=0), -60)
    lik = np.exp(log)
    alone = np.stack([np.add.reduceat(x, starts) for x in log])
    share, full = em(lik, sizes)
    cost = penalty * np.log(sizes + 1)
    best = alone.argmax(axis=0)
    # no set can be likelier than all languages together
    several = full - alone.max(axis=0) > cost
    for i, at in enumerate(present):
        out[at] = [model.names[best[i]]], [1.0]
        if not several[i]:
            continue
        own, n = lik[:, starts[i] : starts[i] + sizes[i]], sizes[i : i + 1]
        chosen, value, parts = [int(best[i])], float(alone[best[i], i]), [1.0]
        while len(chosen) < len(model.names) and full[i] - value > cost[i]:
            tried = []
            for x in range(len(model.names)):
                if x not in chosen and share[x, i] > 1e-3:
                    got, ll = em(own[[*chosen, x]], n)
                    tried.append((float(ll[0]), -x, got[:, 0].tolist()))
            if not tried or max(tried)[0] - value <= cost[i]:
                break
            value, x, parts = max(tried)
            chosen.append(-x)
        ranked = sorted(zip(parts, chosen, strict=True), key=lambda p: (-p[0], model.names[p[1]]))
        out[at] = [model.names[x] for _, x in ranked], [float(p) for p, _ in ranked]
    return out


def identify(documents: DataFrame, model: Model | None = None, penalty: float = 4.0, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, shares; fits a model where none is given."""
    model = model or fit(documents, **options)
    shared = documents.sparkSession.sparkContext.broadcast((model.names, model.logs))

    def start():
        fitted = Model(*shared.value)

        def work(cols):
            got = infer(cols["text"], fitted, penalty)
            return {
                "doc_id": cols["doc_id"],
                "held_out": cols["held_out"],
                "lang_pred": [names[0] if names else UNKNOWN for names, _ in got],
                "score": [min(1.0, parts[0]) if parts else 0.0 for _, parts in got],
                "languages": [names for names, _ in got],
                "shares": [parts for _, parts in got],
            }

        return work

    return map_slices(documents.select("doc_id", held_out().alias("held_out"), "text"), start, SCHEMA, rows=128, volume=1 << 20)


def keep_identified(documents: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """Documents with one language that has at least ``least`` of their words; columns stay.

    Rejected are texts without letters and texts in which no language prevails.
    """
    model = fit(documents, **options)
    shared = documents.sparkSession.sparkContext.broadcast((model.names, model.logs))

    def start():
        fitted = Model(*shared.value)
        return lambda texts: [bool(parts) and parts[0] >= least for _, parts in infer(texts, fitted, 4.0)]

    return keep_slices(documents, "text", start, rows=128, volume=1 << 20)
