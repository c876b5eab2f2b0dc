import random

import public_tokenizers
import pytest
import tiktoken

from rubicost.llm import bpe_chunks as bc
from rubicost.llm.queries import tokenizer
from tests.llm.data import odd_documents


@pytest.fixture(scope="module")
def vocabulary():
    ranks, pattern = tokenizer()
    return ranks, pattern, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_text(rng, n):
    parts = ["word", " the", "'re", "'", "\n\n", "   ", " \t", "é", "漢字", "12345", " $$$", "<|endoftext|>", "aaaa" * 9, "I'll", "x" * 300, " "]
    return "".join(rng.choice(parts) for _ in range(n))


def test_chunks_are_stitched_exactly(spark, vocabulary):
    ranks, pattern, own = vocabulary
    rng = random.Random(1)
    texts = [odd_text(rng, n) for n in (0, 1, 50, 400, 400, 800)] + ["a" * 700, " " * 500 + "b", "1" * 300 + "\n" * 300, ("ab " * 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk, overlap in ((64, 16), (100, 5), (333, 40), (10_000, 100)):
        got = {r["doc_id"]: (list(r["ids"]), bytes(r["data"])) for r in bc.decode_documents(bc.encode_documents(df, ranks, pattern, chunk, overlap), ranks).collect()}
        once = bc.encode_documents(df, ranks, pattern, chunk, overlap, decode=True)
        assert {r["doc_id"]: (list(r["ids"]), bytes(r["data"])) for r in once.collect()} == got
        for i, t in enumerate(texts):
            assert got[i] == (own.encode_ordinary(t), t.encode()), (chunk, i)


def test_corpus(spark, vocabulary):
    ranks, pattern, own = vocabulary
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bc.encode_documents(docs, ranks, pattern, 2000, 200).collect():
        assert list(r["ids"]) == own.encode_ordinary(texts[r["doc_id"]])


def test_odd_rows(spark, vocabulary):
    ranks, pattern, _ = vocabulary
    for extra in (False, True):
        docs = odd_documents(spark, extra)
        got = bc.digests(bc.encode_documents(docs, ranks, pattern, 1000, 100, decode=True))
        assert got.count() == docs.count()
        assert {r["n_tokens"] for r in got.where("doc_id IN (3, 4)").collect()} == {0}
    assert bc.encode_documents(docs.limit(0), ranks, pattern).count() == 0


def test_a_long_row_that_is_repeated(spark, vocabulary):
    ranks, pattern, own = vocabulary
    text = odd_text(random.Random(2), 900)
    rows = [(7, text)] * 300 + [(None, text)] * 3 + [(8, text), (7, text + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bc.once(df.withColumn("tk", bc.text_key())).count() == 4
    got = [(r["doc_id"], tuple(r["ids"]), bytes(r["data"])) for r in bc.encode_documents(df, ranks, pattern, 512, 64, decode=True).collect()]
    want = [(i, tuple(own.encode_ordinary(t)), t.encode()) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_very_long_texts_are_cut_in_one_pass(spark, vocabulary):
    ranks, pattern, own = vocabulary
    text = "abc défg 12345\n" * 150_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = bc.encode_documents(df, ranks, pattern, decode=True).collect()
    assert list(r["ids"]) == own.encode_ordinary(text) and bytes(r["data"]) == text.encode()
