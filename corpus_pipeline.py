"""The corpus pipeline: five stages over the documents, each written as Parquet and read again.

Language ID (texts without a prevailing language go), n-gram Jaccard join (one
document of each group stays), PII (masked), mixing sources to target weights
(documents are dropped or repeated), byte-level BPE encoding and decoding.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rubicost.llm import bpe_chunks, cube_mix, jaccard_metric, language_mixture, pii_boost
from rubicost.llm.common import checkpoint_root
from rubicost.llm.queries import tokenizer


#: rows of an Arrow batch: what a task holds of whole texts, in the JVM and in Python, grows with it
BATCH = 1000


def bounded(spark: SparkSession) -> None:
    """Lets the session's tasks exchange small batches; the default of 10,000 rows is some 30 MB of texts, several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return language_mixture.keep_identified(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return jaccard_metric.one_of_each(docs, size=5, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return pii_boost.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return cube_mix.mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    ranks, pattern = tokenizer()
    return bpe_chunks.digests(bpe_chunks.encode_documents(docs, ranks, pattern, decode=True))


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("pii", pii), ("mixing", mixing), ("bpe", bpe)]

#: Language models, boosted trees and sampling are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{checkpoint_root(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
