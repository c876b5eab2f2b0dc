import corpus_pipeline
from rubicost.llm import jaccard_metric, pii_boost
from tests.llm.data import odd_documents, untouched


def test_stages_work_on_what_was_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "jaccard_join", "pii", "mixing", "bpe"]
    kept = corpus_pipeline.language_id(spark, docs, sf_dir)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()
    unique = corpus_pipeline.jaccard_join(spark, kept, sf_dir)
    sets = {r["doc_id"]: jaccard_metric.shingles(r["text"], 5) for r in unique.collect()}
    ids = sorted(sets)
    assert not any(jaccard_metric.linked(sets[a], sets[b], 80) for i, a in enumerate(ids) for b in ids[i + 1 :])
    clean = corpus_pipeline.pii(spark, unique, sf_dir)
    assert all(not any(pii_boost.base_spans(r["text"]).values()) for r in clean.collect())
    mixed = corpus_pipeline.mixing(spark, clean, sf_dir)
    assert mixed.columns == docs.columns and mixed.count() > 0
    out = corpus_pipeline.bpe(spark, mixed, sf_dir)
    assert out.count() == mixed.count() and set(ids) >= {r["doc_id"] for r in out.collect()}


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_odd_documents(spark, sf_dir):
    for extra in (False, True):
        docs = before = odd_documents(spark, extra)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != "bpe":
                assert untouched(before, docs), name
        assert docs.count() > 0


def test_tables_without_rows_or_values(spark, sf_dir):
    docs = odd_documents(spark)
    nothing = docs.limit(0)
    nulls = docs.selectExpr(*(f"CAST(NULL AS {t}) AS `{c}`" for c, t in docs.dtypes)).limit(4)
    for table in (nothing, nulls):
        left = table
        for _, stage in corpus_pipeline.STAGES:
            left = stage(spark, left, sf_dir)
        assert left.count() == 0


def test_the_pii_stage_is_fitted_in_as_few_blocks_as_its_rows_need(spark, monkeypatch):
    """However many tasks a session deals rows by key to."""
    kind, seen = type(spark.range(0)), []
    repartition = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *cols: repartition(self, max(n, 60) if cols else n, *cols))
    monkeypatch.setattr(pii_boost.Boosted, "fit_blocks", lambda self, blocks, precision: seen.append(blocks.getNumPartitions()) or self)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["pii"]
    assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns and seen == [1]
