"""The corpus pipeline against brute force, stage by stage."""

from collections import Counter

import pytest

import corpus_pipeline
from quillon.llm import mixing, quality
from tests.llm.test_table_ops import plain_components, plain_fingerprint, plain_rake
from tests.llm.test_text_ops import plain_scan


def test_pipeline(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    rows = [r for r in docs.collect() if r.doc_id in good]
    comp = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in rows])
    first = {d for d, _, c in comp if d == c}
    rows = [r for r in rows if r.doc_id in first]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [r for r in rows if not plain_scan(r.text, bench)[-1]]
    left = spark.createDataFrame(rows, docs.schema)
    keyed = mixing.mix(left).collect()
    cells = Counter()
    for r in keyed:
        cells[(r.source, r.lang, r.topic)] += r.n_tokens
    p = plain_rake(dict(cells), mixing.MixRules())
    assert all(r.p == pytest.approx(p[(r.source, r.lang, r.topic)], abs=1e-5) for r in keyed)
    chosen = {r.doc_id for r in keyed if r.selected}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(chosen)
    assert sorted(r.slot for r in out if r.shard == 0) == list(range(sum(r.shard == 0 for r in out)))
    assert 4 <= len(stages) <= 5


def test_stages_keep_the_columns_and_take_empty_tables(spark, sf_dir, edge, none):
    for df in (edge, none):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == df.columns
                docs = out
        assert out.count() == docs.count()
