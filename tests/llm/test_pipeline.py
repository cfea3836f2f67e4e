"""The stages one after the other, against plain Python where it can say the result."""

import corpus_pipeline
from helpers import base_spans, clashing, empty, near_components, odd

from loomtext.llm.language import has_letter

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, small).cache()
        assert docs.columns == COLUMNS
        rows[name] = {r.doc_id: r for r in docs.collect()}
        assert set(rows[name]) <= set(before)
        if name == "language":
            assert len(rows[name]) >= 0.99 * sum(has_letter(r.text) for r in before.values())
        if name == "near_dedup":
            groups = near_components([(i, r.text) for i, r in before.items()])
            assert set(rows[name]) == {i for i, (_, component) in groups.items() if i == component}
        if name == "decontaminate":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            held = {i for i, r in before.items() if any(item in " ".join(r.text.lower().split()) for item in items)}
            assert held and set(rows[name]).isdisjoint(held) and len(rows[name]) >= len(before) - len(held) - 2
        if name == "personal_data":
            assert set(rows[name]) == set(before)
            assert not any(base_spans(r.text) for r in rows[name].values())
            assert all(r.n_chars == len(r.text) for r in rows[name].values())


def test_odd_documents_pass_every_stage(spark, small):
    docs = clashing(odd(spark))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() > 0
        if name != "encode":
            assert out.columns == docs.columns


def test_stages_of_an_empty_table(spark, small):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty(spark), small)
        assert out.count() == 0 and (name == "encode" or out.columns == COLUMNS)


def test_run_returns_the_last_stage(spark, small):
    rows = corpus_pipeline.run(spark, small.replace("sf0.01", "sf0.001")).collect()
    assert rows and all(r.decodes for r in rows)
