"""What the plans of all registered queries must not contain."""

import pytest

from catalog.queries import registry

QUERIES = registry()
WITH_MODEL = {"ab_outputs", "ab_picked", "apply_model_all", "apply_model_errors", "serve_requests", "serve_sessions",
              "serve_chat", "apply_model_dedup", "capped_answers"}
# One task sees the histogram, the counters of a report, the words of a filter, or the rows of a small head only.
ONE_TASK = {"cpt_corpus_head", "sample_n", "numeral_augment", "augment_mixture", "mixture_report", "heldout_pick",
            "heldout_all", "ab_picked", "align_report", "ab_identical", "seq_overflow", "step_budget", "lexicon_coverage",
            "contamination", "containment", "augmentation_report"}


@pytest.mark.parametrize("name", QUERIES)
def test_plan(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("ArrowEvalPython" in plan) == (name in WITH_MODEL)
    assert "BatchEvalPython" not in plan and "MapInPandas" not in plan
    assert ("SinglePartition" in plan) <= (name in ONE_TASK)


def test_id_cutoff_reaches_the_scan(spark, small):
    frame = QUERIES["cpt_corpus_head"](spark, small)
    assert "LessThanOrEqual(doc_id,ScalarSubquery" in frame._jdf.queryExecution().executedPlan().toString()


def test_scans_of_the_mixture(spark, small):
    """The pairs join two scans of conversations and one of part: once for the
    cut-offs and once for the rows, or once if there is no limit."""
    def scans(name):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("parquet")

    assert scans("augment_mixture") <= 2 * scans("augment_mixture_all") and scans("augmentation_report") == scans("augment_mixture_all") == 3


def test_align_report_reads_chunks_once(spark, small, monkeypatch):
    from loomtext.operators import align

    read = []
    aside = align.stored_aside

    def counted(df):
        read.append(df._jdf.queryExecution().optimizedPlan().toString().count("parquet"))
        return aside(df)

    monkeypatch.setattr(align, "stored_aside", counted)
    report = QUERIES["align_report"](spark, small)
    left = report._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    assert sum(read) + left == 1
