"""Pairs and summaries to one-column training texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomtext.defaults import ARTICLE_CHARS, EOS, SUMMARY_CHARS, SYSTEM, TASK_SUMMARY
from loomtext.operators.corpus import keep_summary_lengths
from loomtext.operators.prompts import summary_example, translation_examples


def translation_texts(pairs: DataFrame, eos: str = EOS) -> DataFrame:
    """Both directions of each pair as texts."""
    return translation_examples(pairs, eos).select("text")


def summary_examples(
    df: DataFrame, text: str = "text", summary: str = "summary",
    bounds: tuple[tuple[int, int], tuple[int, int]] | None = (ARTICLE_CHARS, SUMMARY_CHARS),
    eos: str = EOS, task: str = TASK_SUMMARY, system: str = SYSTEM, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Summarising examples; ``bounds`` None keeps every row (hand-written sets)."""
    kept = df if bounds is None else keep_summary_lengths(df, *bounds, text, summary)
    return kept.select(*keep, summary_example(text, summary, eos, task, system).alias("text"))
