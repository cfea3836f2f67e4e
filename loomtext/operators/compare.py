"""Test texts picked by position, and several arms run on the same texts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.defaults import CONTEXT_CHARS
from loomtext.operators.apply import Model, apply_model
from loomtext.operators.corpus import head_corpus


def pick_positions(
    df: DataFrame, order: Sequence[str], positions: Sequence[int] | None, limit: int,
    chars: tuple[int, int] = CONTEXT_CHARS, text: str = "text", bucket: Column | None = None,
) -> DataFrame:
    """Rows at 0-based ``positions`` of the filtered corpus cut to ``limit`` rows.

    Adds ``pos``; None takes all positions.  Only the rows up to the last
    position are numbered.
    """
    needed = limit if positions is None else min(limit, max(positions, default=-1) + 1)
    if needed < 1:
        return df.limit(0).withColumn("pos", F.lit(None).cast("int"))
    numbered = head_corpus(df, order, needed, chars, text, bucket, pos="pos")
    return numbered if positions is None else numbered.where(F.col("pos").isin(list(positions)))


def run_arms(
    contexts: DataFrame, arms: Mapping[str, tuple[Column, Callable[[], Model]]], prompts: bool = False
) -> DataFrame:
    """Each context through every arm (prompt expression, model), side by side.

    The answers become columns ``out_<arm>`` of the context's own row, so the
    arms need no join.  ``prompts`` keeps the prompts as ``prompt_<arm>``.
    """
    result = contexts
    for name, (prompt, make_model) in arms.items():
        result = apply_model(result.withColumn(f"prompt_{name}", prompt), f"prompt_{name}", make_model, f"out_{name}")
    return result if prompts else result.drop(*[f"prompt_{name}" for name in arms])


def side_by_side(outputs: DataFrame, context: str, arms: Sequence[str]) -> DataFrame:
    """Stored outputs (context, arm, output) as one row per context that has all
    arms, columns ``out_<arm>``.  A second output of one arm for one context
    fails the job; number the runs and pass them as contexts of their own."""
    repeated = F.raise_error(F.lit("an arm has several outputs for one context")).cast("string")
    only = F.when(F.count("output") > 1, repeated).otherwise(F.max("output"))
    wide = outputs.groupBy(context).pivot("arm", list(arms)).agg(only)
    complete = wide.dropna(subset=list(arms))
    return complete.withColumnsRenamed({arm: f"out_{arm}" for arm in arms})
