"""Contexts through several prompt and model arms."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame

from loomtext.defaults import CONTEXT_CHARS
from loomtext.operators.apply import Model
from loomtext.operators.compare import pick_positions, run_arms


def compare_arms(
    corpus: DataFrame, order: Sequence[str], limit: int, positions: Sequence[int] | None,
    arms: Mapping[str, tuple[Column, Callable[[], Model]]],
    chars: tuple[int, int] = CONTEXT_CHARS, text: str = "text", prompts: bool = False,
    bucket: Column | None = None,
) -> DataFrame:
    """Texts picked by position, with one answer column for each arm."""
    return run_arms(pick_positions(corpus, order, positions, limit, chars, text, bucket), arms, prompts)
