"""Raw corpus to pretraining texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from loomtext.defaults import CORPUS_CHARS, EOS
from loomtext.operators.corpus import append_eos, head_corpus


def pretraining_corpus(
    df: DataFrame, order: Sequence[str], chars: tuple[int, int] = CORPUS_CHARS, limit: int | None = None,
    eos: str = EOS, text: str = "text", bucket: Column | None = None,
) -> DataFrame:
    """Length filter, the first ``limit`` rows by ``order`` if given, end marker."""
    return append_eos(head_corpus(df, order, limit, chars, text, bucket), eos, text)
