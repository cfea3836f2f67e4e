"""Plain-text corpus: length filter, head limit, end marker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.defaults import CORPUS_CHARS, EOS
from loomtext.functions import within
from loomtext.operators.ordering import first_n


def keep_lengths(df: DataFrame, chars: tuple[int, int] = CORPUS_CHARS, text: str = "text") -> DataFrame:
    """Drop null and empty texts and those outside the length range."""
    return df.where(F.col(text).isNotNull() & (F.col(text) != "") & within(text, chars))


def keep_summary_lengths(
    df: DataFrame, article_chars: tuple[int, int], summary_chars: tuple[int, int],
    text: str = "text", summary: str = "summary",
) -> DataFrame:
    """Keep rows whose article and summary are both within their length ranges."""
    return df.where(within(text, article_chars) & within(summary, summary_chars))


def head_corpus(
    df: DataFrame, order: Sequence[str], limit: int | None,
    chars: tuple[int, int] = CORPUS_CHARS, text: str = "text", bucket: Column | None = None, pos: str | None = None,
) -> DataFrame:
    """The first ``limit`` texts of fitting length; no limit (or 0) keeps them all.

    ``order``, ``bucket`` and ``pos`` as in ``first_n``; ``pos`` needs a limit.
    """
    kept = keep_lengths(df, chars, text)
    if not limit:
        return kept
    # The smallest order value comes from the unfiltered table: it reads one column only.
    start = df.agg(F.min(order[0])).scalar() if bucket is None else None
    return first_n(kept, order, limit, bucket, start, pos)


def append_eos(df: DataFrame, eos: str = EOS, text: str = "text") -> DataFrame:
    """End every text with the marker."""
    return df.withColumn(text, F.concat(F.col(text), F.lit(eos)))
