"""Two-language chunks to split translation pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomtext.defaults import PAIR_CHARS, PAIR_RATIO, VAL_MODULUS
from loomtext.operators.align import align_pairs
from loomtext.operators.split import hash_split


def aligned_pairs(
    chunks: DataFrame, chars: tuple[int, int] = PAIR_CHARS,
    ratio: tuple[float, float] = PAIR_RATIO, modulus: int = VAL_MODULUS,
) -> DataFrame:
    """Pairs (law, article, unit, pos, ru, ky, split) ready for ``write_split_jsonl``."""
    return hash_split(align_pairs(chunks, chars, ratio), modulus)
