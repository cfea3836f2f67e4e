"""Weighted union of row sets."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_union(components: Mapping[str, tuple[DataFrame, int]]) -> DataFrame:
    """Bag union of named frames of equal columns, each row ``weight`` times.

    Adds ``component`` and ``copy`` (from 1).
    """
    parts = [
        df.select(
            F.lit(name).alias("component"), "*",
            F.explode(F.sequence(F.lit(1), F.lit(weight))).alias("copy"),
        )
        for name, (df, weight) in components.items()
        if weight > 0
    ]
    return reduce(DataFrame.unionByName, parts)


def mixture_report(mixture: DataFrame) -> DataFrame:
    """Rows per component."""
    return mixture.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
