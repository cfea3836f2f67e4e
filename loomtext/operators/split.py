"""Train and validation rows, decided by article so that none is in both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.defaults import VAL_MODULUS
from loomtext.functions import digest_modulo


def hash_split(df: DataFrame, modulus: int = VAL_MODULUS) -> DataFrame:
    """Add ``split``: one article in ``modulus`` is 'val', the others 'train'."""
    key = F.concat(F.col("law"), F.lit(":"), F.col("article"))
    return df.withColumn("split", F.when(digest_modulo(key, modulus) == 0, "val").otherwise("train"))


def split_report(df: DataFrame) -> DataFrame:
    """Pairs per split, and the examples they give: two each."""
    pairs = df.groupBy("split").agg(F.count(F.lit(1)).alias("pairs"))
    return pairs.withColumn("examples", F.col("pairs") * 2)
