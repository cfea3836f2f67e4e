"""Writers.  Each writes a folder of part files and replaces what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8, letters unescaped, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_split_jsonl(df: DataFrame, path: str, split: str = "split") -> None:
    """The same with one subfolder for each value of ``split``."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy(split).json(path)


def write_training_text(df: DataFrame, path: str, text: str = "text") -> None:
    """The one column a trainer reads, as Parquet."""
    df.select(df[text].alias("text")).write.mode("overwrite").parquet(path)
