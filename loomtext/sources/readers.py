"""Readers.  JSON lines are parsed strictly and absent required fields fail the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtext.functions import has_text, required
from loomtext.sources.lines import read_lines
from loomtext.sources.schemas import LAW_CHUNK, PAIR, PROMPT_ANSWER


def _json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _placed_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The fields of JSON lines with ``file`` and ``place``; blank lines are no records."""
    lines = read_lines(spark, path).where(has_text("line"))
    return lines.select("file", "place", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("_record")).select("file", "place", "_record.*")


def _required(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: required(name, name) for name in names})


def _file_name() -> Column:
    """The path of a row's file.  Spark gives it with spaces and the like
    escaped; names sort as they are."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_corpus(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """One text column of a Parquet corpus, with its place (``CORPUS_ORDER``)."""
    return spark.read.schema(f"`{text}` string").parquet(path).select(
        F.col(text).alias("text"),
        _file_name().alias("src_file"),
        F.col("_metadata.row_index").alias("src_row"),
    )


# Files by name, rows as they stand in their file.
CORPUS_ORDER = ["src_file", "src_row"]


def corpus_bucket() -> Column:
    """Buckets for ``first_n`` along ``CORPUS_ORDER``: about a million rows of one file."""
    return F.struct("src_file", F.shiftright("src_row", 20).alias("part"))


def read_law_chunks(spark: SparkSession, root: str, suffix: str, lang: str | None = None) -> DataFrame:
    """All ``*_{suffix}.jsonl`` under ``root`` as chunks (lang, law, article, text, blk, ord).

    Files are ordered by name and lines by their place: ord is the offset of the
    line in its file, blk the file and a stretch of 64 MB of it.  Neither
    depends on how the files are cut into tasks.
    """
    lines = _placed_json_lines(spark, f"{root.rstrip('/')}/*_{suffix}.jsonl", LAW_CHUNK)
    return lines.select(
        F.lit(lang or suffix).alias("lang"),
        F.col("LawCode").alias("law"),
        F.col("ArticleNumber").alias("article"),
        F.col("Text").alias("text"),
        F.struct("file", F.shiftright("place", 26).alias("start")).alias("blk"),
        F.col("place").alias("ord"),
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs (law, article, ru, ky) with ``row``, the file and offset of each: a
    key that tells rows apart and stays the same however the files are read."""
    pairs = _required(_placed_json_lines(spark, path, PAIR), "ru", "ky")
    return pairs.select("law", "article", "ru", "ky", F.concat_ws(":", "file", F.col("place").cast("string")).alias("row"))


def read_prompt_answers(spark: SparkSession, path: str) -> DataFrame:
    """Hand-written (context, answer) rows."""
    return _required(_json_lines(spark, path, PROMPT_ANSWER), "context", "answer")


def read_summary_split(spark: SparkSession, root: str, lang: str, split: str) -> DataFrame:
    """(text, summary) of one language and split of a Parquet collection."""
    return spark.read.schema("text string, summary string").parquet(f"{root.rstrip('/')}/{lang}/{split}")
