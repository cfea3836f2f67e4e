"""The library's inputs, derived from the test tables.

Turn pairs are turns with the answer after them, and summaries come from
documents of several lines; all other inputs use every row of their table, and
no text is cut or replaced.

The twins of these frames in SQL are the named subqueries of ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The test texts hold neither Russian nor Kyrgyz, so common words stand in.
LEXICON = [
    ("the", "and"), ("and", "and"), ("le ", "la "), ("la ", "la "),
    ("und", "die"), ("die", "die"), ("of", "of"),
]
# One worked example for few-shot prompts.
SHOTS = [("The bridge was closed in May for repairs and opened again in June.", "The bridge reopened in June.")]

# Declared, so that planning a query opens no file.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


def _law() -> list:
    return [
        F.concat(F.lit("c"), F.expr("conv_id div 100").cast("string")).alias("law"),
        F.col("conv_id").cast("string").alias("article"),
    ]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the chunks of articles in two languages, system turns as a third;
    one conversation is one article."""
    lang = F.when(F.col("role") == "user", "ru").when(F.col("role") == "assistant", "ky").otherwise("en")
    return table(spark, sf_dir, "conversations").select(
        lang.alias("lang"), *_law(), "text", F.expr("turn div 65536").alias("blk"), F.col("turn").alias("ord")
    )


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn after it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("ru"))
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ky")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(*_law(), "conv_id", "turn", "ru", "ky")


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence pair with two numbers for every part."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"),
        F.concat(F.lit("Пункт "), key, F.lit(": срок "), size, F.lit(" дней.")).alias("ru"),
        F.concat(key, F.lit("-пункт: мөөнөтү "), size, F.lit(" күн.")).alias("ky"),
    )


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn pairs and part pairs together, keyed by (kind, k, turn)."""
    turns = turn_pairs(spark, sf_dir).select(F.lit("turn").alias("kind"), F.col("conv_id").alias("k"), "turn", "ru", "ky")
    parts = part_pairs(spark, sf_dir).select(
        F.lit("part").alias("kind"), "k", F.lit(0).cast("bigint").alias("turn"), "ru", "ky"
    )
    return turns.unionByName(parts)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of several lines: the first line is the summary of the rest."""
    at = F.locate("\n", F.col("text"))
    return corpus(spark, sf_dir).where(at > 0).select(
        "doc_id",
        F.expr("substring(text, locate('\n', text) + 1)").alias("text"),
        F.expr("substring(text, 1, locate('\n', text) - 1)").alias("summary"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a request, whole and padded with spaces; beside each system
    turn stands a blank one, with a negative turn number."""
    pad = F.lit(" \n ")
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.length("text") < 150, "ky2ru").otherwise("ru2ky").alias("direction"), "role", F.concat(pad, "text", pad).alias("text"),
    )
    asked = F.struct("turn", "text")
    blank = F.struct((-1 - F.col("turn")).alias("turn"), pad.alias("text"))
    both = F.when(F.col("role") == "system", F.array(asked, blank)).otherwise(F.array(asked))
    return turns.select("conv_id", "direction", F.inline(both)).select("conv_id", "turn", "direction", "text")


def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions: every whole turn is a line, and before some of
    them stands a command that their numbers decide."""
    fifth, rare = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)), F.pmod(F.col("conv_id") + 3 * F.col("turn"), F.lit(23))
    command = F.when(fifth == 0, ":ky").when(fifth == 1, ":ru").when(rare == 0, ":q").when(rare == 1, "Exit")
    line = F.struct((2 * F.col("turn") + 1).alias("seq"), F.concat("text", F.lit("  ")).alias("line"))
    before = F.struct((2 * F.col("turn")).alias("seq"), command.alias("line"))
    both = F.when(command.isNotNull(), F.array(before, line)).otherwise(F.array(line))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.inline(both))
