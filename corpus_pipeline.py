"""Language ID, near-dedup, decontamination, PII and encoding over the documents.

Every stage takes what the stage before kept and returns documents with the
same columns; the last returns their sampled segmentations.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.decontaminate import contaminated
from loomtext.llm.language import UNDETERMINED, identify, train
from loomtext.llm.near_dedup import near_duplicates
from loomtext.llm.pii import find_personal_data, masked
from loomtext.llm.sampled_pieces import sample_segmentations
from loomtext.llm.spark_tools import stored
from loomtext.llm.words import free_names, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; null and letterless texts and
    those between two languages go.  ``lang`` stays what the source says."""
    (found,) = free_names(docs, "language")
    judged = identify(docs, train(docs), out=found)
    return judged.where((F.col(f"{found}.lang_pred") != UNDETERMINED) & ~F.col(f"{found}.ambiguous")).select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every near-duplicate group.

    Rows of one id are one document and stay or go together.  Documents without
    a word (a null or empty text) and rows with a null id are in no group and
    stay.  An empty table stays empty."""
    dropped = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Rows are judged by id and text, so repeated rows stay or go together, and
    those with a null id or text are told apart; a null or empty text has no
    passage and stays.  An empty table, or benchmark, changes nothing."""
    # Id and text together name a row, so that rows with a null id are told apart.
    (mark,) = free_names(docs, "mark")
    marked = docs.withColumn(mark, F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text"))))
    leaks = contaminated(marked, read_table(spark, sf_dir, "benchmark"), doc_id=mark)
    return marked.join(leaks.select(F.col("doc_id").alias(mark)).distinct(), mark, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind; ``n_chars``
    is the length of the new text.

    Every row stays, repeated ones alike; a null text stays null, and so does
    its ``n_chars``.  An empty table stays empty."""
    (spans,) = free_names(docs, "spans")
    text = masked(F.col("text"), F.col(spans))
    found = find_personal_data(docs, out=spans).withColumn("text", text)
    return found.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, as piece ids.

    A text that has only one has one row; a null or empty text has an empty one.
    Draws depend on the row's id, so repeated rows agree; an empty table gives
    no rows."""
    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", language), ("near_dedup", dedup), ("decontaminate", decontaminate), ("personal_data", personal_data), ("encode", encode),
]

# Trained models and sampled segmentations have no SQL form; the tests compare
# the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other on the documents table.  What a stage
    returns is written to the shared folder and read again by the next, so a
    stage that loses an executor repeats its own work only.  Nulls in any column
    and repeated rows are as the stages say; an empty table gives no rows."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
