"""Words, documents and text blocks shared by the operators."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Only these six characters part words; other Unicode spaces belong to them.
SEPARATOR = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0d]+")

TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR), lambda word: word != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_blocks(texts: Iterable[str | None], chars: int) -> Iterator[list[str]]:
    """Consecutive texts, whole, in lists of at most about ``chars`` characters
    (a longer text stands alone).  A null counts as empty."""
    block, size = [], 0
    for text in texts:
        text = text or ""
        if block and size + len(text) > chars:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def releasing(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on the batches of a task, after which its process gives back the
    memory that Arrow and the C library would keep.  Spark's Python workers
    outlive their tasks, and what one task needed for a while would otherwise
    count against the executor in all later ones."""

    @functools.wraps(work)
    def tidy(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return tidy


def free_names(df: DataFrame, *names: str, beside: str = "") -> list[str]:
    """The names, with underscores in front until no column of ``df`` has them,
    nor the column ``beside``."""
    taken = {column.lower() for column in [*df.columns, beside]}
    result = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        result.append(name)
    return result
