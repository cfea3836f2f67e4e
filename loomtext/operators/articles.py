"""Articles put together from chunks, without ever holding one article in a row.

A chunk is a row (lang, law, article, text, blk, ord).  (blk, ord) gives the
reading order: blk is any coarse key such as the file split, ord orders the
chunks of a blk.  An article may span any number of chunks and hold a large
share of all rows, so paragraphs stay one per row.  Their position is found in
two levels: totals per block, summed up before the shuffle, are added over the
blocks of an article (few, narrow rows), and the chunks of one block are
numbered from there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import has_text, present, required

ARTICLE = ["law", "article"]
BLOCK = ["law", "article", "lang", "blk"]


def split_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with a key, their text cut into paragraphs; blank ones are dropped.

    Paragraphs keep their outer spaces.  A chunk may end up with none.
    """
    lines = F.split(required("text", "text"), "\n")
    keyed = chunks.where(F.col("article").isNotNull()).withColumns({
        "law": required("law", "law"), "lang": required("lang", "lang"), "blk": present("blk", "blk"),
    })
    return keyed.select(*BLOCK, "ord", F.filter(lines, has_text).alias("paragraphs"))


def block_totals(split: DataFrame) -> DataFrame:
    """Paragraphs and their characters per block of an article."""
    chars = F.aggregate("paragraphs", F.lit(0).cast("bigint"), lambda total, p: total + F.length(p))
    return split.groupBy(*BLOCK).agg(F.sum(F.size("paragraphs")).alias("n"), F.sum(chars).alias("chars"))


def with_start(blocks: DataFrame) -> DataFrame:
    """Add ``start``, the number of paragraphs in earlier blocks of the article."""
    earlier = Window.partitionBy(*ARTICLE, "lang").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def place_paragraphs(split: DataFrame, blocks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per paragraph with its position in the article, counted from 0.

    ``blocks`` has the block key and ``start``, and any columns to ``keep``.  It
    may hold fewer articles than ``split``; only those come out.
    """
    earlier = Window.partitionBy(*BLOCK).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.size("paragraphs")).over(earlier), F.lit(0))
    joined = split.where(F.size("paragraphs") > 0).join(blocks.select(*BLOCK, "start", *keep), BLOCK)
    started = joined.withColumn("start", F.col("start") + before)
    return started.select(*ARTICLE, "lang", *keep, "start", F.posexplode("paragraphs").alias("i", "paragraph")).select(
        *ARTICLE, "lang", *keep, (F.col("start") + F.col("i")).alias("pos"), "paragraph"
    )


def article_paragraphs(chunks: DataFrame) -> DataFrame:
    """All paragraphs of all articles in reading order, one per row.

    An article without any paragraph keeps one row, with pos -1 and the empty
    string, so that articles can be counted.
    """
    split = split_chunks(chunks)
    blocks = block_totals(split)
    empty = blocks.groupBy(*ARTICLE, "lang").agg(F.sum("n").alias("n")).where(F.col("n") == 0)
    nothing = empty.select(*ARTICLE, "lang", F.lit(-1).cast("bigint").alias("pos"), F.lit("").alias("paragraph"))
    return place_paragraphs(split, with_start(blocks)).unionByName(nothing)
