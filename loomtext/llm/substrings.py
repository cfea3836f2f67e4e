"""Removal of repeated passages by difference-cover anchors (operator 7).

Of every document, short windows are hashed only at the positions of a
difference cover modulo a period.  Two equal passages, wherever they start,
have a cover position in common, so every repeat leaves a shared anchor.  Only
around shared anchors are whole windows hashed, and only those are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.hashing import WordHasher
from loomtext.llm.spark_tools import checkpointed, skew_join
from loomtext.llm.words import WORD, free_names

# A perfect difference set; each number below the period is the
# difference of two of its members, modulo the period.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)


def _cover_words(block, length: int) -> np.ndarray:
    """The words at which an anchor starts."""
    starts = block.windows(length)
    return starts[np.isin(block.local()[starts] % PERIOD, COVER)]


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, doc) for the distinct anchors of each row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in hasher.blocks(batch.column(1)):
                at = _cover_words(block, length)
                rows = np.column_stack((block.row_of(at), hasher.window_hashes(block, at, length).view(np.int64)))
                order = np.lexsort((rows[:, 1], rows[:, 0]))
                rows = rows[order]
                fresh = np.ones(len(rows), dtype=bool)
                fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
                rows = rows[fresh]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(rows[:, 1])), pa.array(ids[block.first_row + rows[:, 0]])], names=["anchor", "doc"]
                )

    return docs.mapInArrow(hashed, "anchor bigint, doc bigint")


def _windows(around: DataFrame, length: int, window: int) -> DataFrame:
    """(hash, place, doc) of the windows that hold a shared anchor of their row.

    The place is the number of the first word, with a tag of the text in the
    upper half, so that rows of one id and different texts stay apart.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids, shared, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2), batch.column(3).to_numpy()
            for block in hasher.blocks(batch.column(1)):
                at = _cover_words(block, length)
                row = block.row_of(at)
                anchors = hasher.window_hashes(block, at, length).view(np.int64)
                hit = np.zeros(at.size, dtype=bool)
                cuts = np.searchsorted(row, np.arange(len(block.bounds)))
                for r in range(len(block.bounds) - 1):
                    part = slice(cuts[r], cuts[r + 1])
                    hit[part] = np.isin(anchors[part], shared[block.first_row + r].values.to_numpy(zero_copy_only=False))
                # Windows that start up to (window - length) words before a hit.
                change = np.zeros(block.hashes.size + 1, dtype=np.int64)
                np.add.at(change, np.maximum(at[hit] - (window - length), block.bounds[row[hit]]), 1)
                np.add.at(change, at[hit] + 1, -1)
                starts = block.windows(window)
                starts = starts[np.cumsum(change)[starts] > 0]
                row = block.row_of(starts)
                place = (tags[block.first_row + row].astype(np.int64) << 32) + (starts - block.bounds[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hasher.window_hashes(block, starts, window).view(np.int64)), pa.array(place),
                     pa.array(ids[block.first_row + row])], names=["hash", "place", "doc"],
                )

    return around.mapInArrow(hashed, "hash bigint, place bigint, doc bigint")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, out: str = "unique") -> DataFrame:
    """Add a struct ``out`` (n_words, n_removed, kept): the text without the words
    covered by a window of ``window`` words that also starts in a document of a
    smaller id.

    ``kept`` has the remaining words, joined by one space.  Windows are judged
    on the input.  A null text counts as empty; a row with a null id is neither
    judged nor compared with.  Rows of one id never remove each other's words,
    whether their texts are equal or not.  An empty table stays empty, extra
    columns are kept, one named like ``out`` is replaced.

    Whole copies are settled first: of equal texts all but the smallest id lose
    every word, if they have a window at all.  Shared anchors are counted with partial sums before the exchange, so a
    passage that a third of all documents hold costs one row a task there; the
    joins on anchors and windows are plain shuffle joins whose hot keys
    adaptive execution splits.  What is gathered per document is never more
    than a number for each of its words.  Anchors only nominate; windows are
    compared by a 64-bit hash of their 64-bit word hashes.
    """
    length = window - PERIOD + 1
    if length < 1:
        raise ValueError(f"window must have at least {PERIOD} words")
    copy, places = free_names(docs, "copy", "places", beside=out)
    # No column is renamed before an exchange: then all joins of texts share one.
    kinds = dict(docs.dtypes)
    source = docs if kinds[doc_id] == "bigint" else docs.withColumn(doc_id, F.col(doc_id).cast("bigint"))
    named = source.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    texts = named.select(doc_id, text)

    # Whole copies: the smallest id stands for all, so its windows need no second look.
    digests = texts.select(F.col(doc_id).alias("doc"), F.unhex(F.md5(F.col(text))).alias("digest")).distinct()
    copies = digests.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    several = digests.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")
    # A key of another name: both sides get exchanges of their own, so that a text of very many copies can be split.
    same = F.concat(F.lit(b"n"), F.col("digest")).alias("same")
    copied = digests.select("doc", same).join(copies.select(same, "first"), "same").where("doc > first")
    later = copied.select("doc").join(several, "doc", "left_anti")
    later = checkpointed(later.select(F.col("doc").alias(doc_id), F.lit(True).alias(copy)))

    originals = texts.join(later, doc_id, "left_anti").select(doc_id, text)
    anchors = _anchors(originals, length)
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    of_doc = skew_join(anchors, shared, "anchor").groupBy("doc").agg(F.collect_set("anchor").alias("shared"))
    tag = (F.crc32(F.col(text)) % (1 << 31)).cast("int")
    around = originals.join(of_doc.withColumnRenamed("doc", doc_id), doc_id).select(doc_id, text, "shared", tag.alias("tag"))

    windows = _windows(around, length, window)
    first = windows.groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    covered = (
        skew_join(windows, first, "hash").where("doc > first")
        .groupBy("doc").agg(F.array_distinct(F.collect_list("place")).alias("places"))
    )

    @F.arrow_udf("n_words bigint, n_removed bigint, kept string")
    def cut(texts: pa.Array, tags: pa.Array, places: pa.Array, copies: pa.Array) -> pa.Array:
        rows = [
            _cut(t.as_py() or "", own.as_py(), p, whole.is_valid, window)
            for t, own, p, whole in zip(texts, tags, places, copies, strict=True)
        ]
        n_words, n_removed, kept = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            names=["n_words", "n_removed", "kept"],
        )

    found = later.join(covered.select(F.col("doc").alias(doc_id), F.col("places").alias(places)), doc_id, "full")
    judged = named.join(found, doc_id, "left")
    unnamed = source.where(F.col(doc_id).isNull() | F.col(text).isNull()).select(
        "*", F.lit(None).cast("boolean").alias(copy), F.lit(None).cast("array<bigint>").alias(places)
    )
    own = cut(F.col(text), tag, F.col(places), F.col(copy)).alias(out)
    kept_columns = [F.col(f"`{name}`").cast(kind).alias(name) for name, kind in docs.dtypes if name.lower() != out.lower()]
    return judged.unionByName(unnamed).select(*kept_columns, own)


def _cut(text: str, tag: int | None, places: pa.ListScalar, copy: bool, window: int) -> tuple[int, int, str]:
    words = WORD.findall(text)
    if copy and len(words) >= window:
        return len(words), len(words), ""
    if not places.is_valid:
        return len(words), 0, " ".join(words)
    starts = places.values.to_numpy(zero_copy_only=False)
    starts = starts[(starts >> 32) == tag] & 0xFFFFFFFF
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    gone = np.cumsum(change)[:-1] > 0
    return len(words), int(gone.sum()), " ".join([word for word, out in zip(words, gone.tolist(), strict=True) if not out])
