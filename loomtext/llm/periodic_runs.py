"""Periodic runs of words by a dictionary of basic factors (operator 13).

Every factor whose length m is a power of two gets a number within its
document, so that equal factors have equal numbers; numbers of length 2m are
made from pairs of numbers of length m.  Where the next occurrence of a factor
is at a distance p of at most m, the two lie within a window of twice the
factor's length; a third occurrence at the same distance makes them an
arithmetic progression, which proposes the period p.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 21  # of whole texts handled together
RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A dense number for every key, and how often it occurs."""
    _, number, count = np.unique(key, return_inverse=True, return_counts=True)
    return number, count[number]


def _progressions(at: np.ndarray, number: np.ndarray, m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places i where the factor of length ``m`` occurs next at i + p and
    then at i + 2p, for a period p above m / 2 and up to m, and those p."""
    order = np.argsort(number, kind="stable")
    same = number[order[1:]] == number[order[:-1]]
    gap = np.zeros(n + 1, dtype=np.int32)
    here = at[order]
    step = np.where(same, here[1:] - here[:-1], 0)
    gap[here[:-1]] = np.where((2 * step > m) & (step <= m), step, 0)
    first = np.flatnonzero(gap)
    first = first[gap[first + gap[first]] == gap[first]]
    return first, gap[first]


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = 6, exponent: int = 4) -> np.ndarray:
    """(start, length, period) rows of all maximal runs, in order of start and
    then period; row r of the texts owns ``words[bounds[r]:bounds[r + 1]]``,
    and equal words have equal numbers.

    A run of length L >= ``exponent`` x p with smallest period p is found at the
    one level m with m / 2 < p <= m: its places s .. s + L - 2p - m, and no
    others beside them, propose p, since a factor no shorter than the smallest
    period recurs within a run at multiples of it alone.  A proposal at i covers
    i .. i + 2p + m; neighbours extend it, so each stretch of proposals is one
    maximal run, and no run comes from two levels.  As exponent >= 4, the first
    place is among them.  Factors that occur less than three times in their
    document start no progression at this or a higher level and are left out
    there, so the work beyond the first levels is that of the repeats.
    """
    if exponent < 4:
        raise ValueError("progressions of three factors need an exponent of 4 or more")
    n = words.size
    row = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))
    number, count = _numbered(row * np.int64(words.max(initial=0) + 1) + words)
    found, m = [], 1
    at = np.flatnonzero(count >= 3)
    number = number[at]
    while at.size:
        first, period = _progressions(at, number, m, n)
        if first.size:
            new = np.flatnonzero((np.diff(first, prepend=-2) != 1) | (np.diff(period, prepend=0) != 0))
            last = np.append(new[1:], first.size) - 1
            p = period[new].astype(np.int64)
            found.append(np.column_stack((first[new], first[last] - first[new] + 2 * p + m, p)))
        # Numbers of factors twice as long: pairs of those that stand m apart.
        place = np.full(n, -1, dtype=np.int64)
        place[at] = np.arange(at.size)
        head = at[at + m < n]
        head = head[(place[head + m] >= 0) & (row[np.minimum(head + 2 * m - 1, n - 1)] == row[head]) & (head + 2 * m <= n)]
        pair = number[place[head]] * np.int64(number.max(initial=0) + 1) + number[place[head + m]]
        number, count = _numbered(pair)
        often = count >= 3
        at, number, m = head[often], number[often], 2 * m
    runs = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    runs = runs[runs[:, 1] >= np.maximum(least, exponent * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _blocks(texts: pa.LargeStringArray) -> Iterator[pa.LargeStringArray]:
    """Whole texts of about ``BLOCK_BYTES`` together; a longer one stands alone."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    row = 0
    while row < len(texts):
        upto = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1
        upto = min(max(upto, row + 1), len(texts))
        yield texts.slice(row, upto - row)
        row = upto


def _words(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All words of the texts, and where each text's words begin and end."""
    # The split knows the same six separators; where two meet, or at an end, it leaves an empty piece.
    split = pc.ascii_split_whitespace(texts)
    pieces, cuts = split.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))))
    some = pc.greater(pc.binary_length(pieces), 0)
    before = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    return pieces.filter(some), before[cuts]


def _judged(texts: pa.LargeStringArray, least: int, exponent: int) -> pa.StructArray:
    words, bounds = _words(texts)
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = find_runs(numbers, bounds, least, exponent)
    # A run's words after its first period go.
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(change)[:-1] == 0
    kept_bounds = np.concatenate(([0], np.cumsum(stays)))[bounds]
    kept = pa.ListArray.from_arrays(pa.array(kept_bounds, pa.int32()), words.filter(pa.array(stays)))
    row = np.searchsorted(bounds, runs[:, 0], side="right") - 1
    cuts = np.searchsorted(row, np.arange(len(texts) + 1))
    parts = pa.StructArray.from_arrays(
        [pa.array(runs[:, 0] - bounds[row]), pa.array(runs[:, 1].copy()), pa.array(runs[:, 2].copy())], names=["start", "length", "period"]
    )
    return pa.StructArray.from_arrays(
        [pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), parts),
         pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())], names=["n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, text: str = "text", out: str = "periodic", least: int = 6, exponent: int = 4) -> DataFrame:
    """Add a struct ``out`` (n_words, runs, collapsed).

    ``runs`` are all stretches (start, length, period) of words whose smallest
    period is ``period``, at least ``least`` words and ``exponent`` periods long
    and not to be extended, by start and then period.  ``collapsed`` are the
    words, joined by one space, without those that some run holds after its
    first period.  Words are compared as they are, by dictionary, not by hash.

    A null, empty or blank text has no words, no runs and an empty ``collapsed``.
    Rows are independent: repeated rows agree, an empty table stays empty, extra
    columns are kept, one named like ``out`` is replaced.  Runs of one start are
    ordered by period.  Nothing is exchanged; a task holds texts of
    ``BLOCK_BYTES`` together and a longer text alone, with a few numbers a word.
    """

    @F.arrow_udf(f"n_words bigint, runs {RUN_TYPE}, collapsed string")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.cast(pa.large_string()).fill_null("")
            parts = [_judged(block, least, exponent) for block in _blocks(texts)] or [_judged(texts, least, exponent)]
            yield pa.concat_arrays(parts)

    return docs.withColumn(out, judged(F.col(text)))
