"""Token counts by rank-synchronous array merging (operator 10).

Pre-tokens of many texts are held as one ragged array of symbols.  In each
round every sequence applies the pair of lowest rank it contains, everywhere it
occurs, all sequences at once; what no pair can shorten leaves the array with
its number of surviving symbols.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.hashing import HashIndex
from loomtext.llm.words import text_blocks

# How byte-level vocabularies cut text before merging.  Words stand first
# because they are most frequent; they and the contractions never start alike.
PRE_TOKEN = r" ?\p{L}++| ?\p{N}++|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"

NO_RANK = np.int64(1) << 40


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 characters for themselves, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(byte if byte in printable else next(others)) for byte in range(256)]


class ArrayMerger:
    """A byte-level vocabulary file and the merge rounds over ragged arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, model = spec["model"]["vocab"], spec["model"]
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or model["ignore_merges"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take neighbouring text")
        self.base = np.array([vocab[char] for char in byte_alphabet()], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        self.index = HashIndex(keys)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pieces = regex.compile(PRE_TOKEN)

    def survivors(self, sequences: list[bytes]) -> np.ndarray:
        """The number of symbols left of each non-empty byte sequence."""
        result = np.zeros(len(sequences), dtype=np.int64)
        sizes = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
        symbols = self.base[np.frombuffer(b"".join(sequences), dtype=np.uint8)]
        owner = np.arange(len(sequences))
        while symbols.size:
            ends = np.cumsum(sizes)
            starts = ends - sizes
            rank = self._ranks(symbols, ends)
            best = np.minimum.reduceat(rank, starts)
            done = best == NO_RANK
            result[owner[done]] = sizes[done]
            take = np.flatnonzero((rank == np.repeat(best, sizes)) & (rank != NO_RANK))
            take = _leftmost_disjoint(take)
            symbols[take] = self.made[rank[take]]
            keep = np.repeat(~done, sizes)
            keep[take + 1] = False
            merged = np.zeros(symbols.size + 1, dtype=np.int64)
            np.cumsum(~keep, out=merged[1:])
            sizes = (sizes - (merged[ends] - merged[starts]))[~done]
            owner, symbols = owner[~done], symbols[keep]
        return result

    def _ranks(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each symbol; none at sequence ends."""
        key = np.full(symbols.size, -1, dtype=np.int64)
        key[:-1] = symbols[:-1] * self.width + symbols[1:]
        key[ends - 1] = -1
        rank = self.index.lookup(key)
        return np.where(rank < 0, NO_RANK, rank)

    def runs(self, text: str, per_run: int) -> Iterator[tuple[list[str], int]]:
        """The pre-tokens of a text in lists of bounded size, with the number of
        special tokens met before each list."""
        parts = self.special.split(text) if self.special else [text]
        for number, part in enumerate(parts):
            matches = self.pieces.finditer(part)
            met = int(number > 0)
            while True:
                run = [match.group() for match in islice(matches, per_run)] if len(part) > per_run else self.pieces.findall(part)
                yield run, met
                met = 0
                if len(part) <= per_run or len(run) < per_run:
                    break


def _leftmost_disjoint(hits: np.ndarray) -> np.ndarray:
    """Of pair positions that follow one another, every second one: the pairs
    of a run such as a a a overlap, and the left one wins."""
    if hits.size < 2:
        return hits
    opens = np.concatenate(([True], np.diff(hits) > 1))
    first = hits[opens][np.cumsum(opens) - 1]
    return hits[(hits - first) % 2 == 0]


def count_texts(merger: ArrayMerger, texts: list[str | None], known: dict[str, int], block_chars: int, known_max: int) -> list[int]:
    """Token counts; ``known`` remembers pre-tokens and is emptied when it is full."""
    counts: list[int] = []
    for block in text_blocks(texts, block_chars):
        if len(known) > known_max:
            known.clear()
        runs = ((row, run, met) for row, text in enumerate(block) for run, met in merger.runs(text, block_chars))
        totals = [0] * len(block)
        held, size = [], 0
        for row, run, met in runs:
            totals[row] += met
            held.append((row, run))
            size += len(run)
            if size >= block_chars:
                _settle(merger, held, known, totals)
                held, size = [], 0
        _settle(merger, held, known, totals)
        counts += totals
    return counts


def _settle(merger: ArrayMerger, held: list[tuple[int, list[str]]], known: dict[str, int], totals: list[int]) -> None:
    new = list(set().union(*(run for _, run in held)).difference(known)) if held else []
    if new:
        known.update(zip(new, merger.survivors([piece.encode() for piece in new]).tolist(), strict=True))
    for row, run in held:
        totals[row] += sum(map(known.__getitem__, run))


def count_tokens(
    docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024, block_chars: int = 1 << 20, known_max: int = 400_000,
) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit) to each row.

    ``vocabulary`` is the path of a byte-level vocabulary file that every
    worker can read.  Special strings inside a text count as one token each.

    A null text counts as empty: 0 bytes, 0 tokens.  Rows are independent, so
    ties and repeated rows get equal counts and an empty table stays empty.
    Columns of the same name as an added one are replaced, other extra columns
    are kept.  Texts of any length are cut in runs of at most ``block_chars``
    pre-tokens; ``known_max`` bounds the pre-tokens a task remembers, which
    changes time, not counts.
    """

    @F.arrow_udf("bigint")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merger = ArrayMerger(vocabulary)
        known: dict[str, int] = {}
        for batch in batches:
            yield pa.array(count_texts(merger, batch.to_pylist(), known, block_chars, known_max), pa.int64())

    counted = docs.withColumn("n_tokens", tokens(F.col(text)))
    return counted.withColumns({
        "n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint"),
        "over_limit": F.col("n_tokens") > limit,
    })
