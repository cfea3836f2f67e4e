"""Hashes of the words of many texts at once, on their UTF-8 bytes, and rolling
hashes over these."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Words up to so many bytes are hashed eight bytes at a time, longer ones by a cryptographic hash.
SHORT_BYTES = 64
# Odd multiplier of the rolling hash over the words of a window.
WORD_BASE = 0xA3B195354A39B70D
_MASK = (1 << 64) - 1
_BLANKS = np.zeros(256, dtype=bool)
_BLANKS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if self.up.size < n:
            n = max(n, 2 * self.up.size)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, base & _MASK, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """The hash of ``values[start:end]`` for every span, wherever it stands."""
    powers.reach(values.size + 1)
    prefix = np.zeros(values.size + 1, dtype=np.uint64)
    np.cumsum(values * powers.up[:values.size], out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * powers.down[starts])


def byte_groups(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: int, window: np.ndarray | None = None) -> np.ndarray:
    """Bytes 8 x ``group`` and on of words that have them, as one number each;
    bytes beyond a word's end are zero."""
    window = padded_window(data) if window is None else window
    unused = 8 * np.maximum(8 * (group + 1) - lengths, 0).astype(np.uint64)
    return window[starts + 8 * group] << unused >> unused


def padded_window(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte on, as one number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    return np.ndarray((data.size + 1,), dtype="<u8", buffer=padded.data, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word.  Each group of bytes is mixed before the next
    is added, so no pattern of bytes cancels out."""
    lengths = ends - starts
    hashes = mixed(lengths.astype(np.uint64))
    window = padded_window(data)
    upto = int(min(lengths.max(initial=0), SHORT_BYTES))
    for group in range(-(-upto // 8)):
        own = np.flatnonzero((lengths > 8 * group) & (lengths <= SHORT_BYTES)) if group else np.flatnonzero(lengths <= SHORT_BYTES)
        hashes[own] = mixed(hashes[own] ^ byte_groups(data, starts[own], lengths[own], group, window))
    for long in np.flatnonzero(lengths > SHORT_BYTES):
        digest = hashlib.blake2b(data[starts[long]:ends[long]].tobytes(), digest_size=8).digest()
        hashes[long] = int.from_bytes(digest, "little")
    return hashes


@dataclass
class WordBlock:
    """Consecutive rows as word hashes: row r owns words[bounds[r]:bounds[r + 1]]."""

    first_row: int
    hashes: np.ndarray
    bounds: np.ndarray

    def local(self) -> np.ndarray:
        """The place of every word in its row."""
        return np.arange(self.hashes.size) - np.repeat(self.bounds[:-1], np.diff(self.bounds))

    def row_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, word, side="right") - 1

    def windows(self, size: int) -> np.ndarray:
        """Every word at which a window of ``size`` words of its row starts."""
        left = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(self.hashes.size)
        return np.flatnonzero(left >= size)


class WordHasher:
    """Cuts a column of texts into blocks of whole rows and hashes their words."""

    def __init__(self, block_bytes: int = 1 << 21, lower: bool = False):
        self.block_bytes, self.lower = block_bytes, lower  # lower: A-Z only
        self.word_powers = Powers(WORD_BASE)

    def blocks(self, texts: pa.Array) -> Iterator[WordBlock]:
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        row = 0
        while row < len(texts):
            upto = int(np.searchsorted(offsets, offsets[row] + self.block_bytes, side="right")) - 1
            upto = min(max(upto, row + 1), len(texts))
            yield self._block(row, data[offsets[row]:offsets[upto]], offsets[row:upto + 1] - offsets[row])
            row = upto

    def _block(self, first_row: int, data: np.ndarray, offsets: np.ndarray) -> WordBlock:
        if self.lower:
            data = _LOWER[data]
        inside = ~_BLANKS[data]
        before = np.zeros(data.size + 1, dtype=bool)  # whether a word may go on across this border
        before[1:] = inside
        before[offsets] = False
        starts = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(data.size + 1, dtype=bool)
        after[:-1] = inside
        after[offsets] = False
        ends = np.flatnonzero(inside & ~after[1:]) + 1
        return WordBlock(first_row, word_hashes(data, starts, ends), np.searchsorted(starts, offsets))

    def window_hashes(self, block: WordBlock, starts: np.ndarray, size: int) -> np.ndarray:
        return span_hashes(block.hashes, starts, starts + size, self.word_powers)


class HashIndex:
    """Distinct 64-bit keys -> their places, as tables with one key a slot; keys
    that find their slot taken go to the next table, which hashes otherwise."""

    BITS = 18

    def __init__(self, keys: np.ndarray):
        self.tables, left = [], np.arange(keys.size)
        while left.size:
            multiplier = (0x9E3779B97F4A7C15 * (2 * len(self.tables) + 1)) & _MASK
            slots, first = np.unique(self._slots(keys[left], multiplier), return_index=True)
            held, places = np.zeros(1 << self.BITS, dtype=np.int64), np.full(1 << self.BITS, -1, dtype=np.int64)
            held[slots], places[slots] = keys[left[first]], left[first]
            self.tables.append((multiplier, held, places))
            left = np.delete(left, first)

    def _slots(self, keys: np.ndarray, multiplier: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(multiplier)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key, -1 for others."""
        result = np.full(keys.size, -1, dtype=np.int64)
        for multiplier, held, places in self.tables:
            slot = self._slots(keys, multiplier)
            hit = np.flatnonzero(held[slot] == keys)
            result[hit] = np.maximum(result[hit], places[slot[hit]])
        return result
