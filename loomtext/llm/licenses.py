"""Licence notices by a positional index of rare words (operator 11).

A template is the wording of a notice.  The index holds, for the words of each
template that are rarest in the corpus, the templates and places where they
stand.  A file's words are looked up there; postings of one template whose
places differ from the file's by the same amount belong together, and where
enough of them agree, the template's mandatory phrases are verified.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.hashing import HashIndex, byte_groups, mixed, padded_window

BLOCK_BYTES = 1 << 21  # of whole texts handled together
CHUNKS = 3  # words are compared as chunks of 8 bytes; longer words are in no template
RARE_WORDS = 8  # of every template, in the index
SLACK = 2  # words that may be missing or too many between two words of a notice
SHARE = 0.6  # of a template's rare weight that must agree

# Labels and phrases whose every place is reported.
BASE_PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))


@dataclass(frozen=True)
class Template:
    """A notice: its label, its wording, and phrases it cannot be without."""

    label: str
    text: str
    phrases: tuple[str, ...] = field(default=())


TEMPLATES = (
    Template("Apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    Template("Apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("you may not use this file except in compliance",)),
    Template("MIT", "released under the mit license", ("mit license",)),
    Template("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("GPL-3.0", "licensed under the gnu general public license version 3", ("general public license", "version 3")),
    Template("GPL-2.0", "licensed under the gnu general public license version 2", ("general public license", "version 2")),
    Template("LGPL", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("AGPL-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    Template("GPL", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("general public license", "free software")),
    Template("BSD", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "provided that the following conditions are met")),
    Template("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("CC-BY-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("CC-BY-NC-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("CC-BY-SA-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("CC0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
)

_WORD_BYTES = np.zeros(256, dtype=bool)
_WORD_BYTES[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def _chunks(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first bytes of every word as numbers of 8 bytes.  No word holds a zero
    byte, so words that fit are equal if and only if their numbers are."""
    window, result = padded_window(data), np.zeros((starts.size, CHUNKS), dtype=np.uint64)
    for chunk in range(CHUNKS):
        long = np.flatnonzero(lengths > 8 * chunk)
        result[long, chunk] = byte_groups(data, starts[long], lengths[long], chunk, window)
    return result


class Vocabulary:
    """The words of all templates and phrases, numbered; compared byte by byte."""

    def __init__(self, words: Sequence[str]):
        if long := [word for word in words if len(word.encode()) > 8 * CHUNKS]:
            raise ValueError(f"words of templates have at most {8 * CHUNKS} bytes: {long}")
        self.number = {word: i for i, word in enumerate(words)}
        encoded = [word.encode() for word in words]
        lengths = np.array([len(word) for word in encoded], dtype=np.int64)
        data = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        self.chunks = _chunks(data, np.cumsum(lengths) - lengths, lengths)
        self.index = HashIndex(self._keys(self.chunks))

    @staticmethod
    def _keys(chunks: np.ndarray) -> np.ndarray:
        keys = mixed(chunks[:, 0])
        for chunk in range(1, CHUNKS):
            keys = mixed(keys ^ chunks[:, chunk])
        return keys.view(np.int64)

    def lookup(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of every word, -1 for others."""
        found = np.full(starts.size, -1, dtype=np.int32)
        fits = np.flatnonzero(lengths <= 8 * CHUNKS)
        chunks = _chunks(data, starts[fits], lengths[fits])
        place = self.index.lookup(self._keys(chunks))
        known = np.flatnonzero(place >= 0)
        known = known[(self.chunks[place[known]] == chunks[known]).all(axis=1)]
        found[fits[known]] = place[known]
        return found


@dataclass
class Block:
    """Word numbers of consecutive rows: row r owns numbers[bounds[r]:bounds[r + 1]]."""

    numbers: np.ndarray
    bounds: np.ndarray

    def row_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, word, side="right") - 1


def _blocks(texts: pa.Array, vocabulary: Vocabulary) -> Iterator[Block]:
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(texts):
        upto = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1
        upto = min(max(upto, row + 1), len(texts))
        own, cuts = _LOWER[data[offsets[row]:offsets[upto]]], offsets[row:upto + 1] - offsets[row]
        inside = _WORD_BYTES[own]
        border = np.zeros(own.size + 1, dtype=bool)
        border[cuts] = True
        starts = np.flatnonzero(inside & (border[:-1] | ~np.concatenate(([False], inside[:-1]))))
        ends = np.flatnonzero(inside & (border[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        yield Block(vocabulary.lookup(own, starts, ends - starts), np.searchsorted(starts, cuts))
        row = upto


def _vocabulary(templates: Sequence[Template], base: Sequence[tuple[str, str]]) -> Vocabulary:
    texts = [t.text for t in templates] + [p for t in templates for p in t.phrases] + [p for _, p in base]
    return Vocabulary(sorted({word for text in texts for word in text.split()}))


def word_weights(docs: DataFrame, text: str, vocabulary: Vocabulary) -> np.ndarray:
    """log((1 + N) / (1 + n)) of every word, for the n of all N documents that hold
    it.  What comes to the driver is a number for each word of the templates."""
    n_words = len(vocabulary.number)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_words + 1, dtype=np.int64)  # the last one: documents
        for batch in batches:
            counts[-1] += batch.num_rows
            for block in _blocks(batch.column(0), vocabulary):
                hit = np.flatnonzero(block.numbers >= 0)
                each = np.unique(block.row_of(hit) * n_words + block.numbers[hit])
                counts[:-1] += np.bincount(each % n_words, minlength=n_words)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_words + 1)), pa.array(counts)], names=["word", "n"])

    found = docs.select(text).mapInArrow(counted, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_words + 1, dtype=np.int64)
    counts[found["word"].to_numpy()] = found["n"].to_numpy()
    return np.log((1.0 + counts[-1]) / (1.0 + counts[:-1]))


class PositionalIndex:
    """Postings (template, place, weight) of the rarest words of every template."""

    def __init__(self, templates: Sequence[Template], base: Sequence[tuple[str, str]], vocabulary: Vocabulary, weights: np.ndarray):
        def numbers(text: str) -> np.ndarray:
            return np.array([vocabulary.number[word] for word in text.split()], dtype=np.int32)

        self.vocabulary, self.templates = vocabulary, templates
        self.weights = weights + 1e-3  # words that all documents hold still count a little
        self.texts = [numbers(t.text) for t in templates]
        self.phrases = [[numbers(phrase) for phrase in t.phrases] for t in templates]
        self.base = [(label, numbers(phrase)) for label, phrase in base]
        postings = []
        for t, own in enumerate(self.texts):
            rarest = sorted(set(own.tolist()), key=lambda word: (-self.weights[word], word))[:RARE_WORDS]
            postings += [(word, t, place) for place, word in enumerate(own.tolist()) if word in rarest]
        table = np.array(sorted(postings), dtype=np.int64).reshape(-1, 3)
        self.template, self.place = table[:, 1], table[:, 2]
        self.cuts = np.searchsorted(table[:, 0], np.arange(len(vocabulary.number) + 1))
        self.needed = np.bincount(self.template, self.weights[table[:, 0]], minlength=len(templates)) * SHARE

    def base_places(self, block: Block, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, first word) of every place of a base phrase."""
        found = [(k, at) for k, (_, phrase) in enumerate(self.base) for at in [self._standing(block, hit, phrase)]]
        return np.concatenate([np.full(at.size, k) for k, at in found]), np.concatenate([at for _, at in found])

    @staticmethod
    def _standing(block: Block, at: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        at = at[at + phrase.size <= block.numbers.size]
        for i, word in enumerate(phrase):
            at = at[block.numbers[at + i] == word]
        return at[block.row_of(at) == block.row_of(at + phrase.size - 1)]

    def notices(self, block: Block, hit: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(row, template, first word, end, score) of every verified notice."""
        word = block.numbers[hit]
        n = self.cuts[word + 1] - self.cuts[word]
        which = np.repeat(np.arange(hit.size), n)
        posting = np.repeat(self.cuts[word] - np.cumsum(n) + n, n) + np.arange(which.size)
        template, place = self.template[posting], self.place[posting]
        row, start, weight = block.row_of(hit[which]), hit[which] - place, self.weights[word[which]]
        order = np.lexsort((place, start, template, row))
        row, template, start, place, weight = (values[order] for values in (row, template, start, place, weight))
        new = np.ones(row.size + 1, dtype=bool)
        new[1:-1] = (row[1:] != row[:-1]) | (template[1:] != template[:-1]) | (start[1:] - start[:-1] > SLACK)
        group = np.cumsum(new[:-1]) - 1
        # A word of the template counts once in a group, however often it stands there.
        _, once = np.unique(group * 4096 + place, return_index=True)
        total = np.bincount(group[once], weight[once], minlength=int(new[:-1].sum()))
        begin = np.flatnonzero(new)
        found = []
        for g in np.flatnonzero(total >= self.needed[template[begin[:-1]]]):
            part = slice(begin[g], begin[g + 1])
            notice = self._verified(block, int(row[begin[g]]), int(template[begin[g]]), start[part])
            if notice is not None:
                found.append(notice)
        return found

    def _verified(self, block: Block, row: int, t: int, starts: np.ndarray) -> tuple[int, int, int, int, float] | None:
        """The notice if every mandatory phrase stands near its place."""
        own, low, high = self.texts[t], int(block.bounds[row]), int(block.bounds[row + 1])
        first, end = max(int(starts[0]) - SLACK, low), min(int(starts[-1]) + own.size + SLACK, high)
        near = block.numbers[first:end]
        for phrase in self.phrases[t]:
            windows = np.lib.stride_tricks.sliding_window_view(near, phrase.size) if near.size >= phrase.size else np.zeros((0, phrase.size))
            if not (windows == phrase).all(axis=1).any():
                return None
        places, counts = np.unique(starts, return_counts=True)
        best = int(places[np.argmax(counts)])
        at = best + np.arange(own.size)
        stands = np.zeros(own.size, dtype=bool)
        for shift in range(-SLACK, SLACK + 1):
            there = (at + shift >= low) & (at + shift < high)
            stands[there] |= block.numbers[at[there] + shift] == own[there]
        weight = self.weights[own]
        return row, t, max(best, low), min(best + own.size, high), float(weight[stands].sum() / weight.sum())


FOUND_TYPE = (
    "n_words bigint, base array<struct<label:string,start:bigint>>, "
    "notices array<struct<label:string,start:bigint,end:bigint,score:double>>"
)


def _lists(n_rows: int, row: np.ndarray, columns: dict[str, pa.Array]) -> pa.ListArray:
    cuts = np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def _found(block: Block, index: PositionalIndex) -> pa.StructArray:
    n_rows = block.bounds.size - 1
    hit = np.flatnonzero(block.numbers >= 0)
    kind, at = index.base_places(block, hit)
    order = np.lexsort((kind, at))
    kind, at = kind[order], at[order]
    row = block.row_of(at)
    labels = np.array([label for label, _ in index.base], dtype=object)
    base = _lists(n_rows, row, {"label": pa.array(labels[kind], pa.string()), "start": pa.array(at - block.bounds[row], pa.int64())})
    notices = sorted(index.notices(block, hit), key=lambda x: (x[0], x[2], x[3], x[1]))
    rows = np.array([x[0] for x in notices], dtype=np.int64)
    found = _lists(n_rows, rows, {
        "label": pa.array([index.templates[x[1]].label for x in notices], pa.string()),
        "start": pa.array([x[2] - int(block.bounds[x[0]]) for x in notices], pa.int64()),
        "end": pa.array([x[3] - int(block.bounds[x[0]]) for x in notices], pa.int64()),
        "score": pa.array([x[4] for x in notices], pa.float64()),
    })
    return pa.StructArray.from_arrays([pa.array(np.diff(block.bounds).astype(np.int64)), base, found], names=["n_words", "base", "notices"])


def find_licenses(
    docs: DataFrame, text: str = "text", out: str = "licenses",
    templates: Sequence[Template] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE_PHRASES,
) -> DataFrame:
    """Add a struct ``out`` (n_words, base, notices).

    Words are runs of ASCII letters and digits, A-Z lowered, and of all other
    characters beyond ASCII.  ``base`` are all places (label, start) where a base
    phrase stands, by start and then in the order of ``base``; ``notices`` are
    the notices (label, start, end, score) found by the templates.  ``score`` is
    the share of the template's weight that stands at its place, up to ``SLACK``
    words off; words weigh their inverse document frequency over all of ``docs``.

    A null, empty or wordless text has no words, places or notices.  Rows are
    independent once the frequencies are known: repeated rows agree, an empty
    table stays empty, extra columns are kept, one named like ``out`` is
    replaced.  Notices of one place are listed by end and template.  The texts
    are read twice and nothing is exchanged but one count a template word and
    task; a task holds texts of ``BLOCK_BYTES`` together, a longer one alone.
    """
    vocabulary = _vocabulary(templates, base)
    index = PositionalIndex(templates, base, vocabulary, word_weights(docs, text, vocabulary))

    @F.arrow_udf(FOUND_TYPE)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [_found(block, index) for block in _blocks(batch, index.vocabulary)]
            yield pa.concat_arrays(parts or [_found(Block(np.zeros(0, np.int32), np.zeros(1, np.int64)), index)])

    return docs.withColumn(out, found(F.col(text)))
