"""Quality rules, lines first (operator 6).

Every line is judged on its own by a punctuation, a navigation and a boilerplate
rule; failing lines go, and a document that loses too much of its text with
them is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.words import WORD

SYMBOLS = "#*$%&|<>"
# A line ends a sentence with one of these, whatever closing marks follow.
STOPS = (".", "!", "?", "…", ":", ";", "。", "！", "？")
CLOSING = "\"'”’»)]"
INNER_STOP = re.compile(r"[.!?…。！？] ")
# Marks that part the items of a menu; the last two count only between spaces.
DIVIDERS = ("|", "»", "•", " > ", " / ")
MENU = re.compile(
    r"(?:home|menu|search|next|previous|prev|back|log ?in|sign ?(?:in|up|out)|register|read more|share|"
    r"contact us|about us|site ?map|skip to (?:main )?content|top of page)\b", re.IGNORECASE,
)
BOILERPLATE = (
    "all rights reserved", "copyright ©", "copyright (c)", "copyright 19", "copyright 20", "privacy policy",
    "cookie policy", "uses cookies", "use cookies", "accept cookies", "terms of use", "terms of service",
    "enable javascript", "lorem ipsum", "subscribe to", "click here", "newsletter", "licensed under",
    "permission is hereby granted", "powered by",
)


@dataclass(frozen=True)
class LineRules:
    """Bounds of the line rules and of the document rule."""

    prose_words: int = 12  # a line this long may end without a stop if it has one inside
    symbols_per_word: float = 0.5  # above it, punctuation is noise
    menu_words: int = 5  # a line that opens like a menu entry and is no longer
    words_per_item: float = 3.0  # items between dividers are this short on the average
    max_lost: float = 0.5  # share of a document's word characters its failing lines may hold
    min_words: int = 50
    max_repeat_percent: int = 50

    def failure(self, line: str, n_words: int) -> str | None:
        """The rule a line with words fails, or None."""
        folded = line.lower()
        if any(phrase in folded for phrase in BOILERPLATE):
            return "boilerplate"
        dividers = sum(map(line.count, DIVIDERS))
        if dividers >= 2 and n_words <= self.words_per_item * (dividers + 1) or n_words <= self.menu_words and MENU.match(line.lstrip()):
            return "navigation"
        if sum(map(line.count, SYMBOLS)) > self.symbols_per_word * n_words:
            return "punctuation"
        if line.rstrip().rstrip(CLOSING).endswith(STOPS) or n_words >= self.prose_words and INNER_STOP.search(line):
            return None
        return "punctuation"


FIELDS = (
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_lines", pa.int64()),
    ("bad_punctuation", pa.int64()), ("bad_navigation", pa.int64()), ("bad_boilerplate", pa.int64()),
    ("lost_chars", pa.int64()), ("cleaned", pa.string()),
)
DDL = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, n_lines bigint, bad_punctuation bigint, bad_navigation bigint, bad_boilerplate bigint, "
    "lost_chars bigint, cleaned string"
)


def repeated_words(words: list[str]) -> int:
    """Words covered by a 3-word window that the text holds twice or more."""
    if len(words) < 4:
        return 0
    if len(set(zip(words, words[1:], words[2:]))) == len(words) - 2:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(word, len(numbers)) for word in words), dtype=np.int64, count=len(words))
    # Two steps, each into dense numbers, so no product leaves 64 bits.
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift:len(words) - 2 + shift] |= twice
    return int(covered.sum())


def judge(text: str | None, rules: LineRules) -> tuple:
    """All fields of one text, in the order of ``FIELDS``."""
    text = text or ""
    words: list[str] = []
    seen: set[str] = set()
    n_dup = n_lines = lost = 0
    bad = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    left = []
    for line in text.split("\n"):
        own = WORD.findall(line)
        if not own:
            left.append(line)
            continue
        words += own
        n_lines += 1
        n_dup += line in seen
        seen.add(line)
        failed = rules.failure(line, len(own))
        if failed is None:
            left.append(line)
        else:
            bad[failed] += 1
            lost += sum(map(len, own))
    word_chars = sum(map(len, words))
    n_repeat = repeated_words(words)
    base_failed = len(words) < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * len(words)
    kept = not base_failed and lost <= rules.max_lost * word_chars
    return (
        len(words), word_chars, sum(map(text.count, SYMBOLS)), n_dup, n_repeat, base_failed, kept, n_lines,
        bad["punctuation"], bad["navigation"], bad["boilerplate"], lost, "\n".join(left),
    )


def apply_line_rules(docs: DataFrame, text: str = "text", rules: LineRules | None = None, out: str = "quality") -> DataFrame:
    """Add a struct ``out`` with counts, verdicts and the text without failing lines.

    A null or empty text has no words and no lines, so it fails the base rule
    and its ``cleaned`` is empty.  Lines without a word are neither judged nor
    removed.  Rows are independent: repeated rows get equal verdicts, an empty
    table stays empty, extra columns are kept, and one named like ``out`` is
    replaced.  A text is held whole, one at a time; memory is a small multiple
    of the longest text.
    """
    rules = rules or LineRules()

    @F.arrow_udf(DDL)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [judge(text.as_py(), rules) for text in batch]
            columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
            yield pa.StructArray.from_arrays(
                [pa.array(values, kind) for values, (_, kind) in zip(columns, FIELDS, strict=True)], names=[name for name, _ in FIELDS]
            )

    return docs.withColumn(out, judged(F.col(text)))
