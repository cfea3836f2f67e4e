"""Column functions on text.  All are built-in expressions, no UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.defaults import PAIR_CHARS, PAIR_RATIO, WHITESPACE


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_array(values: Sequence[str]) -> Column:
    """A constant array of strings, as one literal however many there are."""
    values = list(values)
    if not values or any("\0" in value for value in values):
        return F.lit(values) if values else F.array().cast("array<string>")
    return F.split(F.lit("\0".join(values)), "\0", -1)


def required(column: Column | str, name: str) -> Column:
    """The column itself; the job fails on the first null instead of hiding it."""
    return F.coalesce(_col(column), F.raise_error(F.lit(f"null in required column {name}")).cast("string"))


def present(column: Column | str, name: str) -> Column:
    """As ``required``, for a column of any type."""
    return F.coalesce(_col(column), F.raise_error(F.lit(f"null in required column {name}")))


def strip(column: Column | str) -> Column:
    """Remove Unicode whitespace at both ends; null becomes the empty string."""
    return F.coalesce(F.trim(_col(column), F.lit(WHITESPACE)), F.lit(""))


def has_text(column: Column | str) -> Column:
    """True when the string holds a character other than whitespace.

    Trimming one end looks at the leading characters only.
    """
    return F.ltrim(_col(column), F.lit(WHITESPACE)) != ""


def within(column: Column | str, bounds: tuple[int, int]) -> Column:
    """Length in code points, both bounds included."""
    return F.length(_col(column)).between(*bounds)


def good_pair(
    source: Column,
    target: Column,
    chars: tuple[int, int] = PAIR_CHARS,
    ratio: tuple[float, float] = PAIR_RATIO,
) -> Column:
    """Gate on the two *lengths* of a pair: each in range, and their ratio too."""
    low, high = ratio
    # A zero length is rejected by the first test, so nullif only keeps ANSI mode quiet.
    share = source / F.nullif(target, F.lit(0))
    return (
        source.between(*chars)
        & target.between(*chars)
        & F.coalesce(share.between(F.lit(low).cast("double"), F.lit(high).cast("double")), F.lit(False))
    )


def fill(template: str, text: Column | str, slot: str = "{text}") -> Column:
    """Put text into a template.  The text is data: braces, $ and \\ in it stay."""
    parts = template.split(slot)
    pieces = [F.lit(parts[0])]
    for part in parts[1:]:
        pieces += [_col(text), F.lit(part)]
    return F.concat(*pieces)


def number_once(text: Column | str, digits: Column) -> Column:
    """True when the number stands exactly once in the text, as a whole digit run."""
    text = _col(text)
    runs = F.regexp_extract_all(text, F.lit(r"\p{Nd}+"), F.lit(0))
    # The plain search is cheap and lets most texts skip the regular expression.
    return F.contains(text, digits) & (F.size(F.filter(runs, lambda run: run == digits)) == 1)


def put_number(text: Column | str, digits: Column, word: Column) -> Column:
    """Replace the whole digit run ``digits`` by ``word``, taken literally."""
    pattern = F.concat(F.lit(r"(?<!\p{Nd})"), digits, F.lit(r"(?!\p{Nd})"))
    literal = F.replace(F.replace(word, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(_col(text), pattern, literal)
