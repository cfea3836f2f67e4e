"""Benchmark passages in documents by spaced-seed hashing (operator 4).

Fixed masks choose some of the tokens of a short span and ignore the others, so
a substituted word at an ignored place changes no hash.  Hashes of documents and
benchmark items are joined; around every hit the two texts are compared token
by token.  Everything is a built-in Spark expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.evaluate import gram_filter, might_hold

# Offsets of the tokens each mask looks at: 5 of a span of 6 to 8, found by a
# search for those that together miss fewest passages of 8 to 60 tokens of which
# a quarter is replaced at random.
MASKS = ((0, 1, 3, 4, 5), (0, 1, 2, 3, 6), (0, 2, 4, 5, 6), (0, 1, 2, 5, 7), (0, 3, 4, 6, 7), (0, 1, 4, 6, 7))
LONGEST = 8  # span of the longest mask; items with fewer tokens are sought whole
EXTENT = 6  # tokens compared on each side of a hit
OVERLAP = 12  # tokens that must be compared at least, or all of a shorter item
BROADCAST_ROWS = 100_000  # of at most about 300 bytes

Pattern = tuple[int, int, tuple[int, ...]]  # number, span, offsets


def token_hashes(text: Column) -> Column:
    """A 64-bit hash of every token: a run of letters and digits in lower case."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda token: token != "")
    return F.transform(tokens, lambda token: F.xxhash64(token))


def _keys(tokens: Column, at: Column, patterns: Sequence[Pattern], fits: Column | None = None) -> Column:
    """The key of every pattern at a place, null where the pattern does not fit."""
    keys = []
    for number, span, offsets in patterns:
        key = F.xxhash64(F.lit(number), *[F.get(tokens, at + offset) for offset in offsets])
        inside = at <= F.size(tokens) - span
        # An item shorter than the masks has only the pattern of its own length.
        own = F.lit(True) if fits is None else (fits >= LONGEST if number < len(MASKS) else fits == span)
        keys.append(F.when(inside & own, key))
    return F.array(*keys)


def _places(tokens: Column, least: int) -> Column:
    return F.when(F.size(tokens) >= least, F.sequence(F.lit(0), F.size(tokens) - least))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", similarity: float = 0.75,
) -> DataFrame:
    """(doc_id, item_id, hits, similarity) for each document that holds part of an item.

    A hit counts if, from ``EXTENT`` tokens before its span to as many after it,
    as far as both texts go, a share of at least ``similarity`` of the tokens is
    equal, and if that are ``OVERLAP`` tokens or the whole item.  ``hits`` is the
    number of such hits, ``similarity`` the best share.  Items with fewer tokens
    than the masks span are sought as their whole sequence, with no word replaced.
    Null and empty texts and items match nothing; repeated rows of one id count
    together, and a null id is an id of its own.  Ties need no order.  A text of
    any length is split into tokens once, and one row a place is made and dropped
    in a loop.  Empty tables give an empty result; other columns are not read.

    Up to ``BROADCAST_ROWS`` hashes of items are broadcast, after counting them.
    Beyond that a Bloom filter of the hashes, of 16 MB at most, is tested where a
    document is read, and only what passes it crosses to the join, with the
    tokens around.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), token_hashes(F.col(item_text)).alias("tokens"))
    short = items.select(F.size("tokens").alias("n")).where(f"n BETWEEN 1 AND {LONGEST - 1}").distinct().collect()  # 7 rows at most
    patterns = [(number, offsets[-1] + 1, offsets) for number, offsets in enumerate(MASKS)]
    patterns += [(len(MASKS) + n, n, tuple(range(n))) for n in sorted(row.n for row in short)]
    least = min(span for _, span, _ in patterns)

    left = F.least(F.col("at"), F.lit(EXTENT))
    index = (
        items.select("item_id", "tokens", F.explode(_places(F.col("tokens"), least)).alias("at"))
        .select("item_id", "tokens", "at", F.posexplode(_keys(F.col("tokens"), F.col("at"), patterns, F.size("tokens"))).alias("pattern", "key"))
        .where("key IS NOT NULL")
        .select(
            "key", "item_id", left.alias("left"), F.least(F.size("tokens"), F.lit(OVERLAP)).alias("needed"),
            F.slice("tokens", F.col("at") - left + 1, left + EXTENT + F.element_at(F.array(*[F.lit(p[1]) for p in patterns]), F.col("pattern") + 1)).alias("around"),
        )
    )
    source = docs.select(F.col(doc_id).alias("doc_id"), token_hashes(F.col(text)).alias("tokens"))
    places = source.select("doc_id", "tokens", F.explode(_places(F.col("tokens"), least)).alias("at"))
    keyed = places.select("doc_id", "tokens", "at", F.explode(_keys(F.col("tokens"), F.col("at"), patterns)).alias("key")).where("key IS NOT NULL")
    lead = F.least(F.col("at"), F.lit(EXTENT))
    near = (lead.alias("lead"), F.slice("tokens", F.col("at") - lead + 1, lead + LONGEST + EXTENT).alias("near"))
    n = index.count()
    if n <= BROADCAST_ROWS:
        # Tokens are copied for hits alone: everything up to the join is one generated loop.
        hits = keyed.join(F.broadcast(index), "key").select("doc_id", "item_id", "left", "needed", "around", *near)
    else:
        bits = 1 << min((16 * n).bit_length(), 27)
        known = gram_filter(index.select("key"), "key", bits).scalar()
        hits = keyed.where(might_hold(known, F.col("key"), bits)).select("doc_id", "key", *near).join(index, "key")
    begin = F.col("lead") - F.col("left")
    own = F.slice("near", F.greatest(begin, F.lit(0)) + 1, F.size("around") + F.least(begin, F.lit(0)))
    other = F.slice("around", F.greatest(-begin, F.lit(0)) + 1, F.size("around"))
    compared = hits.select("doc_id", "item_id", "needed", own.alias("own"), other.alias("other"))
    equal = F.size(F.filter(F.zip_with("own", "other", lambda x, y: F.coalesce(x == y, F.lit(False))), lambda same: same))
    n_compared = F.least(F.size("own"), F.size("other"))
    share = F.when(n_compared >= F.col("needed"), equal / n_compared)
    # Judged after the sums: as a filter, the comparison would move into the
    # join and there stop the generated loop.
    close = F.count(F.when(F.col("share") >= similarity, 1))
    return (
        compared.select("doc_id", "item_id", share.alias("share")).groupBy("doc_id", "item_id")
        .agg(close.alias("hits"), F.max("share").alias("similarity")).where("hits > 0")
    )
