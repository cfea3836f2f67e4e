"""Pairs of paragraphs, or of whole articles, of a two-language collection.

Both languages travel in one frame of chunks, told apart by ``lang``, so that
each exchange serves both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.defaults import PAIR_CHARS, PAIR_RATIO
from loomtext.functions import good_pair
from loomtext.operators.articles import ARTICLE, BLOCK, block_totals, place_paragraphs, split_chunks, with_start
from loomtext.session import stored_aside

Bounds = tuple[int, int]
Ratio = tuple[float, float]

RU, KY = "ru", "ky"
BY_PARAGRAPH = "paragraph"
BY_ARTICLE = "article"
SKIPPED = "skipped"


def _routed_blocks(split: DataFrame, chars: Bounds, ratio: Ratio) -> DataFrame:
    """Blocks with their article's paragraph counts and the way to align it.

    ``route`` is null for articles of one language only.  Whole-article pairs
    are decided from lengths, so a long article is skipped without its text.
    """
    return _routed(block_totals(split), chars, ratio)


def _routed(totals: DataFrame, chars: Bounds, ratio: Ratio) -> DataFrame:
    article = Window.partitionBy(*ARTICLE)

    def total(column: str, lang: str) -> Column:
        return F.sum(F.when(F.col("lang") == lang, F.col(column))).over(article)

    blocks = totals.withColumns({
        "n_ru": total("n", RU), "n_ky": total("n", KY), "c_ru": total("chars", RU), "c_ky": total("chars", KY),
    })

    def joined_chars(lang: str) -> Column:
        """Length of the article with its paragraphs joined by a space."""
        return F.col(f"c_{lang}") + F.greatest(F.col(f"n_{lang}") - 1, F.lit(0))

    route = (
        F.when(F.col("n_ru").isNull() | F.col("n_ky").isNull(), F.lit(None))
        .when(F.col("n_ru") == F.col("n_ky"), BY_PARAGRAPH)
        .when(good_pair(joined_chars(RU), joined_chars(KY), chars, ratio), BY_ARTICLE)
        .otherwise(SKIPPED)
    )
    return blocks.withColumn("route", route)


def _per_article(blocks: DataFrame) -> DataFrame:
    """One row per article; the blocks are partitioned for it already."""
    return blocks.groupBy(*ARTICLE).agg(
        F.max("n_ru").alias("n_ru"), F.max("n_ky").alias("n_ky"), F.min("route").alias("route")
    )


def _two_languages(chunks: DataFrame) -> DataFrame:
    """Split chunks of the two languages; a third has no part in the pairs."""
    return split_chunks(chunks).where(F.col("lang").isin(RU, KY))


def _placed_pairs(split: DataFrame, blocks: DataFrame, routes: list[str], chars: Bounds | None) -> DataFrame:
    """(law, article, route, pos, ru, ky): paragraph i with paragraph i, or all
    of an article at pos 0.

    Both routes share the placing of paragraphs and one exchange: by position
    for paragraphs, so a long article spreads over all partitions, and by
    article for whole ones.  Those have passed the gate already, so what is
    collected here holds at most that many characters.  Paragraphs out of range
    are dropped before the exchange; ``chars`` None leaves the gate out.
    """
    rows = place_paragraphs(split, with_start(blocks.where(F.col("route").isin(routes))), keep=["route"])
    by_paragraph = F.col("route") == BY_PARAGRAPH
    if chars is not None:
        rows = rows.where(~by_paragraph | F.length("paragraph").between(*chars))
    rows = rows.withColumn("at", F.when(by_paragraph, F.col("pos")).otherwise(0))

    def joined(lang: str) -> Column:
        mine = F.collect_list(F.when(F.col("lang") == lang, F.struct("pos", "paragraph")))
        text = F.array_join(F.transform(F.array_sort(mine), lambda p: p["paragraph"]), " ")
        # A side without its paragraph is no pair; a whole article may be blank.
        return F.when((F.size(mine) > 0) | ~F.first(by_paragraph), text).alias(lang)

    pairs = rows.groupBy(*ARTICLE, "route", "at").agg(joined(RU), joined(KY)).withColumnRenamed("at", "pos")
    return pairs.where(F.col("ru").isNotNull() & F.col("ky").isNotNull())


def _gated(pairs: DataFrame, chars: Bounds, ratio: Ratio) -> DataFrame:
    return pairs.where((F.col("route") == BY_ARTICLE) | good_pair(F.length("ru"), F.length("ky"), chars, ratio))


def common_articles(chunks: DataFrame) -> DataFrame:
    """Articles present in both languages with their paragraph counts, sorted."""
    articles = _per_article(_routed_blocks(_two_languages(chunks), PAIR_CHARS, PAIR_RATIO))
    return articles.where(F.col("route").isNotNull()).drop("route").orderBy(*ARTICLE)


def zip_paragraphs(chunks: DataFrame) -> DataFrame:
    """All paragraph pairs of articles with equal paragraph counts, before the gate."""
    split = _two_languages(chunks)
    blocks = _routed_blocks(split, PAIR_CHARS, PAIR_RATIO)
    return _placed_pairs(split, blocks, [BY_PARAGRAPH], None).select(*ARTICLE, "pos", "ru", "ky")


def align_pairs(chunks: DataFrame, chars: Bounds = PAIR_CHARS, ratio: Ratio = PAIR_RATIO) -> DataFrame:
    """Gated pairs (law, article, unit, pos, ru, ky).

    ``unit`` is 'paragraph' or 'article'.  No article gives both, so
    (law, article, pos) tells pairs apart; pos is 0 for a whole article.
    """
    split = _two_languages(chunks)
    blocks = _routed_blocks(split, chars, ratio)

    pairs = _gated(_placed_pairs(split, blocks, [BY_PARAGRAPH, BY_ARTICLE], chars), chars, ratio)
    return pairs.select(*ARTICLE, F.col("route").alias("unit"), "pos", "ru", "ky")


def align_report(chunks: DataFrame, chars: Bounds = PAIR_CHARS, ratio: Ratio = PAIR_RATIO) -> DataFrame:
    """Counters (metric, n): articles per language and common, pairs, articles skipped.

    ``articles_skipped`` counts articles with unequal paragraph counts that
    fail the gate; equal-count articles whose paragraphs all fail are not
    counted.

    Every counter depends on lengths alone, so chunks are read once, as arrays
    of paragraph lengths that are stored aside.  Each block and each pair of
    lengths then adds its share to one tagged aggregate.
    """
    lengths = F.transform("paragraphs", lambda p: F.length(p))
    narrow = stored_aside(_two_languages(chunks).select(*BLOCK, "ord", lengths.alias("lengths")))
    totals = narrow.groupBy(*BLOCK).agg(
        F.sum(F.size("lengths")).alias("n"),
        F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda total, n: total + n)).alias("chars"),
    )
    blocks = stored_aside(_routed(totals, chars, ratio))
    route = F.col("route")
    articles = {
        "articles_ru": F.col("n_ru").isNotNull(), "articles_ky": F.col("n_ky").isNotNull(), "articles_common": route.isNotNull(),
        "article_pairs": route == BY_ARTICLE, "articles_skipped": route == SKIPPED,
    }
    tags = F.array(*[F.struct(F.lit(name).alias("metric"), F.coalesce(one.cast("bigint"), F.lit(0).cast("bigint")).alias("n")) for name, one in articles.items()])

    by_paragraph = with_start(blocks.where(route == BY_PARAGRAPH))
    placed = place_paragraphs(narrow.withColumnRenamed("lengths", "paragraphs"), by_paragraph).withColumnRenamed("paragraph", "length")
    placed = placed.where(F.col("length").between(*chars))

    def side(lang: str) -> Column:
        return F.max(F.when(F.col("lang") == lang, F.col("length"))).alias(lang)

    pairs = placed.groupBy(*ARTICLE, "pos").agg(side(RU), side(KY))
    good = F.coalesce(good_pair(F.col(RU), F.col(KY), chars, ratio).cast("bigint"), F.lit(0).cast("bigint"))
    counted = _per_article(blocks).select(F.inline(tags)).unionByName(pairs.select(F.lit("paragraph_pairs").alias("metric"), good.alias("n")))
    zeros = F.array(*[F.struct(F.lit(name).alias("metric"), F.lit(0).cast("bigint").alias("n")) for name in [*articles, "paragraph_pairs"]])
    every = counted.sparkSession.range(1).select(F.inline(zeros))  # an empty collection has all counters too
    return counted.unionByName(every).groupBy("metric").agg(F.sum("n").alias("n"))


def gate(pairs: DataFrame, chars: Bounds = PAIR_CHARS, ratio: Ratio = PAIR_RATIO) -> Column:
    """The pair gate as a condition on columns ru and ky."""
    return good_pair(F.length(pairs["ru"]), F.length(pairs["ky"]), chars, ratio)
