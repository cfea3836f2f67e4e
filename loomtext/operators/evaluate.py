"""Checks of training sets and outputs: exact counts, one pass each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtext.functions import within
from loomtext.operators.lexicon import lexicon_rows
from loomtext.session import stored_aside

_GRAM_WORDS = 5
# Bits of a filter of item grams: 16 a gram, between these powers of two.  The
# upper one, 16 MB, bounds what comes to every task; with more grams the filter
# lets more pass, which costs time but no result.
_FILTER_BITS = (16, 27)
_PROBES = 4


def words(text: Column | str) -> Column:
    """The words of a text between spaces, tabs and line ends; none for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(column, F.lit("")), "[ \t\n\r]+"), lambda word: word != "")


def word_grams(tokens: Column, n: int) -> Column:
    """All runs of n words, each joined by single spaces."""
    places = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def held_out(items: DataFrame, corpus: DataFrame, text: str = "text", corpus_text: str = "text") -> DataFrame:
    """Items whose whole text is no text of the corpus; a null text is held out.
    Only digests that some item has are exchanged."""
    marked = items.withColumn("_digest", F.sha2(text, 256))
    sought = marked.select("_digest").distinct()
    digests = corpus.select(F.sha2(corpus_text, 256).alias("_digest")).join(sought, "_digest", "left_semi").distinct()
    return marked.join(digests, "_digest", "left_anti").select(*items.columns)


def normalised(text: Column | str) -> Column:
    """The text in lower case, with all but letters and digits as spaces."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " ")


def gram_hashes(tokens: Column, n: int) -> Column:
    """A 64-bit hash of every run of n words; ``tokens`` must be a plain column."""
    starts = F.when(F.size(tokens) >= n, F.slice(tokens, F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<string>"))
    return F.transform(starts, lambda word, i: F.xxhash64(word, *[F.get(tokens, i + k) for k in range(1, n)]))


def _probes(h: Column, bits: int) -> list[Column]:
    return [F.xxhash64(h, F.lit(k)).bitwiseAND(F.lit(bits - 1).cast("bigint")) for k in range(_PROBES)]


def gram_filter(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """One row, one array: a Bloom filter of ``bits`` bits, a power of two, in
    64-bit words.  Bits are set by partial aggregates, word by word."""
    spark = hashes.sparkSession
    place = hashes.select(F.explode(F.array(*_probes(F.col(column), bits))).alias("bit"))
    ones = place.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("ones"))
    zeros = spark.range(bits >> 6).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("ones"))
    words_of = zeros.union(ones).groupBy("word").agg(F.expr("bit_or(ones)").alias("ones"))
    return words_of.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "ones"))), lambda w: w.ones).alias("filter"))


def might_hold(filter_words: Column, h: Column, bits: int) -> Column:
    """Whether the filter may hold ``h``: never false for one it was made of."""
    tests = [
        F.call_function("getbit", F.get(filter_words, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1
        for place in _probes(h, bits)
    ]
    return reduce(lambda a, b: a & b, tests)


def _item_filter(hashes: DataFrame, column: str) -> tuple[Column, int]:
    """The filter of all values of a column, as a scalar, and its bits."""
    least, most = _FILTER_BITS
    bits = 1 << min(max((16 * hashes.count()).bit_length(), least), most)
    return gram_filter(hashes, column, bits).scalar(), bits


def _gram_hits(corpus: DataFrame, doc: str, tokens: Column, known: DataFrame, sizes: Sequence[int], reach: int) -> DataFrame:
    """(doc, n, hash, around, lead): the places of the corpus whose gram of n
    words may be one of ``known`` (column ``hash``), with up to ``reach`` words
    on either side; the gram begins after the first ``lead`` of them.

    The filter is tested where the text is read, so other grams cross no
    exchange, and the few that pass are stored: the corpus is read once.
    """
    scalar, bits = _item_filter(known, "hash")
    split = corpus.select(F.col(doc).alias("doc"), tokens.alias("w"))
    # One row a word, made and tested within one generated loop: no arrays of grams.
    at = split.select("doc", "w", F.posexplode("w").alias("at", "word"))

    def found(n: int) -> Column:
        h = F.xxhash64("word", *[F.get("w", F.col("at") + k) for k in range(1, n)])
        return F.when((F.col("at") <= F.size("w") - n) & might_hold(scalar, h, bits), F.struct(F.lit(n).alias("n"), h.alias("hash")))

    some = at.where(reduce(lambda a, b: a | b, [found(n).isNotNull() for n in sizes]))
    hits = some.select("doc", "w", "at", F.explode(F.array_compact(F.array(*map(found, sizes)))).alias("hit"))
    lead = F.least("at", F.lit(reach))
    around = F.slice("w", F.col("at") - lead + 1, lead + max(reach, max(sizes)))
    return stored_aside(hits.select("doc", "hit.n", "hit.hash", around.alias("around"), lead.alias("lead")))


def _items(items: DataFrame, item: str, tokens: Column) -> DataFrame:
    """(item, w, n): the words of every item that has some, and its gram size."""
    sought = items.select(F.col(item).alias("item"), tokens.alias("w")).where(F.size("w") > 0)
    return sought.withColumn("n", F.least(F.size("w"), F.lit(_GRAM_WORDS)))


def _item_grams(sought: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(item, w, n, at, hash): all grams of every item, of the item's own size."""
    hashes = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for size in sizes:
        hashes = hashes.when(F.col("n") == size, gram_hashes(F.col("w"), size))
    return sought.select("item", "w", "n", F.posexplode(hashes).alias("at", "hash"))


def contamination(
    items: DataFrame, corpus: DataFrame, item: str, doc: str, text: str = "text", corpus_text: str = "text",
) -> DataFrame:
    """(item, doc) for each item whose words stand in a row in a document.

    Of every item the gram that is rarest in the corpus is sought, by exact
    counts; where a document holds it, the words around it are compared.  No
    gram is too frequent: an item made of frequent grams alone still has a
    rarest one.  Items without a word are in no document.  The corpus is read
    once; a Bloom filter of the items' grams keeps all others out of the
    exchange, and a place takes no more words with it than the longest item has.
    """
    sought = _items(items, item, words(text))
    bounds = sought.groupBy("n").agg(F.max(F.size("w")).alias("longest")).collect()  # five rows at most
    if not bounds:
        schema = StructType([*items.select(item).schema, *corpus.select(doc).schema])
        return items.sparkSession.createDataFrame([], schema)
    sizes, reach = sorted(row.n for row in bounds), max(row.longest for row in bounds)
    grams = _item_grams(sought, sizes)
    hits = _gram_hits(corpus, doc, words(corpus_text), grams.select("hash").distinct(), sizes, reach)
    counts = hits.groupBy("n", "hash").agg(F.count(F.lit(1)).alias("count"))
    # An item with a gram that no document holds is in no document.
    rarest = grams.join(counts, ["n", "hash"], "left").groupBy("item", "w").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "hash", "at", "n")).alias("least")
    ).where("least.count > 0").select("item", "w", "least.hash", "least.at", "least.n")
    begin = F.col("lead") - F.col("at")
    same = (begin >= 0) & (F.slice("around", F.greatest(begin, F.lit(0)) + 1, F.size("w")) == F.col("w"))
    found = hits.join(rarest, ["n", "hash"]).where(same)
    return found.select(F.col("item").alias(item), F.col("doc").alias(doc)).distinct()


def containment(items: DataFrame, corpus: DataFrame, item: str, text: str = "text", corpus_text: str = "text") -> DataFrame:
    """(item, grams, held, share, grams_normalised, held_normalised,
    share_normalised): the different word grams of every item, how many of them
    some text of the corpus holds, and their share; as the texts are and with
    both sides ``normalised``.

    A gram is a run of five words, or all words of a shorter item.  Items
    without a word have no grams and a null share.  Grams are compared as words;
    hashes only keep those that no item has out of the exchange.
    """
    result = items.select(F.col(item).alias("item"))
    for name, change in (("", lambda column: F.col(column)), ("_normalised", normalised)):
        counted = _held_grams(items, corpus, item, words(change(text)), words(change(corpus_text)))
        share = F.col("held") / F.col("grams")
        result = result.join(counted.withColumn("share", share).toDF("item", *[f"{column}{name}" for column in ("grams", "held", "share")]), "item", "left")
    counts = [c for c in result.columns if c.startswith(("grams", "held"))]
    return result.select(F.col("item").alias(item), *[F.coalesce(c, F.lit(0)).alias(c) if c in counts else F.col(c) for c in result.columns[1:]])


def _held_grams(items: DataFrame, corpus: DataFrame, item: str, tokens: Column, corpus_tokens: Column) -> DataFrame:
    """(item, grams, held) of every item with words."""
    sought = _items(items, item, tokens)
    sizes = sorted(row.n for row in sought.select("n").distinct().collect())  # five at most
    if not sizes:
        return sought.select("item", F.lit(0).cast("bigint").alias("grams"), F.lit(0).cast("bigint").alias("held"))
    grams = _item_grams(sought, sizes)
    own = grams.select("item", "hash", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("gram")).distinct()
    hits = _gram_hits(corpus.withColumn("_row", F.lit(None)), "_row", corpus_tokens, grams.select("hash").distinct(), sizes, 0)
    held = hits.select(F.array_join(F.slice("around", F.lit(1), F.col("n")), " ").alias("gram")).distinct().withColumn("found", F.lit(1))
    return own.join(held, "gram", "left").groupBy("item").agg(F.count(F.lit(1)).alias("grams"), F.count("found").alias("held"))


def identical_outputs(outputs: DataFrame, one: str, two: str) -> DataFrame:
    """(n, same): contexts, and those where both arms gave the same bytes."""
    return outputs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(one) == F.col(two)).alias("same"))


def copy_rate(pairs: DataFrame, output: str, source: str, n: int = 3) -> DataFrame:
    """Add (grams, copied): the different n-grams of an output, and how many of
    them its own source holds."""
    split = pairs.withColumns({"_own": words(output), "_other": words(source)})
    own, other = word_grams(F.col("_own"), n), word_grams(F.col("_other"), n)
    return split.withColumns({
        "grams": F.size(F.array_distinct(own)), "copied": F.size(F.array_intersect(own, other)),
    }).drop("_own", "_other")


def fabricated_numbers(pairs: DataFrame, output: str, source: str) -> DataFrame:
    """Add ``invented``: the different numbers of an output that its source lacks,
    sorted as text and comma-joined."""
    def numbers(text: str) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{Nd}+"), F.lit(0))

    return pairs.withColumn("invented", F.array_join(F.array_sort(F.array_except(numbers(output), numbers(source))), ","))


def marker_language(texts: DataFrame, group: str, letters: str, text: str = "text") -> DataFrame:
    """(group, n, marked): rows, and rows that hold one of the letters."""
    held = F.translate(text, letters, "") != F.col(text)
    return texts.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(held).alias("marked"))


# Names and percents of the quantiles in the reports.
QUANTILES = {"q25": 25, "q50": 50, "q75": 75, "q95": 95}


def length_profile(texts: DataFrame, group: str, chars: tuple[int, int], text: str = "text") -> DataFrame:
    """By group: rows, rows under, within and over the bounds, and the sum,
    least, largest and exact quantiles (``QUANTILES``) of the lengths.  A null
    text counts in ``n`` alone.

    Rows are counted by group and length before the exchange; all else comes
    from these counts, of which a group has as many as it has lengths.
    """
    counts = texts.groupBy(group, F.length(text).alias("_length")).agg(F.count(F.lit(1)).alias("_n"))
    known = F.when(F.col("_length").isNotNull(), F.col("_n"))
    of_group = Window.partitionBy(group)
    placed = counts.withColumns({
        "_upto": F.sum(known).over(of_group.orderBy("_length")), "_total": F.sum(known).over(of_group),
    })
    length, lo, hi = F.col("_length"), *chars

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))

    quantiles = [
        F.min(F.when((known > 0) & (F.col("_upto") * 100 >= F.col("_total") * percent), length)).alias(name) for name, percent in QUANTILES.items()
    ]
    return placed.groupBy(group).agg(
        F.sum("_n").alias("n"), rows(length < lo).alias("under"), rows(length.between(lo, hi)).alias("kept"), rows(length > hi).alias("over"),
        F.sum(length.cast("bigint") * F.col("_n")).alias("chars"), F.min("_length").alias("shortest"), F.max("_length").alias("longest"), *quantiles,
    )


def exact_quantiles(rows: DataFrame, group: str, value: str, percents: Mapping[str, int] = QUANTILES, steps: int = 64) -> DataFrame:
    """By group: ``n``, the values that are not null, and their exact quantiles,
    for numbers from 0 up that may all be different.

    A first pass counts by group and coarse bucket, ``steps`` for each doubling;
    a second one counts the different values of the buckets that hold a
    quantile.  No task gets the values of a group, only their counts.
    """
    known = rows.select(F.col(group).alias("_group"), F.col(value).cast("double").alias("_value")).where("_value IS NOT NULL")
    bucketed = known.withColumn("_bucket", F.coalesce(F.floor(F.log2("_value") * steps).cast("int"), F.lit(-(1 << 30))))
    of_group = Window.partitionBy("_group")
    begins = bucketed.groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumns({
        "_upto": F.sum("_n").over(of_group.orderBy("_bucket")), "_total": F.sum("_n").over(of_group),
    })
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(percent).alias("percent")) for name, percent in percents.items()])
    rank = F.greatest(F.ceil(F.col("_total") * F.col("_asked.percent") / 100), F.lit(1))
    sought = begins.withColumn("_asked", F.explode(asked)).withColumn("_rank", rank - (F.col("_upto") - F.col("_n"))).where(
        F.col("_rank").between(1, F.col("_n"))
    ).select(F.col("_group").alias("g"), F.col("_bucket").alias("b"), F.col("_asked.name").alias("_name"), "_rank", F.col("_total").alias("_all"))
    here = F.col("_group").eqNullSafe(F.col("g")) & (F.col("_bucket") == F.col("b"))
    near = bucketed.join(sought.select("g", "b").distinct(), here, "left_semi")
    values = near.groupBy("_group", "_bucket", "_value").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_upto", F.sum("_n").over(Window.partitionBy("_group", "_bucket").orderBy("_value"))
    )
    found = values.join(sought, here & (F.col("_rank") > F.col("_upto") - F.col("_n")) & (F.col("_rank") <= F.col("_upto")))
    return found.groupBy(F.col("_group").alias(group)).agg(
        F.max("_all").alias("n"), *[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in percents]
    )


def ratio_profile(pairs: DataFrame, group: str, output: str, source: str) -> DataFrame:
    """By group: pairs with a source that is not empty, and exact quantiles of
    the length of ``output`` over that of ``source``."""
    ratio = F.try_divide(F.length(output).cast("double"), F.length(source).cast("double"))
    return exact_quantiles(pairs.select(group, ratio.alias("_ratio")), group, "_ratio")


def overflow(texts: DataFrame, bounds: Sequence[int], text: str = "text") -> DataFrame:
    """(bound, n, over): rows, and rows with more words than each bound."""
    counted = texts.select(F.size(words(text)).alias("size"))
    sums = counted.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("size") > bound).alias(f"over_{bound}") for bound in bounds])
    rows = [F.struct(F.lit(bound).alias("bound"), F.col("n"), F.col(f"over_{bound}").alias("over")) for bound in bounds]
    return sums.select(F.inline(F.array(*rows)))


def step_budget(examples: DataFrame, batch: int, accumulation: int, epochs: int = 1) -> DataFrame:
    """(n, steps): examples, and optimizer steps to see each ``epochs`` times."""
    steps = F.ceil(F.col("n") * epochs / (batch * accumulation)).cast("bigint")
    return examples.agg(F.count(F.lit(1)).alias("n")).withColumn("steps", steps)


def lexicon_coverage(pairs: DataFrame, lexicon: Sequence[tuple[str, str]]) -> DataFrame:
    """(ord, n_ru, n_ky, n_both) for every lexicon row: pairs that hold its form
    on either side and on both.  The plan does not grow with the lexicon."""
    held = F.transform(lexicon_rows(lexicon), lambda row: F.struct(
        row.ord.alias("ord"), F.contains("ru", row.lr).alias("one"), F.contains("ky", row.lk).alias("two")
    ))
    found = pairs.select(F.inline(F.filter(held, lambda row: row.one | row.two)))
    counts = found.groupBy("ord").agg(
        F.count_if("one").alias("n_ru"), F.count_if("two").alias("n_ky"), F.count_if(F.col("one") & F.col("two")).alias("n_both")
    )
    every = pairs.sparkSession.range(1, len(lexicon) + 1).select(F.col("id").cast("int").alias("ord"))
    zeros = [F.coalesce(name, F.lit(0)).alias(name) for name in ("n_ru", "n_ky", "n_both")]
    return every.join(counts, "ord", "left").select("ord", *zeros)
