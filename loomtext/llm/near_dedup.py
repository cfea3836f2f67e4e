"""Near-duplicate documents by tensored MinHash banding (operator 5).

Two small collections of short MinHash keys are computed for a document; every
pair of one key from each collection is the key of one table.  So 2 x 10 keys
from 40 minhashes serve 100 tables.  Tables only nominate pairs; every link is
confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.hashing import WordHasher, mixed, span_hashes
from loomtext.llm.spark_tools import checkpointed, components, skew_join
from loomtext.llm.words import releasing

SHINGLE = 5
SIDE_KEYS = 10  # keys in each collection
KEY_MINHASHES = 2  # minhashes in a key
SMALL_BUCKET = 16
ROUNDS = 4
BLOCK_SHINGLES = 1 << 18  # about so many shingles in a block of documents that are compared with another


def shingle_sets(hasher: WordHasher, block) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every row, one after the other, and
    where each row's begin.  A row with fewer words has its whole sequence as
    its one shingle; a row without words has none."""
    starts = block.windows(SHINGLE)
    hashes, rows = hasher.window_hashes(block, starts, SHINGLE), block.row_of(starts)
    sizes = np.diff(block.bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    whole = span_hashes(block.hashes, block.bounds[short], block.bounds[short + 1], hasher.word_powers)
    hashes, rows = np.concatenate((hashes, whole)), np.concatenate((rows, short))
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    fresh = np.ones(hashes.size, dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[fresh], rows[fresh]
    return hashes, np.searchsorted(rows, np.arange(sizes.size + 1))


def side_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The keys of both collections for every row with shingles."""
    rng = np.random.default_rng(20)
    begins = bounds[:-1][np.diff(bounds) > 0]
    keys = np.zeros((begins.size, 2 * SIDE_KEYS), dtype=np.uint64)
    for key in range(2 * SIDE_KEYS):
        for _ in range(KEY_MINHASHES):
            seed, odd = rng.integers(0, 1 << 63, size=2, dtype=np.uint64)
            drawn = (hashes ^ seed) * (odd | np.uint64(1))
            drawn ^= drawn >> np.uint64(31)
            drawn *= np.uint64(0x9E3779B97F4A7C15)
            keys[:, key] = mixed(keys[:, key] ^ np.minimum.reduceat(drawn, begins))
    return keys


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, keys) of every row; the two longs stand
    for the set, ``keys`` is null without shingles."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            for block in hasher.blocks(batch.column(1)):
                hashes, bounds = shingle_sets(hasher, block)
                sizes = np.diff(bounds)
                some = sizes > 0
                totals = np.zeros((sizes.size, 2), dtype=np.int64)
                if some.any():
                    for side, seed in enumerate((0x51, 0xA7)):
                        totals[some, side] = np.add.reduceat(mixed(hashes ^ np.uint64(seed)), bounds[:-1][some]).view(np.int64)
                    flat = side_keys(hashes, bounds).view(np.int64).ravel()
                else:
                    flat = np.zeros(0, dtype=np.int64)
                offsets = np.concatenate(([0], np.cumsum(some) * 2 * SIDE_KEYS)).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first_row, sizes.size), pa.array(sizes), pa.array(totals[:, 0].copy()),
                     pa.array(totals[:, 1].copy()), keys],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "keys"],
                )

    source = docs.select(F.col(doc_id).cast("bigint"), F.col(text))
    return source.mapInArrow(releasing(signed), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, keys array<bigint>")


def shared_tables(classes: DataFrame) -> DataFrame:
    """(key, id, size, n, centre, centre_size): the tables in which a class meets
    others, of n classes in all, from (id, size, keys).

    First each of the 2 x 10 keys is counted on its own: a table key can only be
    shared if both its halves are, so the 100 combinations are formed of shared
    halves alone.  The centre of a table is the member whose halves are shared
    most often: copies of one text agree less among themselves than with the
    text they come from.
    """
    halves = classes.select("id", "size", F.posexplode("keys").alias("side", "half")).select("id", "size", "side", F.xxhash64("side", "half").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1")
    sides = skew_join(halves, shared, "half").groupBy("id", "size").agg(
        F.collect_list(F.struct("side", "half")).alias("halves"), F.sum("n").alias("weight")
    )

    def side_of(first: bool) -> Column:
        return F.filter("halves", lambda h: (h.side < SIDE_KEYS) if first else (h.side >= SIDE_KEYS))

    tables = sides.select("id", "size", "weight", F.explode(side_of(True)).alias("x"), side_of(False).alias("ys")).select(
        "id", "size", "weight", "x", F.explode("ys").alias("y")
    ).select("id", "size", "weight", F.xxhash64("x.half", "y.half").alias("key"))
    tables = checkpointed(tables)
    buckets = tables.groupBy("key").agg(
        F.count("*").alias("n"), F.max(F.struct("weight", F.xxhash64("key", "id").alias("turn"), "id", "size")).alias("top")
    ).where("n > 1").select("key", "n", F.col("top.id").alias("centre"), F.col("top.size").alias("centre_size"))
    return checkpointed(skew_join(tables, buckets, "key").select("key", "id", "size", "n", "centre", "centre_size"))


def _may_link(one: str, two: str, percent: int) -> Column:
    """Sets of too different sizes cannot be similar enough."""
    return 100 * F.least(one, two) >= percent * F.greatest(one, two)


def star_pairs(met: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared): each class with every centre it meets, and in how many
    tables; at most 100 narrow rows a class, of which few are ever compared."""
    apart = met.where((F.col("id") != F.col("centre")) & _may_link("size", "centre_size", percent))
    return apart.groupBy(F.col("id").alias("a"), F.col("centre").alias("b")).agg(F.count("*").alias("shared"))


def shingle_lists(docs: DataFrame, needed: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, set): the full sorted sets of all documents of ``needed`` (id)."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            for block in hasher.blocks(batch.column(1)):
                hashes, bounds = shingle_sets(hasher, block)
                rows = [hashes[bounds[r]:bounds[r + 1]].tobytes() for r in range(bounds.size - 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first_row, len(rows)), pa.array(rows, pa.binary())], names=["id", "set"]
                )

    source = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    # Rows of one id are one document: any of its texts may confirm a link.
    return checkpointed(source.join(needed, "id", "left_semi").mapInArrow(releasing(listed), "id bigint, set binary"))


def compared(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, share, linked) of every pair, from the full sets.  A set goes with
    a pair in one exchange only; the other side's is joined where it arrives."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares, linked = [], []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(side.as_buffer(), dtype=np.uint64) for side in (left, right))
                common = np.intersect1d(one, two, assume_unique=True).size
                union = one.size + two.size - common
                shares.append(common / max(union, 1))
                linked.append(100 * common >= percent * union)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(shares, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "share", "linked"]
            )

    one = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = one.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(releasing(measured), "a bigint, b bigint, share double, linked boolean")


def _labelled(rows: DataFrame, reached: DataFrame, column: str, label: str) -> DataFrame:
    """Rows with the component of the class named in ``column``."""
    known = reached.select(F.col("id").alias(column), F.col("component").alias("_found"))
    return rows.join(known, column, "left").withColumn(label, F.coalesce("_found", column)).drop("_found")


def _apart(pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    return _labelled(_labelled(pairs, reached, "a", "x"), reached, "b", "y").where("x <> y").drop("x", "y")


def _absorbed(reached: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``reached`` (id, component) with more links (a, b) between
    them.  Only links between different components are looked at."""
    across = _labelled(_labelled(links, reached, "a", "x"), reached, "b", "y").where("x <> y")
    joined = components(across.select(F.col("x").alias("a"), F.col("y").alias("b")))
    known = reached.union(joined.select("id", F.col("id").alias("component"))).distinct()
    return checkpointed(_labelled(known.withColumnRenamed("component", "old"), joined, "old", "component").select("id", "component"))


def linked_components(docs: DataFrame, met: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """(id, component) of the classes that have links: the components of all
    links among the pairs that meet in a table.

    In rounds, every class is compared with one centre only, the one it shares
    most tables with; pairs whose ends have met by then are never compared.  The
    second round takes, for what missed its first centre, the nearest of the
    classes that did link with it: of many copies, the nearest to any is the
    text they come from.  After the rounds all centres that are left are
    compared, and then whatever else meets in a table and is still apart: the
    members of small tables one by one, those of large ones in blocks.
    """
    sets = shingle_lists(docs, met.select("id").distinct(), doc_id, text)
    left = checkpointed(star_pairs(met, percent))
    picks = _best(left)
    reached = None
    for turn in range(ROUNDS):
        picks = checkpointed(picks)
        seen = checkpointed(compared(sets, picks, percent))
        linked = seen.where("linked").select("a", "b")
        reached = components(linked) if reached is None else _absorbed(reached, linked)
        left = checkpointed(_apart(left.join(picks, ["a", "b"], "left_anti"), reached))
        if turn == 0:
            nearest = seen.where("linked").groupBy("b").agg(F.max(F.struct("share", (-F.col("a")).alias("minus"))).alias("top"))
            picks = seen.where("NOT linked").select("a", F.col("b").alias("centre")).join(
                nearest.select(F.col("b").alias("centre"), (-F.col("top.minus")).alias("b")), "centre"
            ).select("a", "b").distinct()
        elif left.isEmpty():
            break
        else:
            picks = _best(left) if turn < ROUNDS - 2 else left.select("a", "b")
    return _rest(sets, met, reached, percent)


def _best(left: DataFrame) -> DataFrame:
    """Of the pairs of every class, the one that shares most tables."""
    return left.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def _rest(sets: DataFrame, met: DataFrame, reached: DataFrame, percent: int) -> DataFrame:
    """``reached`` with the links of classes that meet in a table of which
    neither is the centre, and that are still of different components."""
    # A table of two has no pair besides that of its centre.
    named = _labelled(met.where("n > 2").select("key", "id", "size", "n", "centre"), reached, "id", "own")
    mixed = named.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("key")
    several = checkpointed(skew_join(named, mixed, "key"))
    if several.isEmpty():
        return reached
    small = several.where(F.col("n") <= SMALL_BUCKET).groupBy("key").agg(F.collect_list(F.struct("id", "size", "own")).alias("members"))
    others = small.select("members", F.explode("members").alias("m")).select("m", F.explode(F.filter(
        "members", lambda o: (o.id > F.col("m.id")) & (o.own != F.col("m.own")) & (
            100 * F.least(o.size, F.col("m.size")) >= percent * F.greatest(o.size, F.col("m.size"))
        )
    )).alias("o")).select(F.col("m.id").alias("a"), F.col("o.id").alias("b")).distinct()
    reached = _absorbed(reached, checkpointed(compared(sets, others, percent)).where("linked"))
    stars = several.where((F.col("n") > SMALL_BUCKET) & (F.col("id") != F.col("centre")))
    stars = checkpointed(stars.select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct())
    found = None if stars.isEmpty() else family_links(sets, stars, reached, percent)
    return reached if found is None else _absorbed(reached, found)


def block_links(percent: int):
    """A function from the members (id, own, block, lo, hi, set) of two blocks,
    or of one if ``lo`` = ``hi``, to links (a, b) between members of different
    ``own``: enough of them to join all that any links join."""

    def linked(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(value.as_buffer(), dtype=np.uint64) for value in table.column("set")]
        order = np.argsort([one.size for one in sets], kind="stable")
        sets = [sets[row] for row in order]
        ids, own, block = (table.column(name).to_numpy()[order] for name in ("id", "own", "block"))
        single = table.column("lo")[0] == table.column("hi")[0]
        left = np.flatnonzero(block == table.column("lo")[0].as_py())
        right = np.flatnonzero(block == table.column("hi")[0].as_py())
        ends = np.cumsum([0, *(one.size for one in sets)])
        values, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        other = np.concatenate([numbers[ends[row]:ends[row + 1]] for row in right]) if right.size else numbers[:0]
        sizes = np.diff(ends)
        bounds, lengths = np.cumsum([0, *sizes[right]]), sizes[right]
        mark, label, pairs = np.zeros(values.size, dtype=np.uint8), own.copy(), []
        for at, row in enumerate(left):
            # Sets whose sizes differ too much cannot be linked.
            low = np.searchsorted(100 * lengths, percent * sizes[row])
            high = np.searchsorted(percent * lengths, 100 * sizes[row], side="right")
            low = max(low, at + 1) if single else low
            if low >= high or not (apart := label[right[low:high]] != label[row]).any():
                continue
            mine = numbers[ends[row]:ends[row + 1]]
            mark[mine] = 1
            common = np.add.reduceat(mark[other[bounds[low]:bounds[high]]], bounds[low:high] - bounds[low], dtype=np.int64)
            mark[mine] = 0
            hit = right[low:high][apart & (100 * common >= percent * (sizes[row] + lengths[low:high] - common))]
            joined, firsts = np.unique(label[hit], return_index=True)
            pairs += [(ids[row], ids[one]) for one in hit[firsts]]
            label[np.isin(label, joined)] = label[row]
        found = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(found[:, 0].copy()), "b": pa.array(found[:, 1].copy())})

    return linked


def family_links(sets: DataFrame, stars: DataFrame, reached: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) between different components of ``reached`` (id, component)
    that share a large bucket, or None if no bucket is of several components.

    ``stars`` are the pairs of a member and the centre of a large bucket.
    Components that meet in a bucket are of one family.  All members of a family
    that are not in its largest component are compared with all members of other
    components, in blocks of bounded size: two blocks are one group of their
    own, so a large family is spread over many tasks.
    """
    named = stars.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(reached, "id", "left")
    named = checkpointed(named.select("id", F.coalesce("component", "id").alias("own")))
    across = stars.join(named.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(
        named.select(F.col("id").alias("b"), F.col("own").alias("y")), "b"
    ).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    across = checkpointed(across.distinct())
    if across.isEmpty():
        return None
    families = components(across).select(F.col("id").alias("own"), F.col("component").alias("family"))
    filled = sets.where(F.length("set") > 0)
    sized = filled.groupBy("id").agg((F.sum(F.length("set")) / 8).cast("bigint").alias("n"))
    members = checkpointed(named.join(families, "own").join(sized, "id").select("id", "own", "family", "n"))
    of_own = members.groupBy("family", "own").agg(F.sum("n").alias("n"))
    of_family = of_own.groupBy("family").agg(F.sum("n").alias("n"), F.max(F.struct("n", "own")).alias("top"))

    def blocks(shingles: Column) -> Column:
        return F.ceil(shingles / BLOCK_SHINGLES).cast("bigint")

    planned = members.select("id", "own", "family").join(of_family.select(
        "family", F.col("top.own").alias("top"), blocks(F.col("n") - F.col("top.n")).alias("n_left"), blocks(F.col("top.n")).alias("n_top")
    ), "family")
    drawn, in_top = F.xxhash64("id"), F.col("own") == F.col("top")
    placed = planned.select(
        "id", "own", "family", F.when(in_top, F.col("n_left") + F.pmod(drawn, "n_top")).otherwise(F.pmod(drawn, "n_left")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_left") - 1 + F.when(in_top, 0).otherwise(F.col("n_top")))).alias("with"),
    ).select("id", "own", "family", "block", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))
    return placed.join(filled, "id").groupBy("family", "lo", "hi").applyInArrow(block_links(percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked whose sets of distinct 5-word shingles, A-Z lowered,
    have 100 * intersection >= percent * union.  ``component_id`` is the smallest
    id reachable over links and ``kept`` tells whether it is the row's own.

    A null or empty text has no shingles and is linked with nothing.  A null id
    cannot be compared: its component is null and the row is kept.  Rows of one
    id share a component; ids are meant to name one text.  Equal sets are one
    class before any table is built, so thousands of copies cost one row.  An
    empty table gives an empty result; other columns are not read.

    A link of similarity s meets in a table with probability
    (1 - (1 - s^2)^10)^2, which is 0.9995 at 0.75.
    """
    signed = checkpointed(signatures(docs, doc_id, text))
    classed = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = checkpointed(classed.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("id"), F.min("keys").alias("keys"), F.min("n_shingles").alias("size")
    ))
    met = shared_tables(classes.select("id", "size", "keys"))
    reached = linked_components(docs, met, doc_id, text, percent)
    of_class = classes.select("set_a", "set_b", "id").join(reached, "id", "left").select(
        "set_a", "set_b", F.coalesce("component", "id").alias("component_id")
    )
    # Thousands of copies share one set: both sides get an exchange of their own, whose hot keys can be split.
    same = F.concat_ws(":", F.col("set_a").cast("string"), F.col("set_b").cast("string"))
    rows = classed.withColumn("same", same).join(of_class.select(same.alias("same"), "component_id"), "same").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
