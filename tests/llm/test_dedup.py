"""Near duplicates (5) and repeated passages (7) against brute force."""

import hashlib
import random

import pytest
from helpers import clashing, empty, near_components, numbered, odd, removed_words
from pyspark.sql import functions as F

from loomtext.llm import near_dedup, spark_tools
from loomtext.llm.near_dedup import near_duplicates
from loomtext.llm.spark_tools import components
from loomtext.llm.substrings import COVER, PERIOD, remove_repeats


def _removed(df):
    rows = remove_repeats(df).select("doc_id", "text", "unique").collect()
    return [(r.doc_id, r.text, (r.unique.n_words, r.unique.n_removed, hashlib.sha256(r.unique.kept.encode()).hexdigest())) for r in rows]


def _near(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}


def test_cover_meets_every_distance():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_repeats_at_every_alignment(spark):
    rng = random.Random(1)
    rows = [(0, numbered(0, 120), "", "", 0)]
    for k in range(1, 70):
        first, n = rng.randrange(0, 60), rng.choice([49, 50, 51, 60])
        rows.append((k, f"{numbered(1000 * k, rng.randrange(40))} {numbered(first, n)}\n{numbered(1000 * k + 500, 5)}", "", "", 0))
    expected = removed_words([(r[0], r[1]) for r in rows])
    got = _removed(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    assert {(i, t): v for i, t, v in got} == expected and any(v[1] for v in expected.values())


def test_repeats_in_odd_documents(spark):
    got = _removed(clashing(odd(spark)))
    assert len(got) == 14
    expected = removed_words([(i, t) for i, t, _ in got])
    assert all(v == expected[i, t] for i, t, v in got)
    assert _removed(empty(spark)) == []


def test_repeats_on_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = _removed(docs)
    assert {(i, t): v for i, t, v in got} == removed_words([(r.doc_id, r.text) for r in docs.collect()])


def test_near_duplicates_on_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert _near(docs) == near_components([(r.doc_id, r.text) for r in docs.collect()])


def test_near_duplicates_of_odd_documents(spark):
    got = near_duplicates(clashing(odd(spark))).collect()
    assert len(got) == 14 and all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    by_id = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert by_id[5] == (56, 4, False) and by_id[7][1] == 6 and by_id[1] == (0, 1, True)
    assert near_duplicates(empty(spark)).count() == 0


def test_copies_of_one_text_find_their_centre(spark):
    """Copies with other words changed agree too little among themselves."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for k in range(300):
        own = list(base)
        for at in rng.sample(range(200), rng.choice([2, 4, 5])):
            own[at] = f"x{k}_{at}"
        rows.append((k, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert _near(frame) == near_components(rows)


def test_copies_whose_source_is_missing(spark, monkeypatch):
    """Links among members of a large bucket that none of them has with its centre."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 5_000, raising=False)  # several blocks
    rng = random.Random(3)
    rows = []
    for k in range(400):
        own = [f"b{i}" for i in range(200)]
        for at in rng.sample(range(200), rng.randint(3, 6)):
            own[at] = f"x{k}_{at}"
        rows.append((k, " ".join(own)))
    assert _near(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)) == near_components(rows)


@pytest.mark.parametrize("source", [True, False])
def test_compared_pairs_grow_with_the_copies(spark, monkeypatch, source):
    """Edited copies of one text: about as many comparisons as copies, not as pairs."""
    seen = []
    real = near_dedup.compared

    def counting(sets, pairs, percent):
        seen[-1] += pairs.count()
        return real(sets, pairs, percent)

    monkeypatch.setattr(near_dedup, "compared", counting)
    rng = random.Random(6)
    for n in (100, 400):
        rows = [(0, " ".join(f"b{i}" for i in range(200)))] if source else []
        for k in range(1, n + 1):
            own = [f"b{i}" for i in range(200)]
            for at in rng.sample(range(200), rng.randint(1, 4)):
                own[at] = f"x{n}_{k}_{at}"
            rows.append((k, " ".join(own)))
        seen.append(0)
        assert _near(spark.createDataFrame(rows, "doc_id bigint, text string")) == near_components(rows)
    assert seen[0] < 400 and seen[1] < 6 * seen[0]


def _thue_morse(first, second, n):
    return [first if bin(i).count("1") % 2 == 0 else second for i in range(n)]


def test_patterns_that_cancel_out_in_a_polynomial_hash(spark):
    """Words and windows of a Thue-Morse sequence and of its complement differ."""
    one, two = "".join(_thue_morse("a", "b", 4096)), "".join(_thue_morse("b", "a", 4096))
    short = ["".join(_thue_morse(x, y, 64)) for x, y in ("ab", "ba")]
    rows = [(1, one), (2, two), (3, one), (4, short[0]), (5, short[1]), (6, "a" * 63), (7, "a" * 64), (8, "a" * 65), (9, "a\x00"), (10, "a")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {name: 1 if name == 3 else name for name, _ in rows}
    windows = [(1, " ".join(_thue_morse("a", "b", 2048))), (2, " ".join(_thue_morse("b", "a", 2048)))]
    windows += [(3, " ".join([*numbered(0, 10).split(), *[one] * 30, *numbered(10, 30).split()])), (4, " ".join([*numbered(0, 10).split(), *[two] * 30, *numbered(10, 30).split()]))]
    cut = remove_repeats(spark.createDataFrame(windows, "doc_id bigint, text string"))
    got = {(r.doc_id, r.text): (r.unique.n_words, r.unique.n_removed, hashlib.sha256(r.unique.kept.encode()).hexdigest()) for r in cut.collect()}
    assert got == removed_words(windows)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(5, 9), (9, 5)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 5: 5, 9: 5}


def test_components_on_the_driver_agree(spark, monkeypatch):
    rng = random.Random(2)
    edges = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(40)], "a bigint, b bigint")
    here = {(r.id, r.component) for r in components(edges).collect()}
    monkeypatch.setattr(spark_tools, "LOCAL_EDGES", 0)
    assert here == {(r.id, r.component) for r in components(edges).collect()}


def test_estimates_do_not_grow_with_the_rounds(spark, monkeypatch):
    """Each round of a long chain joins what earlier rounds left; a size estimated
    from theirs would have five times as many digits after each."""
    monkeypatch.setattr(spark_tools, "LOCAL_EDGES", 0)
    chain = spark.range(300).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    found = components(chain)
    assert found.select("component").distinct().count() == 1 and found.count() == 301
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 60
