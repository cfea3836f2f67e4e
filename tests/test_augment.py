"""Lexicon, numerals and mixture."""

import random
import re
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from catalog import queries
from loomtext.defaults import FRACTIONS, NUMERAL_DIGITS, NUMERALS
from loomtext.operators import evaluate
from loomtext.operators.lexicon import mine, substitute
from loomtext.operators.mixture import mixture_report, weighted_union
from loomtext.operators.numerals import candidates, variants
from loomtext.plans import augmentation, augmentation_report, augmented_mixture

PAIRS = [
    ("взыскивается одна четверть заработка", "кирешенин төрттөн бири"),
    ("половина дома, половина сада", "жарымы жана жарымы"),
    ("две трети голосов", "башка сөз"),
    ("нет дроби", "жарымы"),
    ("одна треть", "төрттөн бири"),
    ("одной четверти и половины", "жарымы"),
    ("наполовинал", "жарымынын"),
    ("половины", "үчтөн экиси жарымы"),
    ("двух пятых", "бештен экиси"),
]


def pair_frame(spark, pairs, partitions=3):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id bigint, ru string, ky string").repartition(partitions)


def wanted_mined(pairs, lexicon):
    targets = list(dict.fromkeys(k for _, k in lexicon))
    for i, (ru, ky) in enumerate(pairs):
        fr = next((r for r, _ in lexicon if r in ru), None)
        fk = next((k for k in targets if k in ky), None)
        if fr and fk and dict(lexicon)[fr] == fk:
            yield i, ru, ky, fr, fk


def wanted_variants(pairs, lexicon):
    for i, ru, ky, fr, fk in wanted_mined(pairs, lexicon):
        yield i, 0, ru, ky
        for o, (r, k) in enumerate(lexicon, 1):
            if k != fk:
                yield i, o, ru.replace(fr, r), ky.replace(fk, k)


def test_lexicon(spark):
    frame = pair_frame(spark, PAIRS)
    mined = mine(frame, FRACTIONS)
    assert sorted(map(tuple, mined.collect())) == sorted(wanted_mined(PAIRS, FRACTIONS))
    got = sorted(map(tuple, substitute(mined, FRACTIONS).collect()))
    assert got == sorted(wanted_variants(PAIRS, FRACTIONS))
    assert {11, 12} >= {sum(r[0] == i for r in got) for i in {r[0] for r in got}}


def test_lexicon_needs_no_exchange(spark):
    plan = substitute(mine(pair_frame(spark, PAIRS)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the fixture's own repartition


NUMBERED = [
    ("срок 20 дней", "мөөнөтү 20 күн"),
    ("20 и 20 и 30", "20 жана 30"),
    ("120 рублей", "120 сом"),
    ("20 20", "20"),
    ("с 30 по 20", "20дан 30га"),
    ("100 дней", "100 күн"),
    ("без чисел", "сансыз"),
    ("20", ""),
]


def wanted_candidates(pairs):
    for i, (ru, ky) in enumerate(pairs):
        for number in NUMERAL_DIGITS:
            pattern = rf"(?<!\d){number}(?!\d)"
            if len(re.findall(pattern, ru)) == 1 == len(re.findall(pattern, ky)):
                yield i, ru, ky, number
                break


def test_numerals(spark):
    frame = pair_frame(spark, NUMBERED)
    found = candidates(frame)
    wanted = {i: (ru, ky, d) for i, ru, ky, d in wanted_candidates(NUMBERED)}
    assert {r.id: (r.ru, r.ky, r.d) for r in found.collect()} == wanted

    rows = variants(found, ["id"], cap=800).collect()
    assert len(rows) == 4 * len(wanted) == len({(r.id, r.ord) for r in rows})
    for row in rows:
        ru, ky, d = wanted[row.id]
        wr, wk = NUMERALS[row.ord - 1]
        pattern = rf"(?<!\d){d}(?!\d)"
        assert (row.ru, row.ky) == (re.sub(pattern, wr, ru), re.sub(pattern, wk, ky))
    assert sorted(rows) == sorted(variants(candidates(pair_frame(spark, NUMBERED, 1)), ["id"]).collect())
    capped = variants(found, ["id"], cap=2).collect()
    assert len(capped) == 8 and set(capped) <= set(rows)


def test_random_numerals(spark):
    rng = random.Random(5)
    words = ["20", "30", "100", "120", "205", "сөз", ",", "٣20", "2020"]
    pairs = [tuple(" ".join(rng.choices(words, k=4)) for _ in "ab") for _ in range(300)]
    got = sorted(map(tuple, candidates(pair_frame(spark, pairs)).collect()))
    assert got == sorted(wanted_candidates(pairs)) and got


def test_a_long_lexicon_plans_fast_and_agrees(spark):
    """Ten thousand rows, of which the texts hold those of the short form only."""
    long = [(f"нет{i}", f"жок{i}") for i in range(5000)] + list(FRACTIONS) + [(f"ещё{i}", f"дагы{i}") for i in range(5000)]
    frame = pair_frame(spark, PAIRS)
    begin = time.perf_counter()
    mined, coverage = mine(frame, long), evaluate.lexicon_coverage(frame, long)
    mined._jdf.queryExecution().executedPlan(), coverage._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - begin < 5
    assert sorted(map(tuple, mined.collect())) == sorted(map(tuple, mine(frame, FRACTIONS).collect()))
    short = {r.ord: tuple(r)[1:] for r in evaluate.lexicon_coverage(frame, FRACTIONS).collect()}
    got = {r.ord: tuple(r)[1:] for r in coverage.collect()}
    assert len(got) == len(long) and {k - 5000: v for k, v in got.items() if any(v)} == {k: v for k, v in short.items() if any(v)}


def test_weighted_union(spark):
    a, b = spark.range(3), spark.range(10, 12)
    mixed = weighted_union({"a": (a, 20), "b": (b, 1), "none": (b, 0)})
    assert {r.component: r.n for r in mixture_report(mixed).collect()} == {"a": 60, "b": 2}
    assert mixed.distinct().count() == 62


def test_mixture_size_and_order(spark):
    pairs = PAIRS + NUMBERED
    mined = list(wanted_mined(pairs, FRACTIONS))
    a = len(list(wanted_variants(pairs, FRACTIONS)))
    n = 4 * len(list(wanted_candidates(pairs)))
    mixed = augmented_mixture(pair_frame(spark, pairs), ["id"])
    report = {r.component: r.n for r in mixture_report(mixed).collect()}
    assert mined and report == {"lexicon": 20 * a, "numeral": 3 * n, "original": len(pairs)}
    again = augmented_mixture(pair_frame(spark, pairs, 17), ["id"], partitions=3)
    assert mixed.collect() == again.collect()
    few = mixture_report(augmented_mixture(pair_frame(spark, pairs), ["id"], originals=5, numeral_cap=1)).collect()
    assert {r.component: r.n for r in few} == {"lexicon": 20 * a, "numeral": 12, "original": 5}


@pytest.mark.parametrize("limits", [{}, {"numeral_cap": 1, "originals": 5}])
def test_a_large_mixture_has_more_slices_in_the_same_order(spark, monkeypatch, limits):
    """No slice grows with the input, so none is sorted on disk."""
    frame = pair_frame(spark, PAIRS + NUMBERED)
    few = augmented_mixture(frame, ["id"], **limits)
    assert few.rdd.getNumPartitions() == 8
    text = sum(len((r.ru + r.ky).encode()) for r in few.collect())
    monkeypatch.setattr(augmentation, "SLICE_BYTES", text // 20, raising=False)
    many = augmented_mixture(frame, ["id"], **limits)
    assert many.rdd.getNumPartitions() in range(18, 25) and many.collect() == few.collect()
    assert augmented_mixture(frame, ["id"], partitions=3, **limits).rdd.getNumPartitions() == 3
    assert augmented_mixture(frame.where("false"), ["id"], **limits).collect() == []


@pytest.mark.parametrize("limits", [{}, {"numeral_cap": 1, "originals": 5}, {"numeral_cap": 10_000, "originals": 0}, {"copies": (0, 2)}])
def test_report_and_observed_counts_agree_with_the_rows(spark, limits):
    frame = pair_frame(spark, PAIRS + NUMBERED)
    seen = Observation()
    mixed = augmented_mixture(frame, ["id"], observation=seen, **limits).collect()
    by_component = {kind: sum(r.component == kind for r in mixed) for kind in ("lexicon", "numeral", "original")}
    assert seen.get == {**by_component, "total": len(mixed)}
    report = {r.metric: r.n for r in augmentation_report(frame, ["id"], **limits).collect()}
    assert {name: report[name] for name in seen.get} == seen.get
    n = len(PAIRS + NUMBERED)
    assert report["pairs"] == n and report["original_left_out"] == n - report["original"]
    assert report["mined"] == len(list(wanted_mined(PAIRS + NUMBERED, FRACTIONS))) and report["candidates"] == len(list(wanted_candidates(PAIRS + NUMBERED)))
    assert report["mined"] + report["substituted"] == len(list(wanted_variants(PAIRS + NUMBERED, FRACTIONS)))
    assert report["numeral_left_out"] == max(report["candidates"] - limits.get("numeral_cap", 10**9), 0)


def test_mixture_without_hits(spark):
    mixed = augmented_mixture(pair_frame(spark, [("а", "б")]), ["id"])
    assert [(r.component, r.ru, r.ky) for r in mixed.collect()] == [("original", "а", "б")]


def test_copies_spread_evenly(spark):
    """A row taken many times does not pile up in one partition."""
    frame = pair_frame(spark, [("половина", "жарымы")])
    mixed = augmented_mixture(frame, ["id"], copies=(400, 1), partitions=8)
    sizes = [r["count"] for r in mixed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_the_registered_mixture_leaves_nothing_out(spark, tmp_path):
    """Every pair and every numeral candidate, also beyond the sizes of the sampling queries."""
    parts = spark.range(1500).select(
        F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"),
        F.when(F.col("id") % 5 == 0, 30).otherwise(7).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice"),
    )
    parts.write.parquet(f"{tmp_path}/part.parquet")
    turns = [(0, 0, "user", "the bridge"), (0, 1, "assistant", "and the road"), (1, 0, "user", "no form"), (1, 1, "assistant", "none")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    mixed = queries.augment_mixture(spark, str(tmp_path))
    found = {r.component: (r.n, r.pairs) for r in mixed.groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("kind", "k", "turn").alias("pairs")).collect()}
    candidates = sum(key != 30 for key in range(0, 1500, 5))  # "30" stands twice in its own text
    assert found["original"] == (1502, 1502) and found["numeral"] == (candidates * 4 * 3, candidates)
    assert found["lexicon"][1] == 1
