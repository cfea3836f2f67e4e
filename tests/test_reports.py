"""Reports on training sets against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomtext.operators import evaluate


def _words(text):
    return [w for w in re.split("[ \t\n\r]+", text or "") if w]


def _normal(text):
    return None if text is None else re.sub(r"[\W_]+", " ", text.lower())


def _grams(own, n):
    return {tuple(own[i:i + n]) for i in range(len(own) - n + 1)}


def _texts(seed, n, least, most, choices=8):
    rng = random.Random(seed)
    marks = ["", "", "", ".", ","]
    return [" ".join(rng.choice("abcdefgh"[:choices] + "AB") + rng.choice(marks) for _ in range(rng.randint(least, most))) for _ in range(n)]


ODD = [None, "", " \t\n ", "a", "zz zz", "a a a a a a a", "\u00a0", "a\u00a0b"]


def _frames(spark, seed):
    items = list(enumerate(_texts(seed, 60, 0, 9, 4) + ODD))
    docs = list(enumerate(_texts(seed + 1, 80, 0, 300, 4) + ODD))
    docs += docs[:10]
    return items, docs, spark.createDataFrame(items, "item_id bigint, text string").repartition(3), spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination_of_random_texts(spark, seed):
    items, docs, item_frame, doc_frame = _frames(spark, seed)
    lines = {(d, f" {' '.join(_words(t))} ") for d, t in docs}
    wanted = {(i, d) for i, t in items if _words(t) for d, line in lines if f" {' '.join(_words(t))} " in line}
    got = [tuple(r) for r in evaluate.contamination(item_frame, doc_frame, "item_id", "doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 20


def test_contamination_of_empty_tables(spark):
    items, docs, item_frame, doc_frame = _frames(spark, 3)
    for one, two in ((item_frame.limit(0), doc_frame), (item_frame.where("trim(text) = ''"), doc_frame), (item_frame, doc_frame.limit(0))):
        found = evaluate.contamination(one, two, "item_id", "doc_id")
        assert found.columns == ["item_id", "doc_id"] and found.count() == 0
        held = evaluate.containment(one, two, "item_id")
        assert held.count() == one.count() and held.where("held + held_normalised > 0").count() == 0


@pytest.mark.parametrize("bits", [(16, 27), (6, 6)])
def test_containment(spark, monkeypatch, bits):
    """Also with a filter so small that nearly everything passes it."""
    monkeypatch.setattr(evaluate, "_FILTER_BITS", bits)
    items, docs, item_frame, doc_frame = _frames(spark, 4)
    got = {r.item_id: r for r in evaluate.containment(item_frame, doc_frame, "item_id").collect()}
    assert len(got) == len(items)
    for change, names in ((lambda t: t, ("grams", "held", "share")), (_normal, ("grams_normalised", "held_normalised", "share_normalised"))):
        corpus = {n: set().union(*(_grams(_words(change(t)), n) for _, t in docs)) for n in range(1, 6)}
        for i, text in items:
            own = _words(change(text))
            grams = _grams(own, min(len(own), 5)) if own else set()
            held = len(grams & corpus[min(len(own), 5)]) if own else 0
            assert tuple(got[i][name] for name in names) == (len(grams), held, held / len(grams) if grams else None)


@pytest.mark.parametrize("bits", [1 << 6, 1 << 12, 1 << 20])
def test_a_filter_holds_what_it_was_made_of(spark, bits):
    hashes = spark.range(2000).select(F.xxhash64("id").alias("hash"))
    words = evaluate.gram_filter(hashes, "hash", bits).scalar()
    tested = spark.range(10_000).select("id", evaluate.might_hold(words, F.xxhash64("id"), bits).alias("might"))
    assert tested.where("id < 2000 AND NOT might").count() == 0
    others = tested.where("id >= 2000 AND might").count()
    assert others == 8000 if bits == 64 else others < (8000 if bits == 1 << 12 else 10)


def _quantile(values, percent):
    return sorted(values)[max(-(-len(values) * percent // 100), 1) - 1] if values else None


def test_exact_quantiles(spark):
    rng = random.Random(5)
    rows = [("one", rng.random() * 10 ** rng.randint(-9, 9)) for _ in range(3000)]
    rows += [("ties", rng.choice([0.0, 0.25, 1 / 3, 7.0])) for _ in range(999)] + [("hot", 1.5)] * 2000 + [("hot", 1.5000001)]
    rows += [(None, float(k)) for k in range(7)] + [("lone", 3.25), ("null", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r for r in evaluate.exact_quantiles(frame, "g", "v", {"least": 0, "q1": 1, "q50": 50, "q95": 95, "most": 100}).collect()}
    assert set(got) == {"one", "ties", "hot", "lone", None}
    for g, row in got.items():
        values = [v for name, v in rows if name == g and v is not None]
        assert row.n == len(values)
        assert [row[c] for c in ("least", "q1", "q50", "q95", "most")] == [_quantile(values, p) for p in (0, 1, 50, 95, 100)]
    assert evaluate.exact_quantiles(frame.limit(0), "g", "v").count() == 0


def test_length_profile(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), "x" * rng.choice([0, 3, 3, 3, 200, 250, 3000])) for _ in range(500)] + [("a", None), ("c", None)]
    got = {r.g: r for r in evaluate.length_profile(spark.createDataFrame(rows, "g string, text string"), "g", (200, 2000)).collect()}
    for g in ("a", "b", None):
        own = [len(t) for name, t in rows if name == g and t is not None]
        assert (got[g].n, got[g].kept, got[g].chars) == (sum(name == g for name, _ in rows), sum(200 <= n <= 2000 for n in own), sum(own))
        assert (got[g].shortest, got[g].q25, got[g].q50, got[g].q75, got[g].q95, got[g].longest) == (
            min(own), *(_quantile(own, p) for p in (25, 50, 75, 95)), max(own)
        )
    assert (got["c"].n, got["c"].under, got["c"].chars, got["c"].q50) == (1, 0, None, None)


def test_ratio_profile(spark):
    rows = [("t", "ab", "abcd"), ("t", "", "abcd"), ("t", "abc", ""), ("t", None, "a"), ("v", "abc", "a")]
    got = {r.g: (r.n, r.q25, r.q50, r.q95) for r in evaluate.ratio_profile(spark.createDataFrame(rows, "g string, s string, t string"), "g", "s", "t").collect()}
    assert got == {"t": (2, 0.0, 0.0, 0.5), "v": (1, 3.0, 3.0, 3.0)}
