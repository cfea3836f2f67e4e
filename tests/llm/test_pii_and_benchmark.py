"""Personal data (3) and benchmark passages (4)."""

import itertools
import random
import time

import pytest
from helpers import base_spans, clashing, empty, odd
from pyspark.sql import functions as F

from loomtext.llm import decontaminate, pii


def _base(df):
    found = pii.find_personal_data(df)
    return found.select("doc_id", "text", pii.span_list(F.filter("personal", lambda s: s.base)).alias("base"), pii.span_list(F.col("personal")).alias("spans"))


def test_base_spans_of_random_strings(spark):
    rng = random.Random(9)
    parts = [*"0123456789+.-() @é🙂", "a", "b.", "@x.y", "1.2.3.4", "255", "256", "4111111111111111", "+49 (30) 1234567", "a@b.c", "  ", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(600)]
    rows += [(900, "9 " * 3000), (901, "a" * 50_000 + "@"), (902, "1.2.3.4 " * 700), (903, "+" * 2000)]
    for row in _base(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        assert row.base == base_spans(row.text)
        assert set(filter(None, row.base.split(","))) <= set(row.spans.split(","))


def test_base_spans_of_the_table_and_odd_documents(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    assert all(row.base == base_spans(row.text) for row in _base(table).collect())
    rows = _base(clashing(odd(spark))).collect()
    assert len(rows) == 14 and all(row.base == base_spans(row.text) for row in rows)
    assert _base(empty(spark)).count() == 0


def test_many_spans_take_a_fixed_time_each(spark):
    """Texts of 30,000 and 100,000 numbers and of as many spans to mask."""
    times = []
    for n in (30_000, 100_000):
        rows = [(1, " ".join(f"w{i}" for i in range(n))), (2, "(040) 555-1234 x 1.2.3.4 " * (n // 2))]
        frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
        begin = time.perf_counter()
        found = pii.find_personal_data(frame)
        got = {r.doc_id: (r.text, r.base, r.m) for r in found.select(
            "doc_id", "text", pii.span_list(F.filter("personal", lambda s: s.base)).alias("base"), pii.masked(F.col("text"), F.col("personal")).alias("m")
        ).collect()}
        times.append((time.perf_counter() - begin) / n)
        assert all(base == base_spans(text) for text, base, _ in got.values())
        assert got[1][2] == got[1][0] and got[2][2].count("<IP>") == n // 2 and "1.2.3.4" not in got[2][2]
    assert times[1] < 3 * times[0] and times[1] < 1e-3


def _plain_apart(loose, base):
    return [m for m in loose if not any(s < m[1] and m[0] < e for s, e in base)]


def test_loose_spans_apart_from_strict_ones(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        cuts = sorted(rng.sample(range(400), 2 * rng.randrange(40)))
        loose = list(zip(cuts[::2], cuts[1::2], strict=True))
        base = [(s, s + rng.randint(1, 30)) for s in (rng.randrange(400) for _ in range(rng.randrange(60)))]
        rows.append((k, loose, base))
    kinds = "array<struct<start:int,end:int>>"
    frame = spark.createDataFrame(rows, f"k int, loose {kinds}, base {kinds}").repartition(3)
    for r in frame.select("k", pii.apart(F.col("loose"), F.col("base")).alias("free")).collect():
        assert [tuple(m) for m in r.free] == _plain_apart(*rows[r.k][1:])


def test_scans_of_any_length(spark):
    sizes = [0, 1, 31, 32, 33, 64, 65, 1023, 1025, 40_000]
    frame = spark.createDataFrame([(n, [(7 * i) % 11 for i in range(n)]) for n in sizes], "n int, v array<int>")
    for r in frame.select("n", "v", pii.scan(F.col("v"), F.lit(0), lambda a, x: a + x).alias("s"), pii.scan(F.col("v"), F.lit(0), F.greatest).alias("m")).collect():
        assert r.s == list(itertools.accumulate(r.v)) and r.m == list(itertools.accumulate(r.v, max))


def test_masking_of_overlapping_spans(spark):
    rng = random.Random(5)
    rows = []
    for k in range(200):
        text = "".join(rng.choice("abc é🙂\n") for _ in range(rng.choice([0, 5, 1023, 1024, 1025, 3000])))
        spans = [(rng.randrange(4), s, min(s + rng.randint(1, 1500), len(text))) for s in (rng.randrange(max(len(text), 1)) for _ in range(rng.randrange(6))) if s < len(text)]
        rows.append((k, text, spans))
    frame = spark.createDataFrame(rows, "k int, text string, spans array<struct<kind:int,start:int,end:int>>")
    for r in frame.select("k", pii.masked(F.col("text"), F.col("spans")).alias("m")).collect():
        _, text, spans = rows[r.k]
        parts, upto = [], 0
        for s, minus_end, kind in sorted((s, -e, kind) for kind, s, e in spans):
            if s >= upto:
                parts += [text[upto:s], f"<{pii.KINDS[kind].upper()}>"]
            upto = max(upto, -minus_end)
        assert r.m == "".join(parts) + text[upto:]


def test_votes_admit_likely_spans_only(spark):
    rows = [(i, f"please call +1 (40{i % 10}) 555-12{i % 100:02d} or mail a{i}@mail.com, card 4111111111111111 used") for i in range(60)]
    rows += [(100, "card 4111111111111112 used"), (101, "order 7777777777777777x9"), (102, "version 300.400.500.600")]
    spans = {r.doc_id: r.spans for r in _base(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert spans[102] == "" and all(spans[i].count(":") == 6 for i in range(60))


def test_masking(spark):
    row = spark.createDataFrame([("é mail a@b.c or 1.2.3.4!",), ("clean",), (None,)], "text string")
    out = pii.find_personal_data(row).select(pii.masked(F.col("text"), F.col("personal")).alias("m")).collect()
    assert {r.m for r in out} == {"é mail <EMAIL> or <IP>!", "clean", None}


def _tokens(n, first=0):
    return " ".join(f"t{i}" for i in range(first, first + n))


@pytest.mark.parametrize("rows", [decontaminate.BROADCAST_ROWS, 0])
def test_substituted_passages_are_found(spark, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    item = _tokens(40).split()
    few, many = list(item), list(item)
    for at in (5, 17, 29):
        few[at] = "other"
    for at in range(0, 40, 2):
        many[at] = "other"
    docs = spark.createDataFrame([
        (1, f"before {' '.join(item).upper()} after"), (2, f"x, {', '.join(few)}."), (3, " ".join(many)), (4, _tokens(11, 200)),
        (5, "short answer here now"), (6, None), (7, ""), (8, " ".join(item[:20])), (None, " ".join(item)), (None, "clean"),
    ], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "answer here"), (3, None), (4, ""), (1, " ".join(item))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(clashing(docs), items).collect()}
    assert set(got) == {(1, 1), (2, 1), (8, 1), (None, 1), (5, 2)} and got[1, 1] == 1.0


def test_recall_of_passages_with_replaced_words(spark):
    """Items of 8 to 60 tokens with a tenth to a quarter of them replaced anywhere."""
    rng = random.Random(12)
    items, docs, kinds = [], [], []
    for n in (8, 9, 12, 16, 20, 24, 40, 60):
        for share in (0.1, 0.2, 0.25):
            for _ in range(60):
                number = len(items)
                own = [f"w{rng.randrange(3000)}" for _ in range(n)]
                items.append((number, " ".join(own)))
                for at in rng.sample(range(n), int(n * share)):
                    own[at] = f"other{rng.randrange(3000)}"
                around = [" ".join(f"w{rng.randrange(3000)}" for _ in range(30)) for _ in range(2)]
                docs.append((number, f"{around[0]} {' '.join(own)} {around[1]}"))
                kinds.append((n, share))
    clean = [(10_000 + k, " ".join(f"w{rng.randrange(3000)}" for _ in range(200))) for k in range(300)]
    frame = spark.createDataFrame(docs + clean, "doc_id bigint, text string").repartition(4)
    found = decontaminate.contaminated(frame, spark.createDataFrame(items, "item_id bigint, text string")).select("doc_id", "item_id").collect()
    hit = {r.doc_id for r in found if r.doc_id == r.item_id}
    for kind in set(kinds):
        numbers = [k for k, other in enumerate(kinds) if other == kind]
        assert sum(k in hit for k in numbers) >= 0.9 * len(numbers), kind
    assert not [r for r in found if r.doc_id != r.item_id]


def test_a_fragment_at_the_edge_is_no_hit(spark):
    """Few tokens of an item at the end of a text are not enough."""
    item = _tokens(30)
    docs = [(1, f"some other words {_tokens(7)}"), (2, _tokens(7, 23) + " goes on like this and that"), (3, f"x {_tokens(12)}"), (4, _tokens(6))]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert {r.doc_id for r in got.collect()} == {3}


def test_no_items_and_no_documents(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(odd(spark), items).count() == 0
    assert decontaminate.contaminated(empty(spark), items).count() == 0
