"""Articles and alignment against a plain Python restatement."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomtext.operators.align import align_pairs, align_report, common_articles, zip_paragraphs
from loomtext.operators.articles import article_paragraphs
from loomtext.operators.split import hash_split, split_report
from loomtext.plans import aligned_pairs

SCHEMA = "lang string, law string, article string, text string, blk bigint, ord bigint"


def chunks(spark, rows, partitions=4):
    """Rows (lang, law, article, text) in reading order, three to a block."""
    numbered = [(*row, i // 3, i) for i, row in enumerate(rows)]
    random.Random(0).shuffle(numbered)
    return spark.createDataFrame(numbered, SCHEMA).repartition(partitions)


def grouped(rows, lang):
    found = defaultdict(list)
    for row_lang, law, article, text in rows:
        if row_lang == lang and article is not None:
            found[law, article] += [p for p in text.split("\n") if p.strip()]
    return found


def fits(a, b, lo=40, hi=900):
    return lo <= len(a) <= hi and lo <= len(b) <= hi and 0.4 <= len(a) / len(b) <= 2.5


def wanted(rows):
    ru, ky = grouped(rows, "ru"), grouped(rows, "ky")
    pairs, counts = [], dict.fromkeys(["paragraph_pairs", "article_pairs", "articles_skipped"], 0)
    for key in sorted(ru.keys() & ky.keys()):
        if len(ru[key]) == len(ky[key]):
            kept = [(*key, "paragraph", i, a, b) for i, (a, b) in enumerate(zip(ru[key], ky[key])) if fits(a, b)]
            pairs += kept
            counts["paragraph_pairs"] += len(kept)
        elif fits(" ".join(ru[key]), " ".join(ky[key])):
            pairs.append((*key, "article", 0, " ".join(ru[key]), " ".join(ky[key])))
            counts["article_pairs"] += 1
        else:
            counts["articles_skipped"] += 1
    counts |= {"articles_ru": len(ru), "articles_ky": len(ky), "articles_common": len(ru.keys() & ky.keys())}
    return pairs, counts


def case(article, ru, ky):
    """One article: lists of chunk texts for each language."""
    return [("ru", "ТК", article, t) for t in ru] + [("ky", "ТК", article, t) for t in ky]


L = "а" * 50
EDGES = [
    ("ru", "ТК", None, L), ("ky", "ТК", None, None),
    *case("one side", [L], []),
    *case("one fails", [f"{L}\nкороткий\n{L}"], [f"{L}\n{L}\n{L}"]),
    *case("all fail", ["x\ny"], ["x\ny"]),
    *case("joined passes", [f"{L}\n{L}"], [L + L]),
    *case("joined fails", [f"{L}\n{L}"], ["x"]),
    *case("joined too long", ["\n".join([L] * 30)], [L]),
    *case("both empty", [" \n\t\n"], ["\n"]),
    *case("one empty", ["\xa0"], [L]),
    *case("only separators", ["\x1c\n "], ["\x1c"]),
    *case("chunks", [L + "1", f"{L}2\n{L}3", "", L + "4"], [f"{L}1\n{L}2", f"{L}3\n{L}4"]),
    *case("untrimmed", ["  " + "б" * 38 + "  "], ["в" * 40 + "\r"]),
    *case("carriage return", [f"{L}\r\n{L}"], [f"{L}\n{L}"]),
    *case("line separator", [f"{L} {L}"], [L + L]),
    *[row for i, (a, b) in enumerate([(40, 100), (100, 40), (40, 101), (101, 40), (39, 50), (900, 900), (900, 901)])
      for row in case(f"lengths {i}", ["г" * a], ["д" * b])],
]


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        # A third of all chunks belong to one article.
        article = "hot" if rng.random() < 1 / 3 else str(rng.randrange(40))
        lines = [rng.choice(["", " ", "\xa0", "ж" * rng.randrange(1, 120)]) for _ in range(rng.randrange(1, 4))]
        rows.append((rng.choice(["ru", "ky"]), rng.choice(["ТК", "СК"]), article, "\n".join(lines)))
    # Some articles with equal paragraph counts.
    for i in range(20):
        size = rng.randrange(1, 6)
        rows += case(f"even {i}", ["ж" * rng.randrange(20, 80) for _ in range(size)],
                     ["\n".join("з" * rng.randrange(20, 80) for _ in range(size))])
    return rows


@pytest.mark.parametrize("rows", [EDGES, random_rows(1), random_rows(2)], ids=["edges", "random1", "random2"])
def test_alignment(spark, rows):
    frame = chunks(spark, rows)
    pairs, counts = wanted(rows)
    assert sorted(tuple(r) for r in align_pairs(frame).collect()) == sorted(pairs)
    assert {r.metric: r.n for r in align_report(frame).collect()} == counts

    ru, ky = grouped(rows, "ru"), grouped(rows, "ky")
    common = [(*key, len(ru[key]), len(ky[key])) for key in sorted(ru.keys() & ky.keys())]
    assert [tuple(r) for r in common_articles(frame).collect()] == common
    zipped = [(*key, i, a, b) for key in ru.keys() & ky.keys() if len(ru[key]) == len(ky[key])
              for i, (a, b) in enumerate(zip(ru[key], ky[key]))]
    assert sorted(tuple(r) for r in zip_paragraphs(frame).collect()) == sorted(zipped)

    paragraphs = [(*key, lang, i, p) for lang, side in (("ru", ru), ("ky", ky))
                  for key, ps in side.items() for i, p in enumerate(ps)]
    paragraphs += [(*key, lang, -1, "") for lang, side in (("ru", ru), ("ky", ky))
                   for key, ps in side.items() if not ps]
    assert sorted(tuple(r) for r in article_paragraphs(frame).collect()) == sorted(paragraphs)


def test_alignment_ignores_partitioning(spark):
    rows = random_rows(3)
    results = [sorted(map(tuple, align_pairs(chunks(spark, rows, p)).collect())) for p in (1, 17)]
    assert results[0] == results[1]


@pytest.mark.parametrize("law,text,named", [("ТК", None, "text"), (None, "т", "law")])
def test_null_fails(spark, law, text, named):
    frame = spark.createDataFrame([("ru", law, "1", text, 0, 0)], SCHEMA)
    with pytest.raises(Exception, match=f"null in required column {named}"):
        align_pairs(frame).collect()


def test_wide_exchange_is_by_position(spark):
    """Texts of one article are spread: none of them is grouped by article alone."""
    plan = zip_paragraphs(chunks(spark, EDGES))._jdf.queryExecution().toString()
    assert "pos" in plan and "SinglePartition" not in plan and "CartesianProduct" not in plan


def test_split(spark):
    keys = [("ТК", str(i)) for i in range(400)] + [("c0", f"статья {i}") for i in range(400)]
    frame = spark.createDataFrame(keys * 2, "law string, article string")
    got = hash_split(frame).distinct().collect()
    wanted_split = {k: "train" if int(hashlib.sha256(":".join(k).encode()).hexdigest(), 16) % 20 else "val" for k in keys}
    assert {(r.law, r.article): r.split for r in got} == wanted_split and len(got) == len(wanted_split)
    report = {r.split: (r.pairs, r.examples) for r in split_report(hash_split(frame)).collect()}
    n_val = 2 * sum(s == "val" for s in wanted_split.values())
    assert report == {"val": (n_val, 2 * n_val), "train": (1600 - n_val, 2 * (1600 - n_val))}


def test_no_article_in_both_splits(spark):
    frame = aligned_pairs(chunks(spark, random_rows(4)), modulus=2)
    per_article = frame.groupBy("law", "article").agg(F.count_distinct("split").alias("n")).collect()
    assert len(per_article) > 5 and all(r.n == 1 for r in per_article)


def test_a_third_language_makes_no_pairs(spark):
    text = "x" * 60
    rows = [("ru", "l", "1", text + "r"), ("ky", "l", "1", text + "k"), ("en", "l", "1", text + "e"), ("en", "l", "2", text), ("ky", "l", "2", text)]
    assert [(r.ru[-1], r.ky[-1]) for r in align_pairs(chunks(spark, rows)).collect()] == [("r", "k")]
    report = {r.metric: r.n for r in align_report(chunks(spark, rows)).collect()}
    assert report["articles_common"] == report["paragraph_pairs"] == 1


@pytest.mark.parametrize("column", [0, 4])
def test_null_language_or_block_fails(spark, column):
    row = ["ru", "l", "1", "text", 0, 0]
    row[column] = None
    with pytest.raises(Exception, match="null in required column"):
        article_paragraphs(spark.createDataFrame([tuple(row)], SCHEMA)).collect()


def test_pairs_take_two_scans(spark, small):
    plan = align_pairs(spark.read.schema(SCHEMA).parquet(f"{small}/part.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2
