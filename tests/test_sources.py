import gzip
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomtext.operators.corpus import head_corpus
from loomtext.operators.articles import article_paragraphs
from loomtext.operators.ordering import sample_n
from loomtext.plans import aligned_pairs, augmented_mixture, pretraining_corpus, summary_examples, translation_texts
from loomtext.sources import (
    CORPUS_ORDER,
    corpus_bucket,
    read_corpus,
    read_law_chunks,
    read_lines,
    read_pairs,
    read_prompt_answers,
    read_summary_split,
    write_jsonl,
    write_split_jsonl,
    write_training_text,
)


def jsonl(path, rows):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")


def lines_of(folder):
    return [json.loads(line) for part in sorted(folder.rglob("part-*")) for line in part.read_text("utf-8").split("\n") if line]


@pytest.fixture
def many_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_chunk_order_over_files_and_splits(spark, tmp_path, many_splits):
    rng = random.Random(0)
    wanted = {}
    for name in ("b_kg", "a_kg", "c_kg"):
        rows = []
        for i in range(150):
            article = rng.choice(["1", "2", "3", None])
            text = "\n".join(f"{name} {i}.{j} абзац" for j in range(rng.randrange(3)))
            rows.append({"LawCode": "ТК", "ArticleNumber": article, "Text": text, "Other": 1})
        jsonl(tmp_path / f"{name}.jsonl", rows)
        wanted[name] = rows
    jsonl(tmp_path / "a_ru.jsonl", [{"LawCode": "x", "ArticleNumber": "1", "Text": "нет"}])

    frame = read_law_chunks(spark, str(tmp_path), "kg", "ky")
    assert frame.rdd.getNumPartitions() > 8
    got = {}
    for r in article_paragraphs(frame).orderBy("article", "pos").collect():
        assert (r.lang, r.law) == ("ky", "ТК")
        got.setdefault(r.article, []).append(r.paragraph)
    expected = {}
    for name in sorted(wanted):
        for row in wanted[name]:
            if row["ArticleNumber"] is not None and row["Text"]:
                expected.setdefault(row["ArticleNumber"], []).extend(row["Text"].split("\n"))
    assert got == expected


def _some_lines(rng, n):
    ends = ["\n", "\n", "\r\n", "\n\n"]
    return "".join("ёжик" * rng.choice([0, 1, 5, 40]) + rng.choice(["", "x", " 🙂\u2028"]) + rng.choice(ends) for _ in range(n))


def test_places_of_lines_for_any_ranges(spark, tmp_path):
    rng = random.Random(8)
    texts = {"a b": _some_lines(rng, 90), "b": _some_lines(rng, 30) + "no end", "c": "", "d": "\n", "e": "one", "_hidden": "x\n", ".x": "y\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    with gzip.open(tmp_path / "z.gz", "wb") as packed:
        packed.write(texts["b"].encode())
    wanted = []
    for name, text in [*texts.items(), ("z.gz", texts["b"])]:
        at = 0
        for line in re.findall(rb"[^\n]*\n|[^\n]+", text.encode()):
            if name[0] not in "._":
                wanted.append((name, at, line.decode()))
            at += len(line)
    for size in (1, 7, 64, 1000, 1 << 20):
        frame = read_lines(spark, str(tmp_path), size)
        assert sorted(map(tuple, frame.collect())) == sorted(wanted)
    assert {r.file for r in read_lines(spark, str(tmp_path / "[ab]*")).collect()} == {"a b", "b"}
    with pytest.raises(Exception, match="no such file"):
        read_lines(spark, str(tmp_path / "absent")).collect()


def test_keys_and_draws_do_not_depend_on_the_split_size(spark, tmp_path):
    jsonl(tmp_path / "p.jsonl", [{"law": "a", "article": str(i % 7), "ru": "р" * (i % 90), "ky": "к"} for i in range(700)])
    jsonl(tmp_path / "q.jsonl", [{"law": "b", "article": None, "ru": "р", "ky": "к"}] * 50)
    results = []
    for size in ("500", "4096b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        pairs = read_pairs(spark, str(tmp_path))
        results.append((sorted(map(tuple, pairs.collect())), sorted(map(tuple, sample_n(pairs, 60, ["row"], 3).collect()))))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert results[0] == results[1] == results[2] and len({row[-1] for row in results[0][0]}) == 750


def test_files_sort_by_their_real_names(spark, tmp_path):
    names = ["a b_ru.jsonl", "a!_ru.jsonl", "a+_ru.jsonl", "a%_ru.jsonl", "б_ru.jsonl"]
    for name in names:
        jsonl(tmp_path / name, [{"LawCode": "ТК", "ArticleNumber": "1", "Text": name}])
    placed = article_paragraphs(read_law_chunks(spark, str(tmp_path), "ru")).orderBy("pos").collect()
    assert [r.paragraph for r in placed] == sorted(names)


def test_line_separator_stays_in_its_record(spark, tmp_path):
    jsonl(tmp_path / "a_ru.jsonl", [{"LawCode": "ТК", "ArticleNumber": "1", "Text": "а б"}])
    assert [r.text for r in read_law_chunks(spark, str(tmp_path), "ru").collect()] == ["а б"]


def test_malformed_and_missing(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"law": "a", \n')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        read_pairs(spark, str(tmp_path / "bad.jsonl")).collect()
    jsonl(tmp_path / "absent.jsonl", [{"law": "a", "article": "1", "ru": "x"}])
    with pytest.raises(Exception, match="null in required column ky"):
        read_pairs(spark, str(tmp_path / "absent.jsonl")).collect()
    jsonl(tmp_path / "answers.jsonl", [{"context": "c", "answer": "a"}, {"context": "c"}])
    with pytest.raises(Exception, match="null in required column answer"):
        read_prompt_answers(spark, str(tmp_path / "answers.jsonl")).collect()


def test_chunks_to_examples(spark, tmp_path):
    """The whole way: chunk files, pairs, split files, mixture, training texts."""
    text = "Взыскивается одна четверть заработка, срок {} дней, статья подряд."
    texty = "Кирешенин төрттөн бири өндүрүлөт, мөөнөтү {} күн, берене катары."
    for suffix, sentence in (("ru", text), ("kg", texty)):
        jsonl(tmp_path / f"code_{suffix}.jsonl", [
            {"LawCode": "СК", "ArticleNumber": str(i), "Text": sentence.format(20) + "\n" + sentence.format(i)}
            for i in range(1, 200)
        ])
    chunks = read_law_chunks(spark, str(tmp_path), "ru").unionByName(read_law_chunks(spark, str(tmp_path), "kg", "ky"))
    pairs = aligned_pairs(chunks)
    write_split_jsonl(pairs.select("law", "article", "ru", "ky", "split"), str(tmp_path / "pairs"))
    train, val = lines_of(tmp_path / "pairs" / "split=train"), lines_of(tmp_path / "pairs" / "split=val")
    assert len(train) + len(val) == 398 and 0 < len(val) < 60
    assert set(train[0]) == {"law", "article", "ru", "ky"}
    assert not {r["article"] for r in train} & {r["article"] for r in val}
    raw = next((tmp_path / "pairs").rglob("part-*")).read_text("utf-8")
    assert "\\u" not in raw and "төрттөн" in raw

    stored = read_pairs(spark, str(tmp_path / "pairs" / "split=train"))
    assert stored.select("row").distinct().count() == len(train)
    mixture = augmented_mixture(stored, ["law", "article", "row"], originals=50)
    write_jsonl(mixture.select("law", "article", "ru", "ky"), str(tmp_path / "aug"))
    # 12 lexicon rows, two with the same target as the one found: 1 + 10 variants.
    candidates = sum(r["ru"].count("20 дней") == 1 for r in train)
    assert len(lines_of(tmp_path / "aug")) >= 20 * 11 * len(train) + 3 * 4 * min(800, candidates) + 50

    write_training_text(translation_texts(stored, "<e>"), str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    assert texts.columns == ["text"] and texts.count() == 2 * len(train)


def test_null_fields_are_written(spark, tmp_path):
    write_jsonl(spark.createDataFrame([("а", None)], "x string, y string"), str(tmp_path / "out"))
    write_jsonl(spark.createDataFrame([("б", None)], "x string, y string"), str(tmp_path / "out"))
    assert lines_of(tmp_path / "out") == [{"x": "б", "y": None}]


def test_corpus_in_file_order(spark, tmp_path, many_splits):
    texts = ["т" * 250 + str(i) for i in range(500)]
    for name, part in (("b", texts[200:]), ("a", texts[:200])):
        frame = spark.createDataFrame([(t, 1) for t in part], "text string, z int").coalesce(1)
        frame.write.parquet(str(tmp_path / "corpus" / f"part={name}"))
    corpus = read_corpus(spark, str(tmp_path / "corpus" / "part=*"))
    for n in (20, 230):
        got = head_corpus(corpus, CORPUS_ORDER, n, bucket=corpus_bucket()).select("text").collect()
        assert [r.text for r in got] == texts[:n]
    everything = pretraining_corpus(corpus, CORPUS_ORDER, eos="<e>", bucket=corpus_bucket())
    assert everything.where("text like '%<e>'").count() == 500
    plan = corpus.select("text")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string" in plan and "z:int" not in plan


def test_summary_split(spark, tmp_path):
    for split, n in (("train", 3), ("validation", 2)):
        rows = [("т" * 400, "с" * 40, "url")] * n
        spark.createDataFrame(rows, "text string, summary string, url string").write.parquet(
            str(tmp_path / "kyrgyz" / split)
        )
    for split, n in (("train", 3), ("validation", 2)):
        frame = read_summary_split(spark, str(tmp_path), "kyrgyz", split)
        assert frame.columns == ["text", "summary"] and summary_examples(frame).count() == n


def test_hand_written_examples(spark, tmp_path):
    jsonl(tmp_path / "hand.jsonl", [{"context": "кыска", "answer": "жооп"}, {"context": "б" * 5000, "answer": "в"}])
    frame = read_prompt_answers(spark, str(tmp_path / "hand.jsonl"))
    texts = [r.text for r in summary_examples(frame, "context", "answer", bounds=None, eos="<e>").collect()]
    assert len(texts) == 2 and texts[0].endswith("Текст: кыска\nЖыйынтык: жооп<e>")
