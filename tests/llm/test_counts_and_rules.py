"""Token counts (10) and quality rules (6) against plain Python."""

import random

import pytest
import public_tokenizers
from helpers import clashing, empty, odd, words

from loomtext.llm.quality import LineRules, apply_line_rules, judge, repeated_words
from loomtext.llm.token_counts import ArrayMerger, count_texts, count_tokens
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_counts_equal_the_library_on_random_strings(library):
    rng = random.Random(3)
    parts = [*"aab  \n\t\r'RE12٣é日本🙂\x1c\x85 ​.,!", "<|endoftext|>", "<|endof", "'s", "'ll", "aaaaaaa", "\x00", "ſ", "²", "Ⅷ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000)]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert count_texts(ArrayMerger(VOCABULARY), texts, {}, 500, 50) == expected


def test_counts_of_odd_documents(spark, library):
    rows = count_tokens(clashing(odd(spark)), VOCABULARY).collect()
    assert len(rows) == 14
    for row in rows:
        text = row.text or ""
        assert row.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert row.n_bytes == len(text.encode()) and row.over_limit == (row.n_tokens > 1024)
    assert count_tokens(empty(spark), VOCABULARY).count() == 0


def _repeat_words(w):
    windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    return len({k + s for k, x in enumerate(windows) if windows.count(x) > 1 for s in range(3)})


def test_base_counts():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "c\n", "# ", "\n", "a b c\n", "x y "]) for _ in range(rng.randrange(80)))
        got = judge(text, LineRules())
        w = words(text)
        lines = [line for line in text.split("\n") if words(line)]
        assert got[:6] == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), _repeat_words(w),
            len(w) < 50 or 100 * _repeat_words(w) > 50 * len(w),
        )
        assert repeated_words(w) == _repeat_words(w)


def test_lines_fail_by_rule_and_documents_by_loss(spark):
    prose = "\n".join(" ".join(f"{chr(97 + i)}{chr(97 + j)}{k}" for k in range(10)) + "." for i in range(3) for j in range(3))
    kept = judge(prose + "\nHome | News | About\nAll rights reserved.\nno stop here", LineRules())
    assert kept[6] and kept[8:11] == (1, 1, 1) and kept[12] == prose
    lost = judge(prose + "\n" + "\n".join(f"menu{i} | entry{i} | other{i}" for i in range(200)), LineRules())
    assert not lost[5] and not lost[6]
    rows = apply_line_rules(clashing(odd(spark))).select("doc_id", "text", "quality.*").collect()
    assert len(rows) == 14 and all(not r.kept for r in rows if not r.text)
    assert apply_line_rules(empty(spark)).count() == 0


def test_a_line_may_end_in_any_number_of_closing_marks():
    rules = LineRules()
    for marks in ("", '"', "’”»)]" * 40, '"' * 9 + "  "):
        assert rules.failure(f"this is a line.{marks}", 4) is None and rules.failure(f"this is a line{marks}", 4) == "punctuation"


def test_bad_labels_are_mostly_rejected(spark, small):
    docs = apply_line_rules(spark.read.parquet(f"{small}/documents.parquet"))
    labelled = docs.join(spark.read.parquet(f"{small}/labels.parquet").where("quality = 0").select("doc_id"), "doc_id")
    n, rejected = labelled.agg(F.count("*"), F.count_if(F.expr("NOT quality.kept"))).first()
    assert n > 20 and rejected > 0.8 * n


def test_good_labels_are_kept(spark, small):
    docs = apply_line_rules(spark.read.parquet(f"{small}/documents.parquet")).where(~F.col("quality.base_failed"))
    labelled = docs.join(spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").select("doc_id"), "doc_id")
    assert labelled.where("NOT quality.kept").count() == 0
