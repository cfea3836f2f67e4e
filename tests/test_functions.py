"""Column functions against Python's own."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loomtext.defaults import WHITESPACE
from loomtext.functions import digest_modulo, fill, has_text, number_once, put_number, required, shuffle_rank, strip


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_whitespace_is_what_python_strips():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert sorted(WHITESPACE) == sorted(c for c in every if not c.strip())


def test_strip_and_has_text_on_the_whole_plane(spark):
    values = [f"{chr(c)} а {chr(c)}б{chr(c)}" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    assert column(spark, values, strip) == [v.strip() for v in values]
    singles = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    assert column(spark, singles, has_text) == [bool(v.strip()) for v in singles]


def test_strip_null_and_blank(spark):
    assert column(spark, [None, "", " \t ", " x "], strip) == ["", "", "", "x"]


@pytest.mark.parametrize("modulus", [1, 2, 7, 20, 1000, 10**8, 2**31 - 1])
def test_digest_modulo(spark, modulus):
    keys = [f"{law}:{i}" for law in ("ТК", "c0", "") for i in range(100)]
    wanted = [int(hashlib.sha256(k.encode()).hexdigest(), 16) % modulus for k in keys]
    assert column(spark, keys, lambda c: digest_modulo(c, modulus)) == wanted


def test_shuffle_rank(spark):
    got = column(spark, ["a", "ы"], lambda c: shuffle_rank(42, c))
    assert got == [int(hashlib.md5(f"42:{v}".encode()).hexdigest()[:15], 16) for v in ("a", "ы")]


def test_fill_leaves_text_alone(spark):
    texts = ["{text}", "{}", "$1", "a\\b\nc"]
    assert column(spark, texts, lambda c: fill("<{text}|{text}>", c)) == [f"<{t}|{t}>" for t in texts]


NUMBER_TEXTS = ["20", "120", "201", "20 20", "a20b", "٢20", "20٢", "20,20", "x 20.", "2 0", "020"]


def test_numbers(spark):
    pattern = r"(?<!\d)20(?!\d)"
    once = column(spark, NUMBER_TEXTS, lambda c: number_once(c, F.lit("20")))
    assert once == [len(re.findall(pattern, t)) == 1 for t in NUMBER_TEXTS]
    put = column(spark, NUMBER_TEXTS, lambda c: put_number(c, F.lit("20"), F.lit("$1\\w")))
    assert put == [re.sub(pattern, lambda _: "$1\\w", t) for t in NUMBER_TEXTS]


def test_required_fails_on_null(spark):
    assert column(spark, ["a"], lambda c: required(c, "v")) == ["a"]
    with pytest.raises(Exception, match="null in required column v"):
        column(spark, ["a", None], lambda c: required(c, "v"))
