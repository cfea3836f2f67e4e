import pytest
from pyspark.sql import functions as F

from loomtext import defaults as d
from loomtext.operators import prompts as p
from loomtext.plans import summary_examples, translation_texts

# Text that must pass through every template unchanged.
TRICKY = "a {text} {} $1 \\ \n 'b'"


def one(spark, expression, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(expression.alias("x")).first()
    return row.x


def test_summary(spark):
    prompt = f"{d.SYSTEM}\n\nТапшырма: {d.TASK_SUMMARY}\nТекст: {TRICKY}\nЖыйынтык:"
    assert one(spark, p.summary_prompt("t"), t=TRICKY) == prompt
    assert one(spark, p.summary_example("t", "s", "<e>"), t=TRICKY, s=" ж") == f"{prompt}  ж<e>"
    assert one(spark, p.corrupt_prompt("t"), t=TRICKY) == prompt.replace(d.TASK_SUMMARY, d.TASK_CORRUPT)


def test_shots(spark):
    assert one(spark, p.zero_shot_prompt("t"), t=TRICKY) == f"{d.SYSTEM} {d.TASK_SUMMARY_2_3}\n\n{TRICKY}"
    colon = p.zero_shot_prompt("t", task=d.TASK_SUMMARY_2_3.rstrip("."), before_text=":\n\n")
    assert one(spark, colon, t="x") == f"{d.SYSTEM} {d.TASK_SUMMARY_2_3[:-1]}:\n\nx"
    shots = [("c1 {text}", "a1"), ("c2", "a2")]
    task = f"Тапшырма: {d.TASK_SUMMARY_2_3}\nТекст: "
    worked = "".join(f"{task}{c}\nЖыйынтык: {a}\n\n" for c, a in shots)
    assert one(spark, p.few_shot_prompt("t", shots), t=TRICKY) == f"{d.SYSTEM}\n\n{worked}{task}{TRICKY}\nЖыйынтык:"


def test_chat(spark):
    assert one(spark, p.chat_prompt("t", True), t=TRICKY) == f"{d.SYSTEM}\n\n{TRICKY}"
    assert one(spark, p.chat_prompt("t", F.col("t") == "-"), t=TRICKY) == one(spark, p.summary_prompt("t"), t=TRICKY)


@pytest.mark.parametrize("text,kept", [(None, ""), ("", ""), (" \n\xa0", ""), (f"\t{TRICKY} ", TRICKY)])
@pytest.mark.parametrize("direction", ["ky2ru", "ru2ky"])
def test_translate(spark, direction, text, kept):
    wanted = d.TRANSLATE[direction].replace("{text}", kept, 1) if kept else ""
    frame = spark.createDataFrame([(direction, text)], "direction string, text string")
    assert frame.select(p.translate_prompt("direction", "text")).first()[0] == wanted


@pytest.mark.parametrize("direction", ["en2ru", None])
def test_unknown_direction_fails(spark, direction):
    frame = spark.createDataFrame([(direction, "x")], "direction string, text string")
    with pytest.raises(Exception, match="unknown direction"):
        frame.select(p.translate_prompt("direction", "text")).collect()


def test_translation_examples(spark):
    pairs = spark.createDataFrame([(1, " р ", " к ")], "id int, ru string, ky string")
    rows = {r.direction: r.text for r in p.translation_examples(pairs, "<e>").collect()}
    assert rows == {
        "ky2ru": d.TO_RUSSIAN.replace("{text}", " к ") + "  р <e>",
        "ru2ky": d.TO_KYRGYZ.replace("{text}", " р ") + "  к <e>",
    }
    assert translation_texts(pairs).columns == ["text"] and translation_texts(pairs).count() == 2


def test_summary_examples(spark):
    sizes = [(299, 30), (300, 29), (300, 30), (2000, 300), (2001, 300), (2000, 301)]
    frame = spark.createDataFrame([("т" * a, "с" * b) for a, b in sizes], "text string, summary string")
    kept = {r.text for r in summary_examples(frame).collect()}
    assert len(kept) == 2 and all("т" * 300 in t for t in kept)
    assert summary_examples(frame, bounds=None).count() == len(sizes)
