import hashlib

import pytest
from pyspark.sql import functions as F

from loomtext.operators.apply import apply_model, apply_model_capped
from loomtext.operators.compare import pick_positions, run_arms, side_by_side
from loomtext.plans import compare_arms, serve_requests

PROMPTS = ["a", "b", "a", "", None, "bad", "я"]


def shouting():
    return lambda batch: [text.upper() for text in batch]


def picky():
    def answer(text):
        if "bad" in text:
            raise ValueError("cannot")
        return text.upper()

    return lambda batch: [answer(text) for text in batch]


def padded():
    return lambda batch: [f" {len(text)}\n" for text in batch]


def short():
    return lambda batch: ["x"]


def silent_failure():
    def fail(batch):
        raise RuntimeError

    return fail


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(list(enumerate(PROMPTS)), "id int, p string")


def test_apply(frame):
    rows = apply_model(frame.repartition(16), "p", shouting).orderBy("id").collect()
    assert [(r.id, r.p, r.output) for r in rows] == [(i, p, (p or "").upper()) for i, p in enumerate(PROMPTS)]


def endless():
    import itertools

    def tokens(text):
        if text == "bad":
            raise ValueError("cannot")
        yield from text[:1]
        yield from text[1:] + "|"
        yield from itertools.repeat("x") if text != "b" else ["y", "z"]

    return lambda batch: [tokens(text) for text in batch]


@pytest.mark.parametrize("cap", [0, 1, 2, 5])
@pytest.mark.parametrize("per_call", [1, 3, 64])
def test_capped_answers(frame, cap, per_call):
    rows = apply_model_capped(frame.repartition(3), "p", endless, cap, echoes=True, per_call=per_call).orderBy("id").collect()
    for row in rows:
        if not row.p:
            assert tuple(row.output) == ("", False, 0, None)
        elif row.p == "bad":
            assert tuple(row.output) == (None, None, None, "cannot")
        else:
            whole = "|yz" if row.p == "b" else "|" + "x" * 50
            assert tuple(row.output) == (whole[:cap], len(whole) > cap, min(cap, len(whole)), None)


def pieces():
    return lambda batch: [["a", "nswer", " of ", text] for text in batch]


def test_the_echo_may_share_a_token_with_the_answer(spark):
    frame = spark.createDataFrame([("ans",), ("answer",), ("other",), ("answer of answer of ans and more",)], "p string")
    got = {r.p: tuple(r.output) for r in apply_model_capped(frame, "p", pieces, 2, echoes=True).collect()}
    assert got["ans"] == ("wer of ", True, 2, None) and got["answer"] == (" of answer", False, 2, None)
    assert got["other"][3] and got["answer of answer of ans and more"][3]
    got = {r.p: tuple(r.output) for r in apply_model_capped(frame, "p", pieces, 9).collect()}
    assert got["ans"] == ("answer of ans", False, 4, None)


def test_failure_ends_the_job(frame):
    with pytest.raises(Exception, match="cannot"):
        apply_model(frame, "p", picky).collect()


def test_failure_as_value(frame):
    rows = apply_model(frame.coalesce(1), "p", picky, catch=True).orderBy("id").collect()
    for row in rows:
        bad = row.p == "bad"
        assert (row.output.value, row.output.error) == ((None, "cannot") if bad else ((row.p or "").upper(), None))
    named = apply_model(frame.where("id = 0"), "p", silent_failure, catch=True).first()
    assert named.output.error == "RuntimeError"


def test_wrong_answer_count_fails(spark):
    many = spark.range(10).select(F.lit("q").alias("p")).coalesce(1)
    with pytest.raises(Exception, match="answers to"):
        apply_model(many, "p", short).collect()


def test_model_is_made_once_per_task(spark, tmp_path):
    made = str(tmp_path)

    def counting():
        import tempfile

        tempfile.mkstemp(dir=made)
        return lambda batch: list(batch)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        out = apply_model(spark.range(0, 1000, 1, 3).select(F.col("id").cast("string").alias("p")), "p", counting)
        assert out.where("p = output").count() == 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(list(tmp_path.iterdir())) == 3


def test_prompts_per_call(spark):
    def sizes():
        return lambda batch: [str(len(batch))] * len(batch)

    frame = spark.range(0, 25, 1, 1).select(F.lit("q").alias("p"))
    counts = apply_model(frame, "p", sizes, per_call=10).groupBy("output").count().collect()
    assert {r.output: r["count"] for r in counts} == {"10": 20, "5": 5}


@pytest.mark.parametrize("catch", [True, False])
def test_serve_requests(spark, catch):
    rows = [(1, "ky2ru", " салам "), (2, "ru2ky", "  "), (3, "ru2ky", None), (4, "ru2ky", "x")]
    requests = spark.createDataFrame(rows, "id bigint, direction string, text string")
    answers = serve_requests(requests, padded, catch=catch).orderBy("id").collect()
    assert answers[0].value == answers[0].value.strip() != "" and answers[0].error is None
    assert [r.value for r in answers[1:3]] == ["", ""]
    assert serve_requests(requests, padded, drop_blank=True, catch=catch).count() == 2


def test_serve_requests_keeps_failed_rows(spark):
    requests = spark.createDataFrame([(1, "ky2ru", "bad"), (2, "ky2ru", "ok")], "id bigint, direction string, text string")
    one, two = serve_requests(requests, picky).orderBy("id").collect()
    assert (one.value, one.error) == (None, "cannot") and two.error is None and two.value


def test_positions(spark):
    frame = spark.createDataFrame([(i, "x" * (300 if i % 2 else 10)) for i in range(40)], "id bigint, text string")
    assert [(r.id, r.pos) for r in pick_positions(frame, ["id"], [2], 5).collect()] == [(5, 2)]
    assert sorted((r.id, r.pos) for r in pick_positions(frame, ["id"], None, 3).collect()) == [(1, 0), (3, 1), (5, 2)]
    assert pick_positions(frame, ["id"], [7], 5).count() == 0
    assert pick_positions(frame, ["id"], [], 5).count() == 0


def test_arms(spark):
    frame = spark.createDataFrame([(i, f"{i}" * 300) for i in range(10)], "id bigint, text string")
    arms = {"a": (F.concat(F.lit("1"), "text"), shouting), "b": (F.col("text"), padded)}
    rows = compare_arms(frame, ["id"], 8, [5, 6, 7], arms, prompts=True).orderBy("id").collect()
    assert [(r.id, r.prompt_a, r.out_a, r.out_b) for r in rows] == [
        (i, "1" + f"{i}" * 300, "1" + f"{i}" * 300, " 300\n") for i in (5, 6, 7)
    ]
    plan = run_arms(frame, arms)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_side_by_side(spark):
    rows = [(1, "a", "x"), (1, "b", "y"), (2, "a", "z"), (3, "c", "w")]
    stored = spark.createDataFrame(rows, "id int, arm string, output string")
    assert [tuple(r) for r in side_by_side(stored, "id", ["a", "b"]).collect()] == [(1, "x", "y")]


def test_catalog_models_travel_by_value():
    """Workers may not have the catalogue on their path."""
    import pickletools

    from pyspark import cloudpickle

    from catalog.models import digest_model

    ops = [(op.name, arg) for op, arg, _ in pickletools.genops(cloudpickle.dumps(digest_model))]
    strings = [arg for name, arg in ops if "UNICODE" in name]
    # By value: the code object itself is in the stream.
    assert "CodeType" in strings or "code" in strings
    assert digest_model()(["a"]) == [hashlib.md5(b"a").hexdigest()]
