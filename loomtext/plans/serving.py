"""Requests to responses.  ``serve_requests`` works on batch and streaming frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.defaults import TRANSLATE
from loomtext.functions import has_text, strip
from loomtext.operators.apply import Model, apply_model
from loomtext.operators.prompts import chat_prompt, translate_prompt
from loomtext.operators.sessions import take_while, translator_requests


def serve_requests(
    requests: DataFrame, make_model: Callable[[], Model], templates: Mapping[str, str] = TRANSLATE,
    drop_blank: bool = False, catch: bool = True,
) -> DataFrame:
    """Add ``value`` (stripped answer) and ``error`` to requests (direction, text).

    A blank request is answered "" without a call, or dropped.
    """
    if drop_blank:
        requests = requests.where(has_text("text"))
    prompted = requests.withColumn("_prompt", translate_prompt("direction", "text", templates))
    answered = apply_model(prompted, "_prompt", make_model, "_answer", catch)
    if catch:
        value, error = F.col("_answer.value"), F.col("_answer.error")
    else:
        value, error = F.col("_answer"), F.lit(None).cast("string")
    value = F.when(value.isNotNull(), strip(value))
    return answered.withColumns({"value": value, "error": error}).drop("_prompt", "_answer")


def serve_sessions(
    lines: DataFrame, make_model: Callable[[], Model], templates: Mapping[str, str] = TRANSLATE, catch: bool = True
) -> DataFrame:
    """Session lines (session, seq, line) to answered requests."""
    requests = translator_requests(lines).withColumnRenamed("line", "text")
    return serve_requests(requests, make_model, templates, catch=catch)


def serve_chat(
    lines: DataFrame, make_model: Callable[[], Model], raw: bool = True, catch: bool = False
) -> DataFrame:
    """Chat lines (session, seq, line) up to the stop of each session, answered.

    ``raw`` sends the line after the system line only; otherwise it goes into
    the summarising prompt.
    """
    prompted = take_while(lines).withColumn("_prompt", chat_prompt("line", raw))
    return apply_model(prompted, "_prompt", make_model, "answer", catch).drop("_prompt")
