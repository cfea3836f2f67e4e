"""A caller's text model applied to a column of prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[Sequence[str]], Sequence[str]]
# For each prompt the tokens of its output as they are made.
TokenModel = Callable[[Sequence[str]], Iterable[Iterable[str]]]


def apply_model(
    df: DataFrame, prompt: str, make_model: Callable[[], Model], out: str = "output", catch: bool = False,
    per_call: int = 64,
) -> DataFrame:
    """Add the model's answer to each prompt.

    ``make_model`` runs once in each task and returns a function from a list of
    prompts, at most ``per_call`` of them, to a list of answers.  Only the
    prompt column crosses to Python, in Arrow batches; the other columns stay
    where they are.  An empty or null prompt gives "" without a call.

    With ``catch``, the column is a struct (value, error): a failing call is
    repeated prompt by prompt, so a failure becomes the error of its own row.
    Without it a failure ends the job.
    """

    # The functions below use nothing but their arguments and pandas, so the
    # workers need no copy of this package.
    def call(model: Model, prompts: list[str]) -> list[str]:
        answers = list(model(prompts))
        if len(answers) != len(prompts):
            raise ValueError(f"model gave {len(answers)} answers to {len(prompts)} prompts")
        return answers

    def call_caught(model: Model, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            return [(answer, None) for answer in call(model, prompts)]
        except Exception as failure:
            if len(prompts) == 1:
                return [(None, str(failure) or type(failure).__name__)]
            return [result for text in prompts for result in call_caught(model, [text])]

    def asked(batch: pd.Series) -> tuple[pd.Series, list[list[str]]]:
        """Which rows have a prompt, and their prompts cut into calls."""
        mask = batch.notna() & (batch != "")
        prompts = batch[mask].tolist()
        return mask, [prompts[i:i + per_call] for i in range(0, len(prompts), per_call)]

    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for batch in batches:
            mask, calls = asked(batch)
            result = pd.Series("", index=batch.index, dtype=object)
            result[mask] = [answer for prompts in calls for answer in call(model, prompts)]
            yield result

    def answers_caught(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            mask, calls = asked(batch)
            results = iter([result for prompts in calls for result in call_caught(model, prompts)])
            rows = [next(results) if has_prompt else ("", None) for has_prompt in mask]
            yield pd.DataFrame(rows, columns=["value", "error"], index=batch.index, dtype=object)

    if catch:
        udf = F.pandas_udf(answers_caught, "value string, error string")
    else:
        udf = F.pandas_udf(answers, "string")
    return df.withColumn(out, udf(F.col(prompt)))


def apply_model_capped(
    df: DataFrame, prompt: str, make_model: Callable[[], TokenModel], max_tokens: int, out: str = "output",
    echoes: bool = False, per_call: int = 64,
) -> DataFrame:
    """Add a struct ``out`` (answer, cut, tokens, error): the first ``max_tokens``
    tokens of the model's output put together, whether it had more, and how many
    were taken.

    The model gives tokens as it makes them, and is asked for one more than the
    bound at most, so an output without an end ends there.  With ``echoes`` the
    output begins with the prompt, which is taken off and not counted; it is an
    error if it does not.  An empty or null prompt gives "" without a call.  A
    failure becomes the error of its own row, the others of its call are asked
    again; answer, cut and tokens are null there.
    """
    if max_tokens < 0:
        raise ValueError("max_tokens must not be negative")
    kind = "answer string, cut boolean, tokens int, error string"

    def taken(text: str, tokens: Iterable[str]) -> tuple[str, bool, int, None]:
        stream, first = iter(tokens), ""
        if echoes:
            while len(first) < len(text):
                piece = next(stream, None)
                if piece is None:
                    break
                first += piece
            if not first.startswith(text):
                raise ValueError("output does not begin with its prompt")
            first = first[len(text):]
        # What the echo's last token holds beyond the prompt is a token of the answer.
        parts, cut = [first] if first else [], False
        for piece in stream:
            if len(parts) == max_tokens:
                cut = True
                break
            parts.append(piece)
        return "".join(parts[:max_tokens]), cut or len(parts) > max_tokens, min(len(parts), max_tokens), None

    def call(model: TokenModel, prompts: list[str]) -> list[tuple]:
        try:
            outputs = iter(model(prompts))
            return [taken(text, next(outputs)) for text in prompts]
        except Exception as failure:
            if len(prompts) == 1:
                return [(None, None, None, str(failure) or type(failure).__name__)]
            return [result for text in prompts for result in call(model, [text])]

    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            mask = batch.notna() & (batch != "")
            prompts = batch[mask].tolist()
            results = iter([row for i in range(0, len(prompts), per_call) for row in call(model, prompts[i:i + per_call])])
            rows = [next(results) if has_prompt else ("", False, 0, None) for has_prompt in mask]
            frame = pd.DataFrame(rows, columns=["answer", "cut", "tokens", "error"], index=batch.index, dtype=object)
            yield frame.astype({"cut": "boolean", "tokens": "Int32"})

    return df.withColumn(out, F.pandas_udf(answers, kind)(F.col(prompt)))


def apply_model_once(
    df: DataFrame, prompt: str, make_model: Callable[[], Model], out: str = "output", per_call: int = 64,
) -> DataFrame:
    """As ``apply_model``, with one call for each different prompt.

    For models whose answer depends on the prompt alone.  Prompts are made
    distinct with partial sums before the exchange; the answers come back by a
    join whose hot prompts adaptive execution splits.
    """
    answers = apply_model(df.select(prompt).distinct(), prompt, make_model, out, per_call=per_call)
    asked = answers.select(F.col(prompt).alias("_asked"), out)
    return df.join(asked, F.col(prompt).eqNullSafe(F.col("_asked")), "left").drop("_asked")
