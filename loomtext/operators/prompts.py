"""Prompt and training-example formats as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.defaults import (
    ANSWER_LINE,
    EOS,
    SYSTEM,
    TASK_CORRUPT,
    TASK_LINE,
    TASK_SUMMARY,
    TASK_SUMMARY_2_3,
    TEXT_LINE,
    TRANSLATE,
)
from loomtext.functions import fill, strip


def _task(task: str) -> str:
    return f"{TASK_LINE}{task}\n{TEXT_LINE}{{text}}\n{ANSWER_LINE}"


def summary_prompt(text: Column | str, task: str = TASK_SUMMARY, system: str = SYSTEM) -> Column:
    """System line, task, text and the cue where the answer starts."""
    return F.concat(F.lit(system + "\n\n"), fill(_task(task), text))


def summary_example(
    text: Column | str, summary: Column | str, eos: str = EOS, task: str = TASK_SUMMARY, system: str = SYSTEM
) -> Column:
    """The prompt followed by its answer and the end marker."""
    answer = F.col(summary) if isinstance(summary, str) else summary
    return F.concat(summary_prompt(text, task, system), F.lit(" "), answer, F.lit(eos))


def corrupt_prompt(text: Column | str, task: str = TASK_CORRUPT, system: str = SYSTEM) -> Column:
    """Summary prompt that asks for exactly one wrong fact."""
    return summary_prompt(text, task, system)


def zero_shot_prompt(
    text: Column | str, task: str = TASK_SUMMARY_2_3, system: str = SYSTEM, before_text: str = "\n\n"
) -> Column:
    """Instruction, then the text, without a cue."""
    return fill(f"{system} {task}{before_text}{{text}}", text)


def few_shot_prompt(
    text: Column | str, shots: Sequence[tuple[str, str]], task: str = TASK_SUMMARY_2_3, system: str = SYSTEM
) -> Column:
    """Worked examples (text, answer) ahead of the text to work on."""
    head, tail = _task(task).split("{text}")
    worked = "".join(f"{head}{context}{tail} {answer}\n\n" for context, answer in shots)
    return F.concat(F.lit(f"{system}\n\n{worked}"), fill(_task(task), text))


def raw_prompt(text: Column | str, system: str = SYSTEM) -> Column:
    """System line and message, no task format."""
    return fill(system + "\n\n{text}", text)


def chat_prompt(message: Column | str, raw: Column | bool, system: str = SYSTEM) -> Column:
    """Raw mode or the summarising format, row by row if ``raw`` is a column."""
    raw = F.lit(raw) if isinstance(raw, bool) else raw
    return F.when(raw, raw_prompt(message, system)).otherwise(summary_prompt(message, system=system))


def translate_prompt(
    direction: Column | str, text: Column | str, templates: Mapping[str, str] = TRANSLATE
) -> Column:
    """Translation prompt of the row's direction, text stripped.

    Null or blank text gives "".  An unknown direction fails the job.
    """
    direction = F.col(direction) if isinstance(direction, str) else direction
    stripped = strip(text)
    choice = F.when(stripped == "", F.lit(""))
    for name, template in templates.items():
        choice = choice.when(direction == name, fill(template, stripped))
    unknown = F.concat(F.lit("unknown direction: "), F.coalesce(direction, F.lit("null")))
    return choice.otherwise(F.raise_error(unknown).cast("string"))


def translation_examples(pairs: DataFrame, eos: str = EOS, templates: Mapping[str, str] = TRANSLATE) -> DataFrame:
    """Two training texts for each pair: Kyrgyz to Russian, and back.

    Both come from one read of the pairs.  Texts are not stripped here.
    """
    def example(direction: str, source: str, target: str) -> Column:
        text = F.concat(fill(templates[direction], source), F.lit(" "), F.col(target), F.lit(eos))
        return F.struct(F.lit(direction).alias("direction"), text.alias("text"))

    kept = [c for c in pairs.columns if c not in ("ru", "ky")]
    both = F.array(example("ky2ru", "ky", "ru"), example("ru2ky", "ru", "ky"))
    return pairs.select(*kept, F.inline(both))
