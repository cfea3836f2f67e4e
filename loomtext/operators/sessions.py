"""Command sessions: the current direction, and where a session stops.

Lines are rows (session, seq, line); seq orders the lines of a session.  A
session may hold a large share of all lines, so it is cut into blocks of seq.
Each block is reduced to two numbers (its last command and its first stop,
summed up before the shuffle), these are carried over the blocks of a session,
and lines are only ever sorted within one block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.defaults import BLOCK_ROWS, CHAT_STOPS, COMMANDS, START_DIRECTION, TRANSLATOR_STOPS
from loomtext.functions import present, strip

_BLOCK = ["session", "_blk"]


def _with_block(lines: DataFrame, block_rows: int) -> DataFrame:
    keyed = lines.withColumns({"session": present("session", "session"), "seq": present("seq", "seq")})
    return keyed.withColumns({"line": strip("line"), "_blk": F.expr(f"seq div {int(block_rows)}")})


def _is_stop(stops: Sequence[str], stop_at_blank: bool, ignore_case: bool) -> Column:
    line = F.lower("line") if ignore_case else F.col("line")
    stop = line.isin(list(stops))
    return stop | (F.col("line") == "") if stop_at_blank else stop


def _first_stop(stop: Column) -> Column:
    """Per block: sequence of its first stop line."""
    return F.min(F.when(stop, F.col("seq"))).alias("_stop")


def _session_stop() -> Column:
    """From the blocks: sequence of the session's first stop line."""
    return F.min("_stop").over(Window.partitionBy("session")).alias("_stop")


def _before_stop() -> Column:
    return F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))


def _code(commands: Mapping[str, str]) -> Column:
    """Sequence and command in one number, so the largest so far is the latest."""
    which = F.lit(None).cast("int")
    for place, name in enumerate(commands):
        which = F.when(F.col("line") == name, F.lit(place)).otherwise(which)
    return F.col("seq") * len(commands) + which


def _last_command(commands: Mapping[str, str]) -> Column:
    """Per block: its last command."""
    return F.max(_code(commands)).alias("_last")


def _carried_command() -> Column:
    """From the blocks: the last command of all earlier blocks of the session."""
    earlier = Window.partitionBy("session").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    return F.max("_last").over(earlier).alias("_last")


def _direct(lines: DataFrame, commands: Mapping[str, str], start: str) -> DataFrame:
    """Direction of each line from its own block and the carried command; then
    only requests stay."""
    earlier = Window.partitionBy(*_BLOCK).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.coalesce(F.max("_code").over(earlier), F.col("_last"))
    targets = F.array(*[F.lit(target) for target in commands.values()])
    direction = F.coalesce(F.get(targets, F.pmod(latest, F.lit(len(commands))).cast("int")), F.lit(start))
    return (
        lines.withColumn("_code", _code(commands))
        .withColumn("direction", direction)
        .where(F.col("_code").isNull() & (F.col("line") != ""))
        .drop("_blk", "_code", "_last")
    )


def take_while(
    lines: DataFrame, stops: Sequence[str] = CHAT_STOPS, stop_at_blank: bool = True,
    ignore_case: bool = True, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The lines of each session before its first stop line, stripped."""
    blocked = _with_block(lines, block_rows)
    per_block = blocked.groupBy(*_BLOCK).agg(_first_stop(_is_stop(stops, stop_at_blank, ignore_case)))
    blocks = per_block.select(*_BLOCK, _session_stop())
    return blocked.join(blocks, _BLOCK).where(_before_stop()).drop("_blk", "_stop")


def directions(
    lines: DataFrame, commands: Mapping[str, str] = COMMANDS, start: str = START_DIRECTION,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The requests of each session with the direction in force.

    Command lines set the direction for the lines after them and, like blank
    lines, do not come out.
    """
    blocked = _with_block(lines, block_rows)
    blocks = blocked.groupBy(*_BLOCK).agg(_last_command(commands)).select(*_BLOCK, _carried_command())
    return _direct(blocked.join(blocks, _BLOCK), commands, start)


def translator_requests(
    lines: DataFrame, stops: Sequence[str] = TRANSLATOR_STOPS, commands: Mapping[str, str] = COMMANDS,
    start: str = START_DIRECTION, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """What a translating session asks for: the lines before its first stop,
    without blank lines and commands, each with its direction."""
    blocked = _with_block(lines, block_rows)
    stop = _is_stop(stops, stop_at_blank=False, ignore_case=False)
    per_block = blocked.groupBy(*_BLOCK).agg(_first_stop(stop), _last_command(commands))
    blocks = per_block.select(*_BLOCK, _session_stop(), _carried_command())
    running = blocked.join(blocks, _BLOCK).where(_before_stop()).drop("_stop")
    return _direct(running, commands, start)
