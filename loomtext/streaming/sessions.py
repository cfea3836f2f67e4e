"""Sessions as they arrive: the direction and the stop are kept as state.

Needs the RocksDB state store (``SETTINGS`` below on the session).  State is
kept for good unless ``keep_seconds`` says how long after its last change.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomtext.defaults import CHAT_STOPS, COMMANDS, START_DIRECTION, TRANSLATOR_STOPS
from loomtext.functions import strip
from loomtext.sources.schemas import SESSION_LINE

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def read_line_stream(spark: SparkSession, path: str, bytes_per_batch: int = 1 << 30) -> DataFrame:
    """New session lines in a folder of JSON-line files.

    The lines one session adds in one batch are held together, so the bytes
    taken per batch also bound the memory of the busiest session.
    """
    return (
        spark.readStream.schema(SESSION_LINE).option("mode", "FAILFAST")
        .option("maxBytesPerTrigger", bytes_per_batch).json(path)
    )


def _stateful(lines: DataFrame, processor: StatefulProcessor, schema: str, keep_seconds: float | None) -> DataFrame:
    # A time to live needs processing time; without one no timer work is done.
    return lines.withColumn("line", strip(F.col("line"))).groupBy("session").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append",
        timeMode="None" if keep_seconds is None else "ProcessingTime",
    )


def stream_take_while(
    lines: DataFrame, stops: Sequence[str] = CHAT_STOPS, stop_at_blank: bool = True, ignore_case: bool = True,
    keep_seconds: float | None = None,
) -> DataFrame:
    """Streaming twin of ``take_while``: the lines (session, seq, line) of each
    session before its first stop line, stripped.

    Only stopped sessions have state, one boolean; after ``keep_seconds`` it goes
    and further lines of the name begin a new session.  Lines of one batch are
    taken by seq; between batches the order of arrival rules.
    """
    stop_lines, ttl = list(stops), None if keep_seconds is None else int(1000 * keep_seconds)

    class Chat(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.stopped = handle.getValueState("stopped", "stopped boolean", ttl)

        def handleInputRows(
            self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
        ) -> Iterator[pd.DataFrame]:
            if self.stopped.exists():
                return
            frames = list(rows)
            ends = []
            for frame in frames:
                line = frame["line"].str.lower() if ignore_case else frame["line"]
                stop = line.isin(stop_lines) | ((line == "") if stop_at_blank else False)
                ends += [frame.loc[stop, "seq"].min()] if stop.any() else []
            if ends:
                self.stopped.update((True,))
            for frame in frames:
                before = frame[frame["seq"] < min(ends)] if ends else frame
                if len(before):
                    yield before[["session", "seq", "line"]]

        def close(self) -> None:
            pass

    return _stateful(lines, Chat(), "session string, seq bigint, line string", keep_seconds)


def stream_requests(
    lines: DataFrame, stops: Sequence[str] = TRANSLATOR_STOPS, commands: Mapping[str, str] = COMMANDS,
    start: str = START_DIRECTION, keep_seconds: float | None = None,
) -> DataFrame:
    """Streaming twin of ``translator_requests``: (session, seq, line, direction).

    Lines of one batch are taken by seq; between batches the order of arrival
    rules.  A session that was silent for ``keep_seconds`` begins anew.
    """
    stop_lines, targets = list(stops), dict(commands)
    ttl = None if keep_seconds is None else int(1000 * keep_seconds)
    marked = [*stop_lines, *targets]

    class Session(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("session", "direction string, stopped boolean", ttl)

        def handleInputRows(
            self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
        ) -> Iterator[pd.DataFrame]:
            direction, stopped = self.state.get() if self.state.exists() else (start, False)
            if stopped:
                return
            frames = list(rows)
            # Only commands and stops are put in order; requests look theirs up.
            marks = pd.concat([f.loc[f["line"].isin(marked), ["seq", "line"]] for f in frames]).sort_values("seq")
            stops_at = marks.loc[marks["line"].isin(stop_lines), "seq"]
            end = stops_at.min() if len(stops_at) else None
            switches = marks[marks["line"].isin(targets) & (True if end is None else marks["seq"] < end)]
            in_force = np.array([direction, *switches["line"].map(targets)], dtype=object)
            self.state.update((in_force[-1], end is not None))
            for frame in frames:
                asked = frame[~frame["line"].isin(marked) & (frame["line"] != "")]
                if end is not None:
                    asked = asked[asked["seq"] < end]
                if len(asked):
                    place = np.searchsorted(switches["seq"].to_numpy(), asked["seq"].to_numpy())
                    yield asked.assign(direction=in_force[place])[["session", "seq", "line", "direction"]]

        def close(self) -> None:
            pass

    return _stateful(lines, Session(), "session string, seq bigint, line string, direction string", keep_seconds)
