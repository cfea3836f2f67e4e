"""Sessions in batch, and the same as a stream."""

import json
import os
import random
import time

import pytest

from loomtext.defaults import COMMANDS
from loomtext.operators.sessions import directions, take_while, translator_requests
from loomtext.plans import serve_requests, serve_sessions
from loomtext.streaming import read_line_stream, read_request_stream, start_stream, stream_requests, stream_take_while

EDGES = {
    "before any command": ["один", ":ky", "два"],
    "command last": ["один", ":ru"],
    "two commands": [":ky", ":ru", "один", ":ru", ":ky", "два"],
    "stop first": [":q", "один"],
    "spaces": ["  :ky  ", " один\t", "", "   ", "два", " :q ", "три"],
    "case": [":KY", "Exit", "один", ":Q"],
    "only blank": ["", " "],
}


def random_sessions(seed):
    rng = random.Random(seed)
    pool = [":ky", ":ru", "сөз", "", " слово ", "exit"]
    sessions = {f"s{i}": rng.choices(pool, k=rng.randrange(1, 12)) for i in range(30)}
    # One session holds more lines than all others together.
    sessions["hot"] = rng.choices(["сөз", "слово", "", ":ky", ":ru"], weights=[9, 9, 2, 1, 1], k=400)
    sessions["hot, stopped"] = ["а"] * 100 + [":q"] + ["б"] * 100
    return sessions


def rows_of(sessions):
    return [(name, seq, line) for name, lines in sessions.items() for seq, line in enumerate(lines)]


def frame_of(spark, sessions, partitions=5):
    rows = rows_of(sessions)
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "session string, seq bigint, line string").repartition(partitions)


def loop(lines, stops=(), start="ky2ru"):
    """The translator loop over one session."""
    direction = start
    for seq, line in enumerate(lines):
        line = line.strip()
        if line in stops:
            return
        if line in COMMANDS:
            direction = COMMANDS[line]
        elif line:
            yield seq, line, direction


SETS = pytest.mark.parametrize("sessions", [EDGES, random_sessions(1), random_sessions(2)], ids=["edges", "r1", "r2"])


@SETS
@pytest.mark.parametrize("block_rows", [1, 7, 1 << 16])
def test_directions(spark, sessions, block_rows):
    frame = frame_of(spark, sessions)
    got = directions(frame, block_rows=block_rows).select("session", "seq", "line", "direction").collect()
    assert sorted(map(tuple, got)) == sorted((s, *r) for s, lines in sessions.items() for r in loop(lines))
    got = translator_requests(frame, block_rows=block_rows).select("session", "seq", "line", "direction").collect()
    assert sorted(map(tuple, got)) == sorted((s, *r) for s, lines in sessions.items() for r in loop(lines, (":q",)))


@SETS
@pytest.mark.parametrize("block_rows", [1, 7, 1 << 16])
def test_take_while(spark, sessions, block_rows):
    wanted = []
    for name, lines in sessions.items():
        for seq, line in enumerate(map(str.strip, lines)):
            if not line or line.lower() in ("exit", "quit"):
                break
            wanted.append((name, seq, line))
    got = take_while(frame_of(spark, sessions), block_rows=block_rows).select("session", "seq", "line").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_other_commands(spark):
    sessions = {"a": ["x", "!1", "x", "!2", "x", "!3", "x"]}
    commands = {"!1": "one", "!2": "two", "!3": "three"}
    got = directions(frame_of(spark, sessions), commands, "zero").orderBy("seq").collect()
    assert [r.direction for r in got] == ["zero", "one", "two", "three"]


def shouting():
    return lambda batch: [text.upper() for text in batch]


def test_serve_sessions(spark):
    rows = serve_sessions(frame_of(spark, EDGES), shouting).collect()
    assert len(rows) == sum(1 for lines in EDGES.values() for _ in loop(lines, (":q",)))
    assert all(r.text.upper() in r.value and r.error is None for r in rows)


def write_lines(folder, batches):
    folder.mkdir()
    for i, batch in enumerate(batches):
        text = "".join(json.dumps(row, ensure_ascii=False) + "\n" for row in batch)
        (folder / f"{i:03}.json").write_text(text, encoding="utf-8")


@SETS
@pytest.mark.parametrize("files,bytes_per_batch", [(1, 1 << 30), (5, 1)], ids=["one batch", "many batches"])
def test_stream_equals_batch(spark, tmp_path, sessions, files, bytes_per_batch):
    rows = rows_of(sessions)
    rows.sort(key=lambda r: r[1])  # between files, lines arrive in order
    size = -(-len(rows) // files)
    cut = [rows[i:i + size] for i in range(0, len(rows), size)]
    random.Random(0).shuffle(cut[0])  # within a batch they need not


    write_lines(tmp_path / "in", [[dict(zip(("session", "seq", "line"), r)) for r in batch] for batch in cut])
    for i, path in enumerate(sorted((tmp_path / "in").iterdir())):
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    lines = read_line_stream(spark, str(tmp_path / "in"), bytes_per_batch)
    query = start_stream(stream_requests(lines), str(tmp_path / "out"), "sessions", str(tmp_path / "cp"), once=True)
    assert query.awaitTermination(300) and query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).select("session", "seq", "line", "direction").collect()
    assert sorted(map(tuple, got)) == sorted((s, *r) for s, lines in sessions.items() for r in loop(lines, (":q",)))


@SETS
@pytest.mark.parametrize("files,bytes_per_batch", [(1, 1 << 30), (4, 1)], ids=["one batch", "many batches"])
def test_chat_stream_equals_batch(spark, tmp_path, sessions, files, bytes_per_batch):
    rows = sorted(rows_of(sessions), key=lambda r: r[1])
    size = -(-len(rows) // files)
    cut = [rows[i:i + size] for i in range(0, len(rows), size)]
    random.Random(0).shuffle(cut[0])
    write_lines(tmp_path / "in", [[dict(zip(("session", "seq", "line"), r)) for r in batch] for batch in cut])
    for i, path in enumerate(sorted((tmp_path / "in").iterdir())):
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    taken = stream_take_while(read_line_stream(spark, str(tmp_path / "in"), bytes_per_batch), keep_seconds=3600)
    query = start_stream(taken, str(tmp_path / "out"), "chat", str(tmp_path / "cp"), once=True)
    assert query.awaitTermination(300) and query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).select("session", "seq", "line").collect()
    wanted = take_while(frame_of(spark, sessions)).select("session", "seq", "line").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted)) and wanted


def test_stopped_chats_are_forgotten_in_time(spark, tmp_path):
    def run(name, rows, keep):
        text = "".join(json.dumps(dict(zip(("session", "seq", "line"), r))) + "\n" for r in rows)
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text, encoding="utf-8")
        taken = stream_take_while(read_line_stream(spark, str(tmp_path / "in")), keep_seconds=keep)
        query = start_stream(taken, str(tmp_path / "out"), "chat", str(tmp_path / "cp"), once=True)
        assert query.awaitTermination(300) and query.exception() is None
        got = spark.read.parquet(str(tmp_path / "out")).select("session", "seq").collect()
        return sorted(map(tuple, got)), query.lastProgress["stateOperators"][0]["numRowsTotal"]

    first = [("a", 0, "x"), ("a", 1, "exit"), ("b", 0, "y")]
    assert run("1.json", first, 20.0) == ([("a", 0), ("b", 0)], 1)  # b goes on: no state
    assert run("2.json", [("a", 2, "still out"), ("b", 1, "z")], 20.0) == ([("a", 0), ("b", 0), ("b", 1)], 1)
    time.sleep(21)
    seen, state = run("3.json", [("a", 3, "again"), ("b", 2, "z")], 20.0)
    assert seen == [("a", 0), ("a", 3), ("b", 0), ("b", 1), ("b", 2)] and state == 0


def test_request_stream_equals_batch(spark, tmp_path):
    rows = [{"id": i, "direction": ("ky2ru", "ru2ky")[i % 2], "text": [f" сөз {i}", " ", None][i % 3]} for i in range(60)]
    write_lines(tmp_path / "in", [rows[:20], rows[20:40]])

    def run():
        stream = serve_requests(read_request_stream(spark, str(tmp_path / "in"), 1), shouting)
        query = start_stream(stream, str(tmp_path / "out"), "requests", once=True)
        assert query.awaitTermination(300) and query.exception() is None

    run()
    text = "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows[40:])
    (tmp_path / "in" / "later.json").write_text(text, encoding="utf-8")
    run()  # goes on after the files already answered

    batch = spark.createDataFrame(rows, "id bigint, direction string, text string")
    columns = ["id", "direction", "text", "value", "error"]
    wanted = serve_requests(batch, shouting).select(columns).orderBy("id").collect()
    assert spark.read.parquet(str(tmp_path / "out")).select(columns).orderBy("id").collect() == wanted
