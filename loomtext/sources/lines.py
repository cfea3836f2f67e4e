"""Lines of text files with their places, for any cut of the files into tasks.

Spark's own text reader does not tell where in its file a line stands.  Here a
partition is a range of bytes: it reads the lines that begin in its range, so a
line's place, the offset of its first byte, depends on the file alone.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "lines_with_places"
COLUMNS = "file string, place bigint, line string"
BLOCK_BYTES = 4 << 20  # read at a time


def _line_source() -> type[DataSource]:
    # Classes made inside a function travel to the workers whole, which need no copy of this package.

    class Range(InputPartition):
        def __init__(self, name: str, path: str, uri: str, start: int, end: int | None):
            self.name, self.path, self.uri, self.start, self.end = name, path, uri, start, end

    def opened(uri: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri)

    def blocks(part: Range, size: int) -> Iterator[tuple[int, bytes]]:
        """(offset, whole lines) of the lines that begin in the range."""
        system, _ = opened(part.uri)
        if part.end is None:  # compressed: read from its start, counted in text bytes
            source = system.open_input_stream(part.path, compression="detect")
            at = 0
        else:
            source = system.open_input_file(part.path)
            at = max(part.start - 1, 0)
            source.seek(at)
        with source:
            rest, begin = b"", at
            skip = part.start > 0  # the line in which the range begins belongs to the one before
            while True:
                data = source.read(size)
                rest += data
                if skip and (cut := rest.find(b"\n")) >= 0:
                    begin, rest, skip = begin + cut + 1, rest[cut + 1:], False
                if skip:
                    begin, rest = begin + len(rest), b""
                    if begin >= part.end:
                        return
                elif part.end is not None and begin >= part.end:
                    return
                elif not data:
                    if rest:
                        yield begin, rest
                    return
                else:
                    # Up to the last line end, and no line that begins beyond the range.
                    upto = rest.rfind(b"\n") + 1
                    if part.end is not None and begin + upto >= part.end:
                        last = rest.find(b"\n", max(part.end - 1 - begin, 0))
                        upto = last + 1 if last >= 0 else 0
                        if upto:
                            yield begin, rest[:upto]
                            return
                    elif upto:
                        yield begin, rest[:upto]
                        begin, rest = begin + upto, rest[upto:]
                if not data:
                    return

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.uri, self.size = options["path"], int(options["rangebytes"])

        def partitions(self) -> list[InputPartition]:
            import fnmatch
            import posixpath

            from pyarrow import fs

            folder, pattern = self.uri, "*"
            if any(mark in posixpath.basename(self.uri) for mark in "*?["):
                folder, pattern = posixpath.split(self.uri)
            system, root = opened(folder)
            found = system.get_file_info(root)
            if found.type == fs.FileType.Directory:
                files = system.get_file_info(fs.FileSelector(root))
            elif found.type == fs.FileType.File:
                files = [found]
            else:
                raise FileNotFoundError(f"no such file or folder: {folder}")
            parts: list[InputPartition] = []
            for file in sorted(files, key=lambda f: f.path):
                name = file.base_name
                if file.type != fs.FileType.File or name.startswith(("_", ".")) or not fnmatch.fnmatchcase(name, pattern):
                    continue
                if name.endswith((".gz", ".bz2", ".zst", ".lz4")):
                    parts.append(Range(name, file.path, folder, 0, None))
                else:
                    parts += [Range(name, file.path, folder, at, min(at + self.size, file.size)) for at in range(0, file.size, self.size)]
            return parts or [Range("", "", folder, 0, 0)]

        def read(self, partition: InputPartition) -> Iterator:
            import numpy as np
            import pyarrow as pa

            if not partition.path:
                return
            for begin, data in blocks(partition, BLOCK):
                raw = np.frombuffer(data, dtype=np.uint8)
                ends = np.flatnonzero(raw == 10)
                if raw[-1] != 10:
                    ends = np.append(ends, raw.size)
                starts = np.concatenate(([0], ends[:-1] + 1))
                # Offsets of a string array must touch, so each line keeps its end mark, which JSON passes over.
                bounds = np.concatenate((starts, [min(ends[-1] + 1, raw.size)])).astype(np.int32)
                lines = pa.StringArray.from_buffers(starts.size, pa.py_buffer(bounds), pa.py_buffer(data))
                lines.validate(full=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.name] * starts.size, pa.string()), pa.array(starts + begin, pa.int64()), lines], names=["file", "place", "line"]
                )

    BLOCK = BLOCK_BYTES

    class Lines(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT_NAME

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    FORMAT_NAME, SCHEMA = FORMAT, COLUMNS
    return Lines


def read_lines(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(file, place, line) of all lines of a file, a folder or ``folder/pattern``.

    ``file`` is the name within the folder, ``place`` the offset of the line's
    first byte; a line keeps its end mark.  The rows are the same for any
    ``range_bytes``, by default ``spark.sql.files.maxPartitionBytes``.  Files
    are taken by name, those that begin with a dot or underscore left out;
    compressed ones are read in one task each, with places in the text.
    """
    spark.dataSource.register(_line_source())
    # A plain local path is made absolute, as Spark's own readers do.
    path = path if "://" in path else os.path.abspath(path.removeprefix("file:"))
    size = range_bytes or _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return spark.read.format(FORMAT).option("rangeBytes", str(size)).load(path)


def _bytes(setting: str) -> int:
    """Bytes of a Spark setting such as 128m or 134217728b."""
    number = setting.lower().rstrip("bkmgt")
    unit = setting.lower()[len(number):].rstrip("b") if len(setting) > len(number) else ""
    return int(number) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}[unit]
