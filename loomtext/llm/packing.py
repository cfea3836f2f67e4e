"""Token ids packed into fixed rows by best-fit decreasing (operator 2).

Texts become ids; documents longer than a row are split without loss; the pieces
of a block, longest first, go to the row with the least room that still holds
them, found in a segment tree over the rooms.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.token_counts import PRE_TOKEN


class RoomTree:
    """Rows by the room they have left: the leaves are rooms, an inner node
    tells whether a leaf below it has rows."""

    def __init__(self, context: int):
        self.width = 1 << context.bit_length()
        self.some = np.zeros(2 * self.width, dtype=bool).tolist()
        self.rows: list[list[int]] = [[] for _ in range(context + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.width
        while node and not self.some[node]:
            self.some[node] = True
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room of at least ``size``."""
        node = size + self.width
        if not self.some[node]:
            # Up until a right neighbour has rows, then down along its left side.
            while node > 1 and not (node % 2 == 0 and self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        room = node - self.width
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.some[node] = False
            while node > 1 and not self.some[node ^ 1]:
                node >>= 1
                self.some[node] = False
        return room, row


def pack(sizes: np.ndarray, context: int) -> list[list[int]]:
    """The pieces of every row; each size is from 1 to ``context``.  Pieces of
    one size keep their order."""
    rows: list[list[int]] = []
    tree = RoomTree(context)
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        found = tree.take(size)
        if found is None:
            room, row = context, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(piece)
        if room > size:
            tree.add(room - size, row)
    return rows


def load_encoder(path: str):
    """A byte-level rank file as an encoder of ordinary text."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    pattern = PRE_TOKEN.replace("++", "+")
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), len(ranks)


FIELDS = (
    ("doc_ids", pa.list_(pa.int64()), "array<bigint>"), ("starts", pa.list_(pa.int64()), "array<bigint>"),
    ("cu_seqlens", pa.list_(pa.int32()), "array<int>"), ("position_resets", pa.list_(pa.int32()), "array<int>"),
    ("n_tokens", pa.int32(), "int"), ("ids", pa.binary(), "binary"),
)


def pack_tokens(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", context: int = 2048, block_tokens: int = 1 << 22,
) -> DataFrame:
    """Rows of ``context`` ids, without a shuffle: (doc_ids, starts, cu_seqlens,
    position_resets, n_tokens, ids).

    Every document ends in the id after the last of the vocabulary.  ``ids`` is
    one row of the id matrix, little-endian, 2 bytes an id if the vocabulary
    allows and 4 if not, filled up with the end id.  Segment i holds the tokens
    of document ``doc_ids[i]`` from its token ``starts[i]`` on, and is
    ids[cu_seqlens[i]:cu_seqlens[i + 1]]; positions count from 0 again at
    ``position_resets``, the first id of every segment and of the filling.

    A document longer than ``context`` is cut into full rows and a rest; no id
    is lost.  A null or empty text has its end id alone, so each input row has a
    segment; a null id stays null.  Repeated rows are packed as often as they
    occur.  An empty table gives an empty result; other columns are not read.
    Documents are packed with others of their block, about ``block_tokens``
    tokens of one input partition, which bounds memory: which documents share a
    row depends on the partitions, the ids of a document do not.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = load_encoder(vocabulary)
        kind = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")
        block: list[tuple[int | None, int, np.ndarray]] = []
        held = 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(np.array(encoder.encode_ordinary(text.as_py() or ""), dtype=kind), kind.type(end))
                block += [(name, start, ids[start:start + context]) for start in range(0, ids.size, context)]
                held += ids.size
                if held >= block_tokens:
                    yield from _rows(block, context, end, kind)
                    block, held = [], 0
        yield from _rows(block, context, end, kind)

    source = docs.select(F.col(doc_id).cast("bigint"), F.col(text))
    return source.mapInArrow(packed, ", ".join(f"{name} {kind}" for name, _, kind in FIELDS))


def _rows(block: list[tuple[int | None, int, np.ndarray]], context: int, end: int, kind: np.dtype, per_batch: int = 512) -> Iterator[pa.RecordBatch]:
    if not block:
        return
    rows = pack(np.array([piece[2].size for piece in block]), context)
    for first in range(0, len(rows), per_batch):
        columns: list[list] = [[] for _ in FIELDS]
        for pieces in rows[first:first + per_batch]:
            names, starts, parts = zip(*[block[piece] for piece in pieces], strict=True)
            cuts = np.concatenate(([0], np.cumsum([part.size for part in parts]))).astype(np.int32)
            size = int(cuts[-1])
            filled = np.full(context, end, dtype=kind)
            filled[:size] = np.concatenate(parts)
            values = (names, starts, cuts, cuts if size < context else cuts[:-1], size, filled.tobytes())
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, (_, kind, _) in zip(columns, FIELDS, strict=True)], names=[name for name, _, _ in FIELDS]
        )


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the rows as Parquet with the ids as they are; tasks that are run
    again replace their own files."""
    packed.write.mode("overwrite").parquet(path)


def id_matrix(ids: list[bytes], context: int) -> np.ndarray:
    """Stored rows as one matrix of ids."""
    width = len(ids[0]) // context if ids else 2
    return np.frombuffer(b"".join(ids), dtype=f"<u{width}").reshape(len(ids), context)


def position_ids(position_resets: list[int], context: int) -> np.ndarray:
    """The position of every id of a row in its segment."""
    resets = np.asarray(position_resets)
    return np.arange(context) - resets[np.searchsorted(resets, np.arange(context), side="right") - 1]
