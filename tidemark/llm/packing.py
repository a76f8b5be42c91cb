"""Token-id packing and binary output (operator 2).

Documents are tokenised; those longer than a row are split, losslessly, into full rows
and a rest.  Each task packs what it holds, ``GROUP_TOKENS`` at a time, best fit
decreasing: pieces from long to short, each into the open row of the least room
that holds it, found by a segment tree over room sizes.  No shuffle: packing quality
depends on the group, not on the table, so every task works on its own.

A row of the result is a packed row: ``ids`` and ``position_ids`` (binary, little-endian
unsigned 16-bit, ``length`` values, padded), ``cu_seqlens`` (cumulative segment lengths
from 0) and, for each segment, ``doc_ids``, ``parts`` (number of the piece in its
document) and ``offsets`` (its first token there).  Positions restart at each segment.

Defined results: a null or empty text has no tokens and is in no row; repeated rows are packed
each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import workers_import

LENGTH, GROUP_TOKENS = 2048, 1 << 20


class RoomTree:
    """Which sizes 0..n of room some open row has; finds the least one of at least a given size."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.some = [False] * (2 * self.size)

    def set(self, room: int, some: bool) -> None:
        i = room + self.size
        self.some[i] = some
        while i > 1:
            i //= 2
            both = self.some[2 * i] or self.some[2 * i + 1]
            if self.some[i] == both:
                break
            self.some[i] = both

    def least(self, room: int) -> int | None:
        i = room + self.size
        if self.some[i]:
            return room
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.size:
            i = 2 * i if self.some[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(sizes: Sequence[int], length: int) -> list[list[int]]:
    """Rows of piece numbers, each of at most ``length`` in all; sizes are 1..length."""
    order = np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable")
    tree, waiting, rows = RoomTree(length), [[] for _ in range(length + 1)], []
    for piece in order.tolist():
        size = sizes[piece]
        room = tree.least(size)
        if room is None:
            row, room = len(rows), length
            rows.append([])
        else:
            row = waiting[room].pop()
            if not waiting[room]:
                tree.set(room, False)
        rows[row].append(piece)
        left = room - size
        if left:
            waiting[left].append(row)
            if len(waiting[left]) == 1:
                tree.set(left, True)
    return rows


def split(n_tokens: int, length: int) -> list[tuple[int, int]]:
    """(offset, size) of the pieces of a document."""
    return [(at, min(length, n_tokens - at)) for at in range(0, n_tokens, length)]


SCHEMA = T.StructType([
    T.StructField("pack_id", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("parts", T.ArrayType(T.IntegerType())),
    T.StructField("offsets", T.ArrayType(T.LongType())),
    T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
    T.StructField("ids", T.BinaryType()),
    T.StructField("position_ids", T.BinaryType()),
])


def pack_group(doc_ids: list[int | None], tokens: list[np.ndarray], length: int, pad: int) -> dict[str, list]:
    """The packed rows of some documents' tokens, as columns (without pack_id)."""
    pieces = [(doc, part, at, size) for doc, ids in enumerate(tokens) for part, (at, size) in enumerate(split(len(ids), length))]
    out: dict[str, list] = {name: [] for name in SCHEMA.names[1:]}
    for row in best_fit_decreasing([p[3] for p in pieces], length):
        own = [pieces[i] for i in row]
        sizes = np.array([p[3] for p in own])
        ends = np.cumsum(sizes)
        ids, positions = np.full(length, pad, dtype="<u2"), np.zeros(length, dtype="<u2")
        ids[: ends[-1]] = np.concatenate([tokens[d][at : at + size] for d, _, at, size in own])
        positions[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        values = (int(ends[-1]), [doc_ids[p[0]] for p in own], [p[1] for p in own], [p[2] for p in own], [0, *ends.tolist()], ids.tobytes(), positions.tobytes())
        for name, value in zip(out, values, strict=True):
            out[name].append(value)
    return out


def pack(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, length: int = LENGTH, pad: int | None = None, group_tokens: int = GROUP_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed rows of all documents.  ``pad`` is the first id after the vocabulary unless it is given."""
    pad = len(ranks) if pad is None else pad
    if max(pad, length, *ranks.values()) > 0xFFFF:
        raise ValueError("ids and positions must fit 16 bits")
    workers_import(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    columns = [(f.name, t) for f, t in zip(SCHEMA, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ranks, own_pattern = shared.value
        encode = tiktoken.Encoding("packing", pat_str=own_pattern, mergeable_ranks=own_ranks, special_tokens={}).encode_ordinary
        first = TaskContext.get().partitionId() << 32
        held: tuple[list, list] = [], []
        count = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal first, held, count
            if count >= group_tokens or last and count:
                made = pack_group(*held, length, pad)
                n = len(made["ids"])
                made["pack_id"] = list(range(first, first + n))
                first, held, count = first + n, ([], []), 0
                for i in range(0, n, 256):
                    yield pa.RecordBatch.from_arrays([pa.array(made[name][i : i + 256], kind) for name, kind in columns], [name for name, _ in columns])

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(value.as_py() or "")
                if ids:
                    held[0].append(doc)
                    held[1].append(np.array(ids, dtype="<u2"))
                    count += len(ids)
                yield from flush(False)
        yield from flush(True)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Parquet with one packed row a record: the id and position matrices as fixed-width binary columns."""
    packed.write.mode("overwrite").parquet(path)
