"""Row-wise Arrow mapping of a text column, carrying other columns along."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .session import workers_import

BITMAP_BITS = 1 << 26

Mapper = Callable[[pa.Array], Sequence[pa.Array]]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front while the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def map_texts(df: DataFrame, factory: Callable[[], Mapper], fields: Sequence[T.StructField], text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns and, of each row's text, ``fields`` as ``factory()`` computes them.

    No shuffle: one narrow stage over the input partitions.  ``factory`` runs once in each task.
    """
    workers_import(df.sparkSession)
    keep = list(keep)
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    arrow = to_arrow_schema(schema)
    picked = df.select(*[df[f"`{c}`"] for c in keep], df[f"`{text}`"].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = factory()
        for batch in batches:
            if batch.num_rows:
                out = mapper(batch.column(len(keep)))
                kept = [c.cast(f.type) for c, f in zip(batch.columns[: len(keep)], arrow)]
                made = [a.cast(f.type) for a, f in zip(out, list(arrow)[len(keep) :], strict=True)]
                yield pa.RecordBatch.from_arrays(kept + made, schema=arrow)

    return picked.mapInArrow(run, schema)


def filter_texts(df: DataFrame, factory: Callable[[], Callable[[pa.Array], pa.Array]], text: str = "text") -> DataFrame:
    """The rows, with all their columns, for whose text the mapper's boolean is true."""
    workers_import(df.sparkSession)
    at = df.columns.index(text)
    arrow = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = factory()
        for batch in batches:
            if batch.num_rows:
                left = batch.filter(mapper(batch.column(at)))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(left.columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, df.schema)


def bitmap(wanted: DataFrame, name: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of the hashes in a column, on the driver: ``bits`` bits whatever the table."""
    slot = F.pmod(F.col(name), F.lit(bits))
    words = wanted.where(F.col(name).isNotNull()).select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    rows = words.toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of some hashes a bitmap may hold."""
    at = hashes.view(np.uint64) & np.uint64(len(held) * 64 - 1)
    return ((held[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def split_likely(df: DataFrame, key: Column, wanted: DataFrame, name: str, bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(the rows whose key, a hash, may be among those of the column ``name`` of ``wanted``; the others, of which it is not).

    A bitmap of ``bits`` bits tells them apart where they are read, before any is shuffled to meet ``wanted`` itself.
    """
    spark = df.sparkSession
    workers_import(spark)
    shared = spark.sparkContext.broadcast(bitmap(wanted, name, bits))
    keyed = df.select(*(F.col(f"`{c}`") for c in df.columns), key.alias("__key"))

    def keep(there: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left = batch.filter(pa.array(in_bitmap(shared.value, batch.column(batch.num_columns - 1).to_numpy()) == there))
                yield pa.RecordBatch.from_arrays(left.columns[:-1], left.schema.names[:-1])

        return run

    return keyed.mapInArrow(keep(True), df.schema), keyed.mapInArrow(keep(False), df.schema)


def likely(df: DataFrame, key: Column, wanted: DataFrame, name: str, bits: int = BITMAP_BITS) -> DataFrame:
    """The first part of :func:`split_likely`."""
    return split_likely(df, key, wanted, name, bits)[0]
