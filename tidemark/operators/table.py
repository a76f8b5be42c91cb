"""The direct table API: filter, sort, group, aggregate, pivot and unpivot of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFoundError, SchemaError


def column(df: DataFrame, name: str) -> Column:
    """A column by its name, upper or lower case; raises if there is none."""
    for c in df.columns:
        if c.lower() == name.lower():
            return F.col(f"`{c}`")
    raise ColumnNotFoundError(name)


def filter_by(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which a condition holds."""
    return df.filter(predicate)


def filter_eq(df: DataFrame, name: str, value: Any) -> DataFrame:
    """Rows whose column equals the value; None matches null."""
    return df.filter(column(df, name).eqNullSafe(F.lit(value)))


def sort_by(df: DataFrame, names: Sequence[str], ascending: Sequence[bool] = ()) -> DataFrame:
    """Rows in order; null is the greatest value; a missing flag means ascending."""
    flags = [*ascending, *[True] * len(names)]
    return df.orderBy(*(column(df, n).asc_nulls_last() if up else column(df, n).desc_nulls_first() for n, up in zip(names, flags, strict=False)))


def group_by(df: DataFrame, names: Sequence[str], row_id: str) -> DataFrame:
    """Per group its key columns, the number of rows and the sorted array of row ids (bounded by the largest group)."""
    return df.groupBy(*(column(df, n) for n in names)).agg(F.count("*").alias("n_rows"), F.sort_array(F.collect_list(column(df, row_id))).alias("rows"))


def _one(df: DataFrame, value: Column) -> Any:
    return df.agg(value.alias("v")).first()[0]


def total(df: DataFrame, name: str) -> Any:
    """Sum of a column; None without values."""
    return _one(df, F.sum(column(df, name)))


def count(df: DataFrame, name: str) -> int:
    """Values that are not null."""
    return _one(df, F.count(column(df, name)))


def average(df: DataFrame, name: str) -> float | None:
    return _one(df, F.avg(column(df, name)))


def minimum(df: DataFrame, name: str) -> Any:
    return _one(df, F.min(column(df, name)))


def maximum(df: DataFrame, name: str) -> Any:
    return _one(df, F.max(column(df, name)))


def pivot_table(df: DataFrame, row_keys: Sequence[str], column_key: str, value: str, order: str, values: Sequence[Any] | None = None, most: int = 10_000) -> DataFrame:
    """One row per key, one column per value of ``column_key``; the last value by ``order`` stays.

    Give ``values`` to save the pass that finds them; there may be ``most`` of them.
    """
    if values is None:
        found = df.select(column(df, column_key).cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(most + 1).collect()
        if len(found) > most:
            raise SchemaError(f"{column_key} has more than {most} values")
        values = [r.v for r in found]
    keyed = df.withColumn("__pivot", column(df, column_key).cast("string"))
    last = F.max_by(column(df, value).cast("double"), column(df, order))
    return keyed.groupBy(*(column(df, k) for k in row_keys)).pivot("__pivot", [str(v) for v in values]).agg(last)


def unpivot_table(df: DataFrame, id_columns: Sequence[str], value_columns: Sequence[str], name_column: str = "name", value_column: str = "value") -> DataFrame:
    """One row per id and value column, as text; nulls are left out."""
    picked = df.select(*(column(df, c) for c in id_columns), *(column(df, c).cast("string").alias(c) for c in value_columns))
    return picked.unpivot(list(id_columns), list(value_columns), name_column, value_column).where(F.col(f"`{value_column}`").isNotNull())


def add_column(df: DataFrame, name: str, kind: T.DataType | str, value: Any = None) -> DataFrame:
    if name.lower() in (c.lower() for c in df.columns):
        raise SchemaError(f"there is a column {name} already")
    return df.withColumn(name, F.lit(value).cast(kind))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(column(df, name))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    column(df, old)
    if new.lower() in (c.lower() for c in df.columns if c.lower() != old.lower()):
        raise SchemaError(f"there is a column {new} already")
    return df.withColumnRenamed(next(c for c in df.columns if c.lower() == old.lower()), new)
