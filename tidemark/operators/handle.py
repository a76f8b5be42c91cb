"""A flat interface of handles and texts over the engine, for callers from other languages."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..engine import Engine, QueryResult
from ..errors import EngineError

_engines: dict[int, Engine] = {}
_results: dict[int, QueryResult] = {}
_next = 0


def _number() -> int:
    global _next
    _next += 1
    return _next


def engine_new(spark: SparkSession | None = None) -> int:
    handle = _number()
    _engines[handle] = Engine(spark)
    return handle


def engine_free(handle: int) -> None:
    _engines.pop(handle, None)


def engine_execute(handle: int, sql: str) -> int:
    """Handle of the result; 0 on an error."""
    from pyspark.errors import PySparkException

    try:
        result = _engines[handle].execute(sql)
        result.rows  # noqa: B018  errors of running belong here
    except (EngineError, PySparkException, KeyError):
        return 0
    number = _number()
    _results[number] = result
    return number


def result_row_count(handle: int) -> int:
    return _results[handle].row_count()


def result_column_count(handle: int) -> int:
    return _results[handle].column_count()


def result_column_name(handle: int, column: int) -> str | None:
    names = _results[handle].columns
    return names[column] if 0 <= column < len(names) else None


def result_value(handle: int, row: int, column: int) -> str | None:
    """The value as text; None for null and outside the result."""
    try:
        value = _results[handle].get(row, column)
    except EngineError:
        return None
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def result_free(handle: int) -> None:
    _results.pop(handle, None)
