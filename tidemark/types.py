"""Type names of the dialect and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import SchemaError

# Spellings of the types.
_NAMES = {
    "BIGINT": ("INTEGER", "INT", "INT4", "INT8", "BIGINT", "SMALLINT", "TINYINT", "HUGEINT", "UBIGINT", "UINT64", "UINT32", "UINT16", "UINT8", "LONG"),
    "DOUBLE": ("FLOAT", "REAL", "FLOAT4", "FLOAT8", "DOUBLE"),
    "STRING": ("VARCHAR", "TEXT", "CHAR", "STRING", "BLOB", "BPCHAR", "CHARACTER", "VARYING"),
    "BOOLEAN": ("BOOLEAN", "BOOL", "BIT"),
    "DATE": ("DATE",),
    "TIMESTAMP_NTZ": ("TIMESTAMP", "DATETIME", "TIMESTAMPTZ", "TIMESTAMP_NTZ"),
    "TIME": ("TIME", "TIMETZ"),
    "INTERVAL DAY TO SECOND": ("INTERVAL",),
}
SPARK_NAME = {word: kind for kind, words in _NAMES.items() for word in words}
_SHOWN = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "double": "DOUBLE", "float": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


def spark_name(name: str, arguments: str | None = None) -> str:
    """Spark SQL name of a dialect type; DECIMAL(p, s) is a real decimal, (18, 2) by default."""
    word = name.upper()
    if word in ("DECIMAL", "NUMERIC"):
        if not arguments:
            return "DECIMAL(18, 2)"
        return f"DECIMAL({arguments})" if "," in arguments else f"DECIMAL({arguments}, 0)"
    if word not in SPARK_NAME:
        raise SchemaError(f"unknown type {name}")
    return SPARK_NAME[word]


def shown(kind: T.DataType) -> str:
    """The name that DESCRIBE gives a Spark type."""
    name = kind.simpleString()
    return _SHOWN.get(name, name.upper())
