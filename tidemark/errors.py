"""Errors of the engine."""


class EngineError(Exception):
    """Base of all errors raised here."""


class SqlError(EngineError):
    """A statement that cannot be read or run."""


class SchemaError(EngineError):
    """A table, column or constraint definition that does not hold together."""


class ColumnNotFoundError(EngineError):
    """A column that the table does not have."""


class NullError(EngineError):
    """A null in a column that takes none."""


class ConstraintError(EngineError):
    """Rows that break a key, reference or check."""


class IndexOutOfBoundsError(EngineError):
    """A row or column number outside the result."""


class DataError(EngineError):
    """A value that its column's type cannot hold."""
