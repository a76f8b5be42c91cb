"""Tables as immutable versions, views, and snapshots of all of them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ConstraintError, NullError, SchemaError, SqlError
from .session import cut_lineage

#: Versions of a table between two cuts of its lineage.
CUT_EVERY = 8


@dataclass(frozen=True)
class Column:
    name: str
    kind: str  # Spark SQL name of the type
    nullable: bool = True
    default: str | None = None  # Spark SQL text


@dataclass(frozen=True)
class Reference:
    columns: tuple[str, ...]
    table: str
    targets: tuple[str, ...]


@dataclass(frozen=True)
class Table:
    """One version of a table; a change makes another."""

    name: str
    columns: tuple[Column, ...]
    data: DataFrame
    keys: tuple[tuple[str, ...], ...] = ()  # unique; rows with a null in a key are left alone
    checks: tuple[str, ...] = ()  # Spark SQL texts
    references: tuple[Reference, ...] = ()
    version: int = 0

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise SchemaError(f"table {self.name} has no column {name}")

    def with_data(self, data: DataFrame) -> Table:
        version = self.version + 1
        return replace(self, data=cut_lineage(data) if version % CUT_EVERY == 0 else data, version=version)

    def typed(self, rows: DataFrame) -> DataFrame:
        """Rows with the table's column names, cast to its types; a value that its type cannot hold raises when read."""
        return rows.select(*(F.col(f"`{c.name}`").cast(c.kind).alias(c.name) for c in self.columns))


@dataclass
class Catalog:
    spark: SparkSession
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)  # tables registered from outside, read only

    # -- names -----------------------------------------------------------------------------------------------------

    def has(self, name: str) -> bool:
        key = name.upper()
        return key in self.tables or key in self.views or key in self.frames

    def table(self, name: str) -> Table:
        if name.upper() in self.frames:
            raise SqlError(f"{name} is registered from outside and is read only")
        if name.upper() not in self.tables:
            raise SqlError(f"table {name} does not exist")
        return self.tables[name.upper()]

    def names(self) -> list[str]:
        return sorted([*self.tables, *self.views, *self.frames])

    def create(self, table: Table) -> None:
        if self.has(table.name):
            raise SqlError(f"{table.name} exists already")
        names = [c.name.lower() for c in table.columns]
        if len(set(names)) < len(names):
            raise SchemaError(f"table {table.name} names a column twice")
        self.tables[table.name.upper()] = table

    def put(self, table: Table) -> None:
        self.tables[table.name.upper()] = table

    def drop(self, name: str) -> None:
        self.table(name)
        del self.tables[name.upper()]

    def register(self, name: str, df: DataFrame) -> None:
        """Make a DataFrame (a Parquet read, say) readable under a name."""
        self.frames[name.upper()] = df

    def empty(self, columns: tuple[Column, ...]) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([T.StructField(c.name, T._parse_datatype_string(c.kind)) for c in columns]))

    # -- snapshots -------------------------------------------------------------------------------------------------

    def snapshot(self) -> tuple[dict, dict, dict]:
        return dict(self.tables), dict(self.views), dict(self.frames)

    def restore(self, snapshot: tuple[dict, dict, dict]) -> None:
        self.tables, self.views, self.frames = (dict(x) for x in snapshot)

    # -- constraints -----------------------------------------------------------------------------------------------

    def verify(self, table: Table, rows: DataFrame, *, old: DataFrame | None = None, changed: set[str] | None = None) -> int:
        """The number of ``rows``, which are new or changed in this version of the table, if they keep its constraints.

        Nulls, checks and the number are one pass over ``rows``.  Keys: new rows are compared with each other and joined to the
        ``old`` ones; without ``old`` the whole version is grouped, unless none of the key's columns is among those ``changed``.
        """
        required = [c.name for c in table.columns if not c.nullable and (changed is None or c.name in changed)]
        broken = [F.max(F.col(f"`{c}`").isNull()) for c in required] + [F.max(F.coalesce(~F.expr(f"({k})"), F.lit(False))) for k in table.checks]
        count, *found = rows.agg(F.count("*").alias("n"), *(b.alias(f"b{i}") for i, b in enumerate(broken))).first()
        for name, bad in zip(required, found, strict=False):
            if bad:
                raise NullError(f"column {name} of {table.name} takes no null")
        for text, bad in zip(table.checks, found[len(required) :], strict=True):
            if bad:
                raise ConstraintError(f"check {text} of {table.name} does not hold")
        for key in table.keys:
            if changed is not None and not changed & set(key):
                continue
            own = (table.data if old is None else rows).dropna(subset=list(key)).select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key)))
            twice = own.groupBy(*own.columns).count().where("count > 1").limit(1).count()
            if not twice and old is not None:
                before = old.dropna(subset=list(key)).select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key)))
                twice = before.join(own, own.columns, "left_semi").limit(1).count()
            if twice:
                raise ConstraintError(f"key ({', '.join(key)}) of {table.name} is not unique")
        for r in table.references:
            if changed is not None and not changed & set(r.columns):
                continue
            other = self.table(r.table)
            targets = r.targets or (other.keys[0] if other.keys else ())
            if len(r.columns) != len(targets):
                raise SchemaError(f"reference of {table.name} to {r.table} does not name as many columns")
            own = rows.dropna(subset=list(r.columns)).select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(r.columns)))
            theirs = other.data.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(targets)))
            if own.join(theirs, own.columns, "left_anti").limit(1).count():
                raise ConstraintError(f"a row of {table.name} refers to no row of {r.table}")
        return count
