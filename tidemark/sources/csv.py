"""CSV files: every column is text, an empty field is null, quotes are doubled inside quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError


def read_csv(spark: SparkSession, path: str, *, delimiter: str = ",", header: bool = True, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """Short rows are filled with nulls and long ones cut; without a header the columns are col0, col1, ...

    No pass is made to guess types: give a schema to have them.  A quoted field may hold line ends, so a file is read by one
    task from its beginning; say ``multi_line=False`` for files whose records are single lines to have large ones split.
    """
    reader = spark.read.option("multiLine", multi_line).option("lineSep", "\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("sep", delimiter).option("header", header).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("nullValue", "").option("emptyValue", "")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    if not df.columns:
        raise DataError(f"{path} is empty")
    return df if header or schema else df.toDF(*(f"col{i}" for i in range(len(df.columns))))


def parse_csv(spark: SparkSession, text: str, *, delimiter: str = ",", header: bool = True) -> DataFrame:
    """A small CSV text as a DataFrame."""
    import csv
    import io

    lines = [line for line in text.splitlines() if line.strip()]
    if not lines:
        if header:
            raise DataError("the text is empty")
        return spark.createDataFrame([], T.StructType([]))
    rows = list(csv.reader(io.StringIO("\n".join(lines)), delimiter=delimiter))
    names = rows.pop(0) if header else [f"col{i}" for i in range(len(rows[0]))]
    fitted = [tuple((c or None) for c in [*r, *[""] * len(names)][: len(names)]) for r in rows]
    return spark.createDataFrame(fitted, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def write_csv(df: DataFrame, path: str, *, delimiter: str = ",", header: bool = True, mode: str = "overwrite") -> None:
    """Null is an empty field; fields with a delimiter, quote or line end are quoted, and padding stays, so that read_csv gives them back."""
    writer = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns)).write.mode(mode).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("sep", delimiter).option("header", header).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def format_csv(df: DataFrame, *, delimiter: str = ",", header: bool = True) -> str:
    """A small DataFrame as CSV text."""
    import csv
    import io

    out = io.StringIO()
    writer = csv.writer(out, delimiter=delimiter, lineterminator="\n")
    if header:
        writer.writerow(df.columns)
    writer.writerows(["" if v is None else v for v in row] for row in df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns)).collect())
    return out.getvalue()
