from __future__ import annotations

import datetime

import pytest

from tidemark.catalog import Column
from tidemark.errors import ColumnNotFoundError, DataError, IndexOutOfBoundsError, NullError, SchemaError
from tidemark.operators import handle, table
from tidemark.operators.store import Store
from tidemark.sources.csv import format_csv, parse_csv, read_csv, write_csv


@pytest.fixture
def sales(spark):
    return spark.createDataFrame([(1, "a", "q1", 1.0), (2, "a", "q2", 2.0), (3, "b", "q1", None), (4, "a", "q1", 9.0)], "id int, dept string, quarter string, amount double")


def test_filter_sort_group(sales):
    assert [r.id for r in table.filter_eq(sales, "AMOUNT", None).collect()] == [3]
    assert [r.id for r in table.filter_by(sales, "amount > 1").orderBy("id").collect()] == [2, 4]
    assert [r.id for r in table.sort_by(sales, ["amount"], [False]).collect()] == [3, 4, 2, 1]
    assert [r.id for r in table.sort_by(sales, ["amount"]).collect()] == [1, 2, 4, 3]
    assert {(r.dept, r.n_rows, tuple(r.rows)) for r in table.group_by(sales, ["dept"], "id").collect()} == {("a", 3, (1, 2, 4)), ("b", 1, (3,))}
    with pytest.raises(ColumnNotFoundError):
        table.filter_eq(sales, "none", 1)


def test_aggregates(sales):
    assert (table.total(sales, "amount"), table.count(sales, "amount"), table.average(sales, "amount"), table.minimum(sales, "amount"), table.maximum(sales, "amount")) == (12.0, 3, 4.0, 1.0, 9.0)
    assert table.total(sales.limit(0), "amount") is None


def test_pivot_and_unpivot(sales):
    wide = table.pivot_table(sales, ["dept"], "quarter", "amount", "id")
    assert {tuple(r) for r in wide.collect()} == {("a", 9.0, 2.0), ("b", None, None)}
    long = table.unpivot_table(wide, ["dept"], ["q1", "q2"], "quarter", "amount")
    assert {tuple(r) for r in long.collect()} == {("a", "q1", "9.0"), ("a", "q2", "2.0")}
    with pytest.raises(SchemaError):
        table.pivot_table(sales, ["dept"], "quarter", "amount", "id", most=1)


def test_columns(sales):
    assert table.rename_column(table.add_column(sales, "x", "int", 3), "DEPT", "unit").columns == ["id", "unit", "quarter", "amount", "x"]
    with pytest.raises(SchemaError):
        table.add_column(sales, "ID", "int")


def test_store(spark):
    s = Store([Column("id", "bigint", False), Column("name", "string"), Column("pay", "double"), Column("hired", "date")])
    s.append_row([1, "Alice", 5, "2024-02-29"])
    s.append_row([2, None, None, None])
    assert s.get_value(0, "PAY") == 5.0 and s.get_row(0)[3] == datetime.date(2024, 2, 29)
    s.set_value(1, "name", "Bob")
    s.add_column(Column("x", "bigint"), 4)
    s.rename_column("name", "who")
    s.drop_column("hired")
    assert [tuple(r) for r in s.to_df(spark).collect()] == [(1, "Alice", 5.0, 4), (2, "Bob", None, 4)]
    for values, error in (([None, "x", 1.0, 1], NullError), ([1, "x"], SchemaError), (["a", "x", 1.0, 1], DataError)):
        with pytest.raises(error):
            s.append_row(values)
    with pytest.raises(IndexOutOfBoundsError):
        s.get_row(7)


def test_csv_text(spark):
    df = parse_csv(spark, 'id,name\n1,"a, ""b"""\n\n2\n3,c,surplus\n')
    assert [tuple(r) for r in df.collect()] == [("1", 'a, "b"'), ("2", None), ("3", "c")]
    assert format_csv(df) == 'id,name\n1,"a, ""b"""\n2,\n3,c\n'
    assert parse_csv(spark, "1|2", delimiter="|", header=False).columns == ["col0", "col1"]
    with pytest.raises(DataError):
        parse_csv(spark, "")


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([("1", 'x "y", z'), ("2", None)], "a string, b string")
    write_csv(df, str(tmp_path / "out"))
    assert {tuple(r) for r in read_csv(spark, str(tmp_path / "out")).collect()} == {("1", 'x "y", z'), ("2", None)}


def test_handles(spark):
    e = handle.engine_new(spark)
    assert handle.engine_execute(e, "NONSENSE") == 0
    r = handle.engine_execute(e, "SELECT 1 AS a, NULL AS b, TRUE AS c")
    assert (handle.result_row_count(r), handle.result_column_count(r), handle.result_column_name(r, 0)) == (1, 3, "a")
    assert [handle.result_value(r, 0, i) for i in range(4)] == ["1", None, "true", None]
    handle.result_free(r)
    handle.engine_free(e)
    assert handle.engine_execute(e, "SELECT 1") == 0
