"""Scenarios of the SQL surface, with exact results."""

from __future__ import annotations

import datetime
import math

import pytest
from pyspark.errors import PySparkException

from tidemark.engine import Engine
from tidemark.errors import ConstraintError, IndexOutOfBoundsError, NullError, SchemaError, SqlError
from tidemark.functions import routines

# The employees.
EMPLOYEES = """CREATE TABLE employees (id INTEGER, name VARCHAR, dept VARCHAR, salary DOUBLE);
    INSERT INTO employees VALUES (1, 'Alice', 'Engineering', 90000), (2, 'Bob', 'Engineering', 80000), (3, 'Carol', 'Marketing', 70000), (4, 'Dave', 'Marketing', 75000), (5, 'Eve', 'Engineering', 95000)"""


@pytest.fixture
def db(engine):
    engine.execute(EMPLOYEES)
    return engine


def rows(db, sql):
    return db.execute(sql).rows


def test_select_where_order_limit(db):
    assert rows(db, "SELECT name FROM employees WHERE dept = 'Engineering' ORDER BY salary DESC") == [("Eve",), ("Alice",), ("Bob",)]
    assert rows(db, "SELECT name FROM employees ORDER BY salary DESC LIMIT 1") == [("Eve",)]
    assert rows(db, "SELECT name FROM employees ORDER BY id LIMIT 2 OFFSET 1") == [("Bob",), ("Carol",)]
    assert rows(db, "SELECT DISTINCT dept FROM employees ORDER BY 1") == [("Engineering",), ("Marketing",)]


def test_group_and_having(db):
    assert rows(db, "SELECT dept, COUNT(*) AS n, AVG(salary) AS a FROM employees GROUP BY dept ORDER BY dept") == [("Engineering", 3, (90000 + 80000 + 95000) / 3), ("Marketing", 2, 72500.0)]
    assert rows(db, "SELECT dept, COUNT(*) AS n FROM employees GROUP BY dept HAVING n > 2") == [("Engineering", 3)]
    assert rows(db, "SELECT COUNT(*) AS n FROM employees HAVING COUNT(*) > 9") == []


def test_joins(engine):
    engine.execute("CREATE TABLE d (id INTEGER, name VARCHAR); INSERT INTO d VALUES (1, 'Engineering'), (3, 'Sales'); CREATE TABLE e (id INTEGER, name VARCHAR, dept_id INTEGER); INSERT INTO e VALUES (1, 'Alice', 1), (2, 'Bob', 99), (3, 'Carol', NULL)")
    assert rows(engine, "SELECT e.name, d.name FROM e INNER JOIN d ON e.dept_id = d.id") == [("Alice", "Engineering")]
    assert rows(engine, "SELECT e.name, d.name FROM e LEFT JOIN d ON e.dept_id = d.id ORDER BY e.id") == [("Alice", "Engineering"), ("Bob", None), ("Carol", None)]
    assert rows(engine, "SELECT e.name, d.name FROM e FULL OUTER JOIN d ON e.dept_id = d.id ORDER BY e.id, d.id") == [("Alice", "Engineering"), ("Bob", None), ("Carol", None), (None, "Sales")]
    assert rows(engine, "SELECT COUNT(*) FROM e CROSS JOIN d") == [(6,)]


def test_subqueries_and_ctes(db):
    assert rows(db, "SELECT name FROM employees WHERE salary > (SELECT AVG(salary) FROM employees) ORDER BY name") == [("Alice",), ("Eve",)]
    assert rows(db, "WITH high AS (SELECT * FROM employees WHERE salary > 85000) SELECT COUNT(*) FROM high") == [(2,)]
    assert rows(db, "SELECT n FROM (SELECT dept, COUNT(*) AS n FROM employees GROUP BY dept) WHERE dept = 'Marketing'") == [(2,)]
    assert rows(db, "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 10) SELECT SUM(n) FROM t") == [(55,)]


def test_windows_and_qualify(db):
    assert rows(db, "SELECT name, RANK() OVER (PARTITION BY dept ORDER BY salary DESC) AS r FROM employees ORDER BY id") == [("Alice", 2), ("Bob", 3), ("Carol", 2), ("Dave", 1), ("Eve", 1)]
    assert rows(db, "SELECT name FROM employees QUALIFY ROW_NUMBER() OVER (PARTITION BY dept ORDER BY salary DESC) = 1 ORDER BY name") == [("Dave",), ("Eve",)]
    assert rows(db, "SELECT * FROM (SELECT name, SUM(salary) OVER (ORDER BY id) AS s FROM employees) WHERE name = 'Carol'") == [("Carol", 240000.0)]
    top = rows(db, "WITH t AS (SELECT name, dept FROM employees QUALIFY RANK() OVER (PARTITION BY dept ORDER BY salary) = 1 AND salary > 75000) SELECT name FROM t")
    assert top == [("Bob",)]


def test_insert_update_delete_counts(db):
    assert db.execute("INSERT INTO employees (id, name) VALUES (6, 'Frank')").affected_rows == 1
    assert rows(db, "SELECT COUNT(*), COUNT(dept) FROM employees") == [(6, 5)]
    assert db.execute("UPDATE employees SET salary = salary * 2, dept = 'X' WHERE dept = 'Marketing'").affected_rows == 2
    assert rows(db, "SELECT SUM(salary) FROM employees WHERE dept = 'X'") == [(290000.0,)]
    assert db.execute("DELETE FROM employees WHERE dept = 'Engineering'").affected_rows == 3
    assert rows(db, "SELECT name FROM employees ORDER BY id") == [("Carol",), ("Dave",), ("Frank",)]
    assert db.execute("TRUNCATE TABLE employees").affected_rows == 3


def test_insert_select_and_many_versions(engine):
    engine.execute("CREATE TABLE src (val INTEGER); CREATE TABLE dst (val INTEGER)")
    for i in range(10):
        engine.execute(f"INSERT INTO src VALUES ({i})")
    assert engine.execute("INSERT INTO dst SELECT val * 2 FROM src WHERE val > 6").affected_rows == 3
    assert rows(engine, "SELECT val FROM dst ORDER BY val") == [(14,), (16,), (18,)]


def test_update_with_subquery(db):
    db.execute("UPDATE employees SET salary = 0 WHERE dept IN (SELECT dept FROM employees WHERE name = 'Dave')")
    assert rows(db, "SELECT COUNT(*) FROM employees WHERE salary = 0") == [(2,)]


def test_merge(engine):
    engine.execute("CREATE TABLE t (k INTEGER, v VARCHAR DEFAULT 'd'); INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c'); CREATE TABLE s (k INTEGER, v VARCHAR); INSERT INTO s VALUES (1, 'A'), (2, NULL), (4, 'D')")
    done = engine.execute("MERGE INTO t USING s ON t.k = s.k WHEN MATCHED AND s.v IS NULL THEN DELETE WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT (k) VALUES (s.k)")
    assert done.affected_rows == 3
    assert rows(engine, "SELECT * FROM t ORDER BY k") == [(1, "A"), (3, "c"), (4, "d")]
    engine.execute("INSERT INTO s VALUES (1, 'again')")
    with pytest.raises(SqlError):
        engine.execute("MERGE INTO t USING s ON t.k = s.k WHEN MATCHED THEN DELETE")


def test_transactions(engine):
    engine.execute("CREATE TABLE t (n INTEGER); INSERT INTO t VALUES (1); BEGIN; INSERT INTO t VALUES (2); ROLLBACK")
    assert rows(engine, "SELECT COUNT(*) FROM t") == [(1,)]
    engine.execute("BEGIN TRANSACTION; INSERT INTO t VALUES (2); SAVEPOINT a; INSERT INTO t VALUES (3); SAVEPOINT b; INSERT INTO t VALUES (4); ROLLBACK TO SAVEPOINT a; INSERT INTO t VALUES (5); RELEASE SAVEPOINT a; COMMIT")
    assert rows(engine, "SELECT n FROM t ORDER BY n") == [(1,), (2,), (5,)]
    with pytest.raises(SqlError):
        engine.execute("ROLLBACK TO SAVEPOINT b")


def test_constraints(engine):
    engine.execute("CREATE TABLE p (id INTEGER PRIMARY KEY); INSERT INTO p VALUES (1)")
    engine.execute("CREATE TABLE c (id INTEGER, p_id INTEGER REFERENCES p(id), amount DOUBLE CHECK (amount >= 0), tag VARCHAR NOT NULL DEFAULT 'x', UNIQUE (id, tag))")
    engine.execute("INSERT INTO c (id, p_id, amount) VALUES (1, 1, 2.5), (2, NULL, NULL)")
    for bad, error in (("(3, 9, 1.0)", ConstraintError), ("(3, 1, -1.0)", ConstraintError), ("(1, 1, 1.0)", ConstraintError)):
        with pytest.raises(error):
            engine.execute(f"INSERT INTO c (id, p_id, amount) VALUES {bad}")
    with pytest.raises(NullError):
        engine.execute("UPDATE c SET tag = NULL")
    with pytest.raises(NullError):
        engine.execute("INSERT INTO p VALUES (NULL)")
    with pytest.raises(ConstraintError):
        engine.execute("INSERT INTO p VALUES (1)")
    assert rows(engine, "SELECT id, tag FROM c ORDER BY id") == [(1, "x"), (2, "x")]


def test_ddl(engine):
    engine.execute("CREATE TABLE IF NOT EXISTS a (x INTEGER); CREATE TABLE IF NOT EXISTS a (y INTEGER); INSERT INTO a VALUES (1); ALTER TABLE a ADD COLUMN y DECIMAL(10, 2) DEFAULT 1.5; ALTER TABLE a RENAME COLUMN x TO z; ALTER TABLE a RENAME TO b")
    assert rows(engine, "DESCRIBE b") == [("z", "INTEGER", True), ("y", "DECIMAL(10,2)", True)]
    assert rows(engine, "SHOW TABLES") == [("B",)]
    with pytest.raises(SqlError):
        engine.execute("CREATE TABLE b (x INTEGER)")
    with pytest.raises(SchemaError):
        engine.execute("ALTER TABLE b ADD COLUMN Z INTEGER")
    engine.execute("CREATE VIEW v AS SELECT z + 1 AS n FROM b; CREATE TABLE c AS SELECT n FROM v")
    engine.execute("INSERT INTO b VALUES (10, 2)")
    assert rows(engine, "SELECT n FROM v ORDER BY n") == [(2,), (11,)]
    assert rows(engine, "SELECT n FROM c") == [(2,)]
    engine.execute("DROP VIEW v; DROP TABLE c; DROP TABLE IF EXISTS nothing")
    with pytest.raises(SqlError):
        engine.execute("DROP TABLE nothing")
    assert "Plan" in engine.execute("EXPLAIN SELECT * FROM b").message


def test_nulls(engine):
    engine.execute("CREATE TABLE t (id INTEGER, val INTEGER); INSERT INTO t VALUES (1, 10), (2, NULL), (3, 30)")
    assert rows(engine, "SELECT COUNT(*), COUNT(val), SUM(val), AVG(val) FROM t") == [(3, 2, 40, 20.0)]
    assert rows(engine, "SELECT id FROM t WHERE val IS NULL") == [(2,)]
    assert rows(engine, "SELECT id FROM t WHERE val NOT IN (10)") == [(3,)]
    assert rows(engine, "SELECT val FROM t ORDER BY val") == [(10,), (30,), (None,)]
    assert rows(engine, "SELECT val FROM t ORDER BY val DESC") == [(None,), (30,), (10,)]
    assert rows(engine, "SELECT val FROM t ORDER BY val DESC NULLS LAST") == [(30,), (10,), (None,)]
    assert rows(engine, "SELECT COALESCE(val, -1) FROM t WHERE id = 2") == [(-1,)]
    assert rows(engine, "SELECT ARRAY_AGG(val ORDER BY id) FROM t") == [([10, None, 30],)]


def test_functions(engine):
    assert rows(engine, "SELECT UPPER('a'), LENGTH('héllo'), TRIM(' \t x '), SUBSTR('hello', 2, 3), REPLACE('aXa', 'X', '-'), CONCAT('a', NULL, 1)") == [("A", 5, "x", "ell", "a-a", "a1")]
    assert rows(engine, "SELECT CAST('42' AS INTEGER), CAST('3.14' AS DOUBLE), CAST('3.7' AS INTEGER), TRY_CAST('x' AS INTEGER), '7'::INTEGER + 1") == [(42, 3.14, 3, None, 8)]
    assert rows(engine, "SELECT EXTRACT(YEAR FROM DATE '2024-02-29'), DATE_ADD('month', 1, DATE '2024-01-31'), DATE_DIFF('month', DATE '2024-01-31', DATE '2024-03-01'), DAYNAME(DATE '2024-03-10')") == [(2024, datetime.date(2024, 2, 29), 2, "Sunday")]
    assert rows(engine, "SELECT STRFTIME(DATE '2024-03-10', '%d.%m.%Y'), DATE '2024-03-10' + INTERVAL '1' DAY, CHR(8364), LOG(100), CEIL(-1.5::DOUBLE)") == [("10.03.2024", datetime.date(2024, 3, 11), "€", 2.0, -1.0)]
    assert rows(engine, "SELECT CASE WHEN 1 > 2 THEN 'a' ELSE 'b' END, IIF(1 = 1, 'x', 'y'), NULLIF(1, 1), GREATEST(1, NULL, 3)") == [("b", "x", None, 3)]
    with pytest.raises(PySparkException):
        engine.execute("SELECT no_such_function(1)")


def test_literals_and_scripts(engine):
    assert rows(engine, "SELECT 'it''s' AS a, 'back\\slash' AS b; -- the end") == [("it's", "back\\slash")]
    assert engine.execute("SELECT 1 AS \"Odd name\", 2 AS 'other'").columns == ["Odd name", "other"]
    assert rows(engine, "SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 1 ORDER BY 1 DESC") == [(2,), (1,), (1,)]
    for bad in ("SELECT (1", "NONSENSE", "SELECT 'open"):
        with pytest.raises(SqlError):
            engine.execute(bad)


def test_results(db):
    r = db.execute("SELECT id, name FROM employees ORDER BY id")
    assert (r.row_count(), r.column_count(), r.columns, r.get(1, "NAME"), r.get(0, 0)) == (5, 2, ["id", "name"], "Bob", 1)
    with pytest.raises(IndexOutOfBoundsError):
        r.get(9, 0)


def test_time_type(engine):
    engine.execute("CREATE TABLE t (a TIME); INSERT INTO t VALUES (CAST('10:11:12' AS TIME))")
    assert rows(engine, "SELECT a, CAST('x' AS TIME) FROM t") == [(datetime.time(10, 11, 12), None)]


def test_user_functions(engine):
    engine.register_function("twice", lambda x: x * 2, "bigint")
    assert rows(engine, "SELECT twice(21)") == [(42,)]


@pytest.mark.parametrize("x", [-2.5, -2.0, -1e-20, 0.0, 0.3, 2.0, 7.5, 1e300, math.inf, -math.inf])
def test_whole_numbers(engine, x):
    a, b = (x, 0.0) if not math.isfinite(x) else (x - 1, 1.0)
    if math.isfinite(x):
        x = a + b
    engine.execute(f"CREATE TABLE n AS SELECT CAST('{a!r}' AS DOUBLE) AS a, CAST('{b!r}' AS DOUBLE) AS b")
    whole = (lambda f: f(x) if math.isfinite(x) and abs(x) < 1e16 else x)
    assert rows(engine, "SELECT FLOOR(a + b), CEIL(a + b), TRUNC(a + b), TRUNCATE(CASE WHEN TRUE THEN a + b END) FROM n") == [(whole(math.floor), whole(math.ceil), whole(math.trunc), whole(math.trunc))]


def test_random_arguments_are_evaluated_once(engine):
    got = [r[0] for r in rows(engine, "SELECT FLOOR(RANDOM() * 10) FROM range(500)")]
    assert set(got) == {float(i) for i in range(10)}
    assert rows(engine, "SELECT COUNT(*) FROM (SELECT CEIL(CEIL(CEIL(CEIL(id / 3 + 0.5) / 2 + 1) * 1.5) - 0.25) AS c FROM range(50)) WHERE c <> FLOOR(c)") == [(0,)]


# One call of each function of one argument, of the kind that it takes.
NUMBERS = [f for f in "ABS CEIL CEILING FLOOR TRUNC TRUNCATE ROUND SQRT EXP LN LOG LOG2 LOG10 SIGN SIN COS TAN DEGREES RADIANS CHR CHAR ISNULL IS_NULL ISNAN TYPEOF TO_VARCHAR TO_STRING TO_NUMBER TO_NUMERIC TO_DOUBLE TO_INTEGER TO_INT TO_TIMESTAMP LENGTH LEN".split()]
TEXTS = [f for f in "UPPER LOWER LENGTH LEN CHAR_LENGTH CHARACTER_LENGTH OCTET_LENGTH BYTE_LENGTH TRIM LTRIM RTRIM REVERSE ASCII TO_NUMBER DATE TIMESTAMP TO_DATE YEAR MONTH DAY DAYOFMONTH".split()]
DATES = [f for f in "YEAR MONTH DAY DAYOFMONTH EPOCH EPOCH_MS DAYNAME MONTHNAME LAST_DAY DATE TIMESTAMP".split()]


@pytest.mark.parametrize("names, whole, parts", [(NUMBERS, "66", "60 + 6"), (NUMBERS, "66", "68 - 2"), (NUMBERS, "66", "CASE WHEN 1 = 1 THEN 66 ELSE 0 END"), (TEXTS, "'2024-03-10'", "'2024-03' || '-10'"), (DATES, "DATE '2024-03-10'", "DATE '2024-03-09' + INTERVAL '1' DAY")])
def test_compound_arguments(engine, names, whole, parts):
    assert rows(engine, "SELECT " + ", ".join(f"{f}({whole})" for f in names)) == rows(engine, "SELECT " + ", ".join(f"{f}({parts})" for f in names))


@pytest.mark.parametrize("call", ["MOD({0}, {1})", "POWER({0}, {1})", "GREATEST({0}, {1})", "DATE_ADD(DATE '2024-01-01', {0})", "DATE_SUB(DATE '2024-01-01', {0})", "DATE_ADD('month', {0}, DATE '2024-01-01')", "SUBSTR('abcdefghijk', {0}, {1})", "SPLIT_PART('a-b-c-d-e-f-g-h', '-', {0})", "LPAD('ab', {0}, 'x')", "REPEAT('ab', {1})", "ROUND(1234.5678, {1})", "MAKE_DATE(2000 + {0}, {1}, 1)", "IIF({0} > {1}, {0}, {1})", "COALESCE({0}, {1})", "NULLIF({0}, {1})"])
def test_compound_arguments_of_many(engine, call):
    assert rows(engine, f"SELECT {call.format('7', '3')}") == rows(engine, f"SELECT {call.format('9 - 2', '1 + 2')}") == rows(engine, f"SELECT {call.format('(9 - 2)', 'CASE WHEN 1 = 1 THEN 3 END')}")


def test_every_function_pastes_whole_arguments():
    """Each argument stands in parentheses or between commas wherever a function's text has it."""
    for name, make in routines.SCALAR.items():
        for n in range(4):
            try:
                text = make(*(f"(a{i} + b{i})" for i in range(n)))
            except Exception:  # takes another number of arguments
                continue
            assert text.count("(") == text.count(")"), name


def test_zone_has_no_part(spark, engine):
    sql = "SELECT EPOCH(TIMESTAMP '1970-01-01'), EPOCH_MS(TIMESTAMP '1969-12-31 23:59:59.5'), CAST(TIMESTAMP '2024-03-10 02:30:00' AS INTEGER), CAST(0 AS TIMESTAMP), TO_TIMESTAMP(86400), EXTRACT(EPOCH FROM DATE '1970-01-02'), DATE_DIFF('hour', TIMESTAMP '2024-03-10 01:00:00', TIMESTAMP '2024-03-10 04:00:00')"
    before, seen = spark.conf.get("spark.sql.session.timeZone"), []
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            seen.append(rows(engine, sql))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert seen == [[(0, -500, 1710037800000000, datetime.datetime(1970, 1, 1), datetime.datetime(1970, 1, 2), 86400, 3)]] * 3


def test_names_are_the_catalogs(spark, engine):
    engine.execute("CREATE TABLE t (n INTEGER); INSERT INTO t VALUES (1); CREATE VIEW v AS SELECT n FROM t")
    assert rows(engine, "SELECT t.n, x.n FROM t, (SELECT n FROM v) AS x") == [(1, 1)]
    later = engine.query("SELECT n FROM t")
    other = Engine(spark)
    for statement, name in (("DROP VIEW v", "v"), ("ALTER TABLE t RENAME TO u", "t"), ("DROP TABLE u", "u")):
        engine.execute(statement)
        for owner in (engine, other):
            with pytest.raises(SqlError):
                owner.query(f"SELECT * FROM {name}")
    engine.execute("BEGIN; CREATE TABLE b (n INTEGER)")
    assert rows(engine, "SELECT * FROM b") == []
    engine.execute("ROLLBACK")
    with pytest.raises(SqlError):
        engine.query("SELECT * FROM b")
    assert later.collect() == [(1,)]  # a plan keeps the version that it was made for
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("__tidemark")]
    engine.execute("CREATE TABLE t (n INTEGER, m INTEGER); INSERT INTO t VALUES (5, 6); CREATE VIEW a AS SELECT n FROM t")
    assert rows(engine, "WITH t AS (SELECT n + 1 AS n FROM t) SELECT t.n, (SELECT MAX(n) FROM a) FROM t") == [(6, 5)]
    assert rows(engine, "SELECT y.n FROM (t JOIN a ON t.n = a.n) JOIN t AS y ON y.n = a.n WHERE EXISTS (SELECT 1 FROM t z WHERE z.m > y.n)") == [(5,)]


def test_changes_with_aliases(db):
    assert db.execute("UPDATE employees AS e SET salary = e.salary + 1, e.dept = UPPER(e.dept) WHERE e.id = 1").affected_rows == 1
    assert db.execute("DELETE FROM employees e WHERE e.salary = 90001 OR e.dept = 'Marketing'").affected_rows == 3
    assert rows(db, "SELECT name FROM employees ORDER BY id") == [("Bob",), ("Eve",)]


def test_postfix_casts_patterns_and_intervals(engine):
    assert rows(engine, "SELECT CASE WHEN 1 = 1 THEN CASE WHEN TRUE THEN '3' END ELSE '4' END::INTEGER + 1, ARRAY('7', '8')[1]::INTEGER, -'5'::INTEGER, CAST('1 day' AS INTERVAL)") == [(4, 8, -5, None)]
    assert rows(engine, "SELECT 'a\\b' LIKE 'a\\b', '\\' LIKE '\\', 'a%b' LIKE 'a!%b' ESCAPE '!', 'axb' LIKE 'a!%b' ESCAPE '!', 'it''s' LIKE '%''_', 'AB' ILIKE 'a' || '_', 'x' NOT LIKE 'y' AND TRUE") == [(True, True, True, False, True, True, True)]


def test_filters_over_the_projection(db):
    assert rows(db, "SELECT name FROM employees HAVING salary > 85000 ORDER BY name") == [("Alice",), ("Eve",)]
    assert rows(db, "SELECT name FROM employees QUALIFY ROW_NUMBER() OVER (PARTITION BY dept ORDER BY salary DESC) <= 2 ORDER BY dept, salary") == [("Alice",), ("Eve",), ("Carol",), ("Dave",)]
    assert rows(db, "SELECT dept, SUM(salary) AS total FROM employees GROUP BY dept QUALIFY RANK() OVER (ORDER BY total DESC) = 1") == [("Engineering", 265000.0)]
    assert rows(db, "SELECT dept FROM employees GROUP BY dept QUALIFY RANK() OVER (ORDER BY SUM(salary) DESC) = 1 ORDER BY SUM(salary)") == [("Engineering",)]
    assert rows(db, "SELECT ARRAY_AGG(name ORDER BY dept DESC, salary) FROM employees") == [(["Carol", "Dave", "Bob", "Alice", "Eve"],)]
    assert rows(db, "SELECT ARRAY_AGG(id ORDER BY NULLIF(id, 3) DESC, id), ARRAY_AGG(id ORDER BY NULLIF(id, 3) NULLS FIRST) FROM employees") == [([3, 5, 4, 2, 1], [3, 1, 2, 4, 5])]


def test_changes_run_their_source_once(engine):
    engine.execute("CREATE TABLE t (k INTEGER, r DOUBLE, UNIQUE (k)); INSERT INTO t SELECT id, RANDOM() FROM range(100)")
    assert rows(engine, "SELECT SUM(r), COUNT(DISTINCT k) FROM t") == rows(engine, "SELECT SUM(r), COUNT(DISTINCT k) FROM t")
    with pytest.raises(ConstraintError):
        engine.execute("UPDATE t SET k = 1 WHERE k < 3")
    with pytest.raises(ConstraintError):
        engine.execute("MERGE INTO t USING (SELECT 500 + id AS id FROM range(2)) s ON t.k = s.id WHEN NOT MATCHED THEN INSERT (k) VALUES (5)")
    assert engine.execute("MERGE INTO t USING (SELECT id + 99 AS id FROM range(2)) s ON t.k = s.id WHEN MATCHED THEN UPDATE SET r = 2 WHEN NOT MATCHED THEN INSERT (k, r) VALUES (s.id, 3)").affected_rows == 2
    assert rows(engine, "SELECT k, r FROM t WHERE r > 1 ORDER BY k") == [(99, 2.0), (100, 3.0)]


def test_explain_runs_nothing(db):
    assert "Plan" in db.execute("EXPLAIN INSERT INTO employees (id) SELECT id FROM employees").message
    assert db.execute("EXPLAIN DELETE FROM employees").row_count() == 0
    assert rows(db, "SELECT COUNT(*) FROM employees") == [(5,)]
    with pytest.raises(SqlError):
        db.execute("EXPLAIN NONSENSE")
