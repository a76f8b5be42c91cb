"""Registered queries of the DataFrame API, of changes to tables and of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Column
from ..engine import Engine
from ..errors import EngineError
from ..operators import handle, store, table
from ..session import shared_folder
from ..sources.csv import read_csv, write_csv
from .relational import engine_over


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def api_filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.filter_eq(_read(spark, sf_dir, "orders"), "o_orderstatus", "P").select("o_orderkey", "o_totalprice")


def api_filter_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.filter_by(_read(spark, sf_dir, "orders"), (F.col("o_totalprice") > 100000) & F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_totalprice")


def api_sort_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.sort_by(_read(spark, sf_dir, "customer"), ["c_mktsegment", "c_acctbal", "c_custkey"], [True, False]).select("c_mktsegment", "c_custkey")


def api_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table.group_by(_read(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey")
    return groups.select("n_regionkey", "n_rows", F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"))


def api_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part")
    row = (table.total(parts, "P_SIZE"), table.count(parts, "p_size"), round(table.average(parts, "p_size"), 6), table.minimum(parts, "p_name"), table.maximum(parts, "p_size"))
    return spark.createDataFrame([row], "total bigint, n bigint, mean double, lo string, hi int")


def api_row_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table filled row by row, read back as a DataFrame."""
    rows = store.Store([Column("k", "bigint", False), Column("name", "string")])
    for r in _read(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect():  # 25 rows
        rows.append_row([r[0], r[1]])
    rows.add_column(Column("twice", "double"), 0)
    for i in range(rows.row_count()):
        rows.set_value(i, "TWICE", rows.get_value_by_index(i, 0) * 2)
    rows.rename_column("name", "nation")
    return rows.to_df(spark)


def api_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results read as texts through the handle interface."""
    engine = handle.engine_new(spark)
    made = handle.engine_execute(engine, "CREATE TABLE t (k INTEGER, ok BOOLEAN); INSERT INTO t VALUES (1, TRUE), (2, NULL); SELECT k, ok FROM t ORDER BY k")
    bad = handle.engine_execute(engine, "SELECT nothing FROM nowhere")
    cells = [(handle.result_column_name(made, c), handle.result_value(made, r, c), bad) for r in range(handle.result_row_count(made)) for c in range(handle.result_column_count(made))]
    handle.result_free(made)
    handle.engine_free(engine)
    return spark.createDataFrame(cells, "name string, value string, bad int")


def api_pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.pivot_table(_read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice", "o_orderkey", ["F", "O", "P"]).withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


def api_unpivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _read(spark, sf_dir, "nation").withColumn("other", F.when(F.col("n_nationkey") > 3, F.col("n_nationkey") * 2))
    return table.unpivot_table(nations, ["n_nationkey"], ["n_name", "other"], "field", "content")


def api_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table.add_column(_read(spark, sf_dir, "region"), "added", "bigint", 7)
    return table.rename_column(table.drop_column(df, "r_regionkey"), "R_NAME", "region")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read again, in the folder the cluster shares."""
    path = f"{shared_folder(spark)}/csv-{spark.sparkContext.applicationId}-{spark.sparkContext.startTime}"
    write_csv(_read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.concat(F.lit('say "'), "p_type", F.lit('", ok')).alias("quoted"), F.nullif("p_size", F.lit(1)).alias("size")), path)
    return read_csv(spark, path).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", "p_brand", "quoted", F.col("size").cast("int").alias("size"))


def csv_awkward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends, padding, quotes and delimiters inside fields come back as they were."""
    path = f"{shared_folder(spark)}/csv-awkward-{spark.sparkContext.applicationId}-{spark.sparkContext.startTime}"
    write_csv(_read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("line\nbreak "), "p_name").alias("broken"), F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("padded"), F.concat(F.lit('",;'), "p_type").alias("marks")), path)
    return read_csv(spark, path).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "broken", "padded", "marks")


def dml_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["supplier"])
    engine.execute("CREATE TABLE t (k INTEGER NOT NULL, name VARCHAR, bal DOUBLE DEFAULT 0.5, PRIMARY KEY (k)); INSERT INTO t SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0; INSERT INTO t (name, k) VALUES ('new', -1), ('it''s', -2)")
    return engine.query("SELECT k, name, bal FROM t")


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["supplier"])
    engine.execute("CREATE TABLE t AS SELECT s_suppkey AS k, s_nationkey AS nat, s_acctbal AS bal FROM supplier; UPDATE t SET bal = bal + 1, nat = nat * 2 WHERE bal < 1000")
    return engine.query("SELECT k, nat, ROUND(bal, 2) AS bal FROM t")


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["part"])
    engine.execute("CREATE TABLE t AS SELECT p_partkey AS k, NULLIF(p_size, 5) AS size FROM part; DELETE FROM t WHERE size > 20")
    return engine.query("SELECT k, size FROM t")


def dml_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["supplier"])
    engine.execute("""
        CREATE TABLE t AS SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier WHERE s_suppkey % 3 <> 0;
        MERGE INTO t USING (SELECT s_suppkey AS id, s_acctbal * 2 AS b FROM supplier WHERE s_suppkey % 2 = 0) s ON t.k = s.id
        WHEN MATCHED AND s.b < 0 THEN DELETE WHEN MATCHED THEN UPDATE SET bal = s.b WHEN NOT MATCHED AND s.id > 3 THEN INSERT (k, bal) VALUES (s.id, -1.0)""")
    return engine.query("SELECT k, ROUND(bal, 2) AS bal FROM t")


def dml_update_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["supplier", "nation"])
    engine.execute("""CREATE TABLE t AS SELECT s_suppkey AS k, s_nationkey AS nat, s_acctbal AS bal FROM supplier;
        UPDATE t AS x SET bal = x.bal + 1, x.nat = -x.nat WHERE x.nat IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1); DELETE FROM t y WHERE y.nat = 3""")
    return engine.query("SELECT k, nat, ROUND(bal, 2) AS bal FROM t")


def dml_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["region"])
    engine.execute("CREATE TABLE t AS SELECT r_regionkey AS k FROM region; CREATE TABLE counts (n INTEGER)")
    n = engine.execute("TRUNCATE TABLE t").affected_rows
    engine.execute(f"INSERT INTO counts SELECT {n} + COUNT(*) FROM t; INSERT INTO t VALUES (77)")
    return engine.query("SELECT k, n FROM t CROSS JOIN counts")


def dml_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of some inserts and updates break a constraint; none of those that do leaves a row."""
    engine = engine_over(spark, sf_dir, ["region"])
    engine.execute("""CREATE TABLE p (id INTEGER PRIMARY KEY); INSERT INTO p SELECT r_regionkey FROM region;
        CREATE TABLE c (id INTEGER, p_id INTEGER REFERENCES p(id), amount DOUBLE CHECK (amount >= 0), tag VARCHAR NOT NULL DEFAULT 'x', UNIQUE (id, tag)); INSERT INTO c (id, p_id, amount) VALUES (1, 1, 2.5), (2, NULL, NULL)""")
    out = []
    for text in ("INSERT INTO p SELECT r_regionkey FROM region", "INSERT INTO p VALUES (NULL)", "INSERT INTO c (id, p_id) VALUES (3, 99)", "INSERT INTO c (id, amount) VALUES (3, -1)", "INSERT INTO c (id) VALUES (1)", "UPDATE c SET tag = NULL", "UPDATE c SET id = 5", "INSERT INTO c (id, p_id, amount) VALUES (9, 0, 0)"):
        try:
            engine.execute(text)
            out.append((text, "none"))
        except EngineError as e:
            out.append((text, type(e).__name__))
    return spark.createDataFrame(out, "statement string, error string").crossJoin(engine.query("SELECT COUNT(*) AS n, SUM(id) AS ids FROM c"))


def ddl_drop_recreate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that no longer stand for anything, after each was read: none answers, in this engine or another."""
    engine, other = engine_over(spark, sf_dir, ["nation"]), Engine(spark)
    engine.execute("CREATE TABLE t AS SELECT n_nationkey AS k FROM nation; CREATE VIEW v AS SELECT k FROM t; CREATE TABLE u AS SELECT k FROM t")
    for name in ("t", "v", "u"):
        engine.query(f"SELECT COUNT(*) AS n FROM {name}").collect()
    engine.execute("DROP VIEW v; ALTER TABLE u RENAME TO w; DROP TABLE t; BEGIN; CREATE TABLE b AS SELECT k FROM w")
    engine.query("SELECT k FROM b").collect()
    engine.execute("ROLLBACK")
    gone = []
    for owner, name in ((engine, "t"), (engine, "v"), (engine, "u"), (engine, "b"), (other, "w"), (other, "nation")):
        try:
            owner.query(f"SELECT * FROM {name}")
        except EngineError:
            gone.append(name)
    engine.execute(f"CREATE TABLE t AS SELECT k * 2 AS k, '{' '.join(gone)}' AS gone FROM w")
    return engine.query("SELECT k, gone FROM t")


def ddl_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["orders"])
    engine.execute("CREATE VIEW big AS SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_totalprice > 200000; CREATE OR REPLACE VIEW per AS SELECT c, COUNT(*) AS n FROM big GROUP BY c")
    return engine.query("SELECT c, n FROM per WHERE n > 1")


def ddl_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["nation"])
    engine.execute("CREATE TABLE t AS SELECT * FROM nation; ALTER TABLE t ADD COLUMN extra INTEGER DEFAULT 4; ALTER TABLE t DROP COLUMN n_regionkey; ALTER TABLE t RENAME COLUMN n_name TO name; ALTER TABLE t RENAME TO u")
    return engine.query("SELECT n_nationkey, name, extra FROM u")


def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["region"])
    engine.execute("CREATE TABLE t AS SELECT r_regionkey AS k FROM region; BEGIN; DELETE FROM t WHERE k = 0; SAVEPOINT s; DELETE FROM t; ROLLBACK TO SAVEPOINT s; COMMIT; BEGIN; DELETE FROM t; ROLLBACK")
    return engine.query("SELECT k FROM t")


def show_and_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["orders"])
    return engine.query("DESCRIBE orders").select("column_name", "column_type")


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["orders", "nation"])
    engine.execute("CREATE TABLE made (k INTEGER); CREATE VIEW seen AS SELECT k FROM made; CREATE TABLE dropped (k INTEGER); DROP TABLE dropped")
    return engine.query("SHOW TABLES")


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What EXPLAIN says of a query and of a change, which does not run."""
    engine = engine_over(spark, sf_dir, ["nation"])
    engine.execute("CREATE TABLE t (k INTEGER)")
    texts = [engine.execute(x).message for x in ("EXPLAIN SELECT n_name FROM nation WHERE n_regionkey = 1", "EXPLAIN INSERT INTO t SELECT n_nationkey FROM nation", "EXPLAIN DELETE FROM t WHERE k = 1")]
    rows = [(i, "nation.parquet" in t, "Plan" in t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "i bigint, scans boolean, plan boolean").crossJoin(engine.query("SELECT COUNT(*) AS n FROM t"))


QUERIES = {
    f.__name__: f
    for f in (
        api_filter_eq, api_filter_by, api_sort_by, api_group_by, api_aggregates, api_row_store, api_handles, api_pivot_table, api_unpivot_table, api_columns, csv_round_trip, csv_awkward, dml_insert_select, dml_update, dml_update_alias,
        dml_delete, dml_truncate, dml_constraints, dml_merge, ddl_drop_recreate, ddl_view, ddl_alter, txn_rollback, show_and_describe, show_tables, explain,
    )
}

ORACLE_SQL = {
    "api_filter_eq": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'",
    "api_filter_by": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderpriority LIKE '1%'",
    "api_sort_by": "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey",
    "api_group_by": "SELECT n_regionkey, COUNT(*) AS n_rows, STRING_AGG(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS rows FROM nation GROUP BY n_regionkey",
    "api_aggregates": "SELECT CAST(SUM(p_size) AS BIGINT) AS total, COUNT(p_size) AS n, ROUND(AVG(p_size), 6) AS mean, MIN(p_name) AS lo, MAX(p_size) AS hi FROM part",
    "api_pivot_table": """SELECT o_orderpriority, MAX_BY(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS f, MAX_BY(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS o,
        MAX_BY(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority""",
    "api_unpivot_table": "SELECT n_nationkey, 'n_name' AS field, n_name AS content FROM nation UNION ALL SELECT n_nationkey, 'other', CAST(n_nationkey * 2 AS VARCHAR) FROM nation WHERE n_nationkey > 3",
    "api_columns": "SELECT r_name AS region, CAST(7 AS BIGINT) AS added FROM region",
    "csv_round_trip": "SELECT p_partkey, p_name, p_brand, 'say \"' || p_type || '\", ok' AS quoted, NULLIF(p_size, 1) AS size FROM part",
    "dml_insert_select": "SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT -1, 'new', 0.5 UNION ALL SELECT -2, 'it''s', 0.5",
    "dml_update": "SELECT s_suppkey AS k, CASE WHEN s_acctbal < 1000 THEN s_nationkey * 2 ELSE s_nationkey END AS nat, ROUND(CASE WHEN s_acctbal < 1000 THEN s_acctbal + 1 ELSE s_acctbal END, 2) AS bal FROM supplier",
    "dml_delete": "SELECT p_partkey AS k, NULLIF(p_size, 5) AS size FROM part WHERE NOT COALESCE(NULLIF(p_size, 5) > 20, FALSE)",
    "dml_merge": """SELECT s_suppkey AS k, ROUND(CASE WHEN s_suppkey % 3 = 0 THEN -1.0 WHEN s_suppkey % 2 = 0 THEN s_acctbal * 2 ELSE s_acctbal END, 2) AS bal FROM supplier
        WHERE CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 2 = 0 AND s_suppkey > 3 ELSE s_suppkey % 2 <> 0 OR s_acctbal >= 0 END""",
    "ddl_view": "SELECT o_custkey AS c, COUNT(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1 HAVING COUNT(*) > 1",
    "ddl_alter": "SELECT n_nationkey, n_name AS name, CAST(4 AS BIGINT) AS extra FROM nation",
    "txn_rollback": "SELECT r_regionkey AS k FROM region WHERE r_regionkey <> 0",
    "show_and_describe": """SELECT column_name, CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'INTEGER' WHEN column_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' ELSE column_type END AS column_type
        FROM (DESCRIBE SELECT * FROM orders)""",
    "api_row_store": "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS nation, CAST(n_nationkey * 2 AS DOUBLE) AS twice FROM nation",
    "api_handles": "SELECT * FROM (VALUES ('k', '1', 0), ('ok', 'true', 0), ('k', '2', 0), ('ok', NULL, 0)) t(name, value, bad)",
    "csv_awkward": "SELECT p_partkey, 'line' || CHR(10) || 'break ' || p_name AS broken, '  ' || p_brand || ' ' AS padded, '\",;' || p_type AS marks FROM part",
    "dml_update_alias": """SELECT s_suppkey AS k, CASE WHEN n_regionkey = 1 THEN -s_nationkey ELSE s_nationkey END AS nat, ROUND(CASE WHEN n_regionkey = 1 THEN s_acctbal + 1 ELSE s_acctbal END, 2) AS bal
        FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE CASE WHEN n_regionkey = 1 THEN -s_nationkey ELSE s_nationkey END <> 3""",
    "dml_truncate": "SELECT CAST(77 AS BIGINT) AS k, COUNT(*) AS n FROM region",
    "dml_constraints": """SELECT statement, error, CAST(3 AS BIGINT) AS n, CAST(12 AS BIGINT) AS ids FROM (VALUES ('INSERT INTO p SELECT r_regionkey FROM region', 'ConstraintError'), ('INSERT INTO p VALUES (NULL)', 'NullError'),
        ('INSERT INTO c (id, p_id) VALUES (3, 99)', 'ConstraintError'), ('INSERT INTO c (id, amount) VALUES (3, -1)', 'ConstraintError'), ('INSERT INTO c (id) VALUES (1)', 'ConstraintError'), ('UPDATE c SET tag = NULL', 'NullError'),
        ('UPDATE c SET id = 5', 'ConstraintError'), ('INSERT INTO c (id, p_id, amount) VALUES (9, 0, 0)', 'none')) t(statement, error)""",
    "ddl_drop_recreate": "SELECT n_nationkey * 2 AS k, 't v u b w nation' AS gone FROM nation",
    "show_tables": "SELECT UNNEST(['MADE', 'NATION', 'ORDERS', 'SEEN']) AS name",
    "explain": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), TRUE, TRUE, CAST(0 AS BIGINT)), (1, TRUE, TRUE, 0), (2, FALSE, TRUE, 0)) t(i, scans, plan, n)",
}
