"""Registered queries of the SQL surface.

Each text runs through the engine's front end; the same text is its DuckDB check unless another
is given.  Every output column is named, every order is total, sums are rounded.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name -> text, or (text, DuckDB text)
SQL: dict[str, str | tuple[str, str]] = {
    # flagship: scan, filter, three-way join, group, having, top-k
    "flagship_top_customers": """
        SELECT c.c_custkey AS custkey, c.c_name AS name, n.n_name AS nation, COUNT(*) AS n_lines, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        WHERE l.l_returnflag = 'R' GROUP BY c.c_custkey, c.c_name, n.n_name HAVING COUNT(*) > 2 ORDER BY revenue DESC, custkey LIMIT 20""",
    # projection, predicates
    "scan_project": "SELECT o_orderkey AS k, o_totalprice * 2 AS twice, -o_totalprice AS neg, o_orderkey + 1 AS next, o_orderkey % 7 AS m FROM orders",
    "project_star": "SELECT * FROM nation",
    "project_table_star": "SELECT n.*, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "select_constant": "SELECT 1 + 1 AS two, 'a' || 'b' AS ab, 7 / 2 AS half, 1e3 AS thousand, TRUE AS yes, NULL AS nothing",
    "filter_predicates": "SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_quantity >= 45 AND (l_discount < 0.02 OR l_tax > 0.07) AND NOT l_returnflag = 'N'",
    "filter_dates": "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1995-01-01' + INTERVAL '3' MONTH",
    "case_when": "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, CASE p_brand WHEN 'Brand#11' THEN 1 ELSE 0 END AS is_11 FROM part",
    "in_between_like_ilike": "SELECT p_partkey AS k FROM part WHERE p_size IN (1, 5, 9, 14, 23) OR p_size BETWEEN 40 AND 45 OR p_name LIKE 'a%' OR p_type ILIKE '%STEEL%' OR p_brand NOT LIKE 'Brand%'",
    "not_in_not_between": "SELECT s_suppkey AS k FROM supplier WHERE s_nationkey NOT IN (1, 2, 3) AND s_acctbal NOT BETWEEN 0 AND 5000",
    "is_null": "SELECT e.event_id AS k, NULLIF(event_type, 'click') IS NULL AS is_click, NULLIF(event_type, 'click') IS NOT NULL AS other FROM events e",
    "null_logic": "SELECT n_nationkey AS k, (NULLIF(n_regionkey, 1) = 2) AS eq, (NULLIF(n_regionkey, 1) = 2 OR n_nationkey > 10) AS any_of, NOT (NULLIF(n_regionkey, 1) > 2) AS neg, NULLIF(n_regionkey, 1) IN (2, 3) AS among FROM nation",
    "distinct": "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders",
    "comments_and_quotes": """SELECT n_name AS "the name", /* a comment */ 'it''s' AS quoted -- to the end
        FROM nation""",
    # joins
    "join_inner": "SELECT n.n_name AS nation, r.r_name AS region FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey",
    "join_left": "SELECT c.c_custkey AS custkey, o.o_orderkey AS orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000",
    "join_right": "SELECT n.n_name AS nation, s.s_suppkey AS suppkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000",
    "join_full": "SELECT a.k AS a_key, b.k AS b_key FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 8) b ON a.k = b.k",
    "join_cross": "SELECT r.r_name AS a, n.n_name AS b FROM region r CROSS JOIN nation n",
    "join_comma": "SELECT n.n_name AS nation, r.r_name AS region FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "join_using": "SELECT k, a.v AS av, b.w AS bw FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) a JOIN (SELECT n_nationkey AS k, n_regionkey AS w FROM nation) b USING (k)",
    "join_natural": "SELECT k, v, w FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) a NATURAL JOIN (SELECT n_nationkey AS k, n_regionkey AS w FROM nation) b",
    "join_theta": "SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal",
    "join_null_keys": "SELECT a.k AS ak, b.k AS bk FROM (SELECT NULLIF(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT NULLIF(r_regionkey, 2) AS k FROM region) b ON a.k = b.k",
    "semi_exists": "SELECT c.c_custkey AS k FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "anti_not_exists": "SELECT c.c_custkey AS k FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "in_subquery": "SELECT s_suppkey AS k FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "not_in_subquery": "SELECT s_suppkey AS k FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "scalar_subquery": "SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.8 FROM orders)",
    "correlated_subquery": "SELECT p.p_partkey AS k, (SELECT COUNT(*) FROM lineitem l WHERE l.l_partkey = p.p_partkey) AS n FROM part p",
    # aggregates
    "agg_basic": """SELECT l_returnflag AS flag, l_linestatus AS status, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge,
        ROUND(AVG(l_discount), 6) AS disc, MIN(l_shipdate) AS first_day, MAX(l_extendedprice) AS top FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "agg_global": "SELECT COUNT(*) AS n, COUNT(NULLIF(l_returnflag, 'N')) AS not_n, CAST(SUM(l_linenumber) AS BIGINT) AS s, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem",
    "agg_global_having": "SELECT COUNT(*) AS n FROM region HAVING COUNT(*) > 100",
    "agg_empty": "SELECT COUNT(*) AS n, SUM(n_nationkey) AS s, AVG(n_nationkey) AS a, MIN(n_name) AS m FROM nation WHERE n_nationkey < 0",
    "agg_distinct": "SELECT o_orderstatus AS status, COUNT(DISTINCT o_custkey) AS customers, CAST(SUM(DISTINCT o_orderkey % 100) AS BIGINT) AS s, ROUND(AVG(DISTINCT o_orderkey % 10), 4) AS a FROM orders GROUP BY o_orderstatus",
    "agg_filter": "SELECT l_returnflag AS flag, COUNT(*) FILTER (WHERE l_quantity > 25) AS big, ROUND(SUM(l_extendedprice) FILTER (WHERE l_discount = 0), 2) AS full_price FROM lineitem GROUP BY l_returnflag",
    "agg_stats": "SELECT c_mktsegment AS seg, ROUND(STDDEV(c_acctbal), 4) AS sd, ROUND(STDDEV_POP(c_acctbal), 4) AS sdp, ROUND(VARIANCE(c_acctbal), 2) AS v, ROUND(VAR_POP(c_acctbal), 2) AS vp, ROUND(VAR_SAMP(c_acctbal), 2) AS vs FROM customer GROUP BY c_mktsegment",
    "agg_single_row_stats": "SELECT n_nationkey AS k, STDDEV(n_regionkey) AS sd, VAR_SAMP(n_regionkey) AS v FROM nation GROUP BY n_nationkey",
    "agg_median_mode": ("SELECT p_brand AS brand, MEDIAN(p_retailprice) AS med, MODE(p_size) AS top FROM part GROUP BY p_brand",
        "SELECT brand, med, top FROM (SELECT p_brand AS brand, MEDIAN(p_retailprice) AS med FROM part GROUP BY p_brand) JOIN (SELECT brand, arg_min(s, (-n, s)) AS top FROM (SELECT p_brand AS brand, p_size AS s, COUNT(*) AS n FROM part GROUP BY ALL) GROUP BY brand) USING (brand)"),
    "string_agg": "SELECT n_regionkey AS k, STRING_AGG(n_name, ', ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
    "group_concat": "SELECT n_regionkey AS k, GROUP_CONCAT(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "listagg_within_group": ("SELECT n_regionkey AS k, LISTAGG(n_name, '|') WITHIN GROUP (ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey AS k, STRING_AGG(n_name, '|' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey"),
    "array_agg": ("SELECT n_regionkey AS k, ARRAY_LENGTH(ARRAY_AGG(n_name)) AS n, ARRAY_JOIN(ARRAY_AGG(n_name ORDER BY n_name), '+') AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey AS k, CAST(COUNT(*) AS INTEGER) AS n, STRING_AGG(n_name, '+' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "having": "SELECT o_custkey AS k, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 3 AND SUM(o_totalprice) > 100000",
    "having_no_group": ("SELECT n_name AS name, n_nationkey AS k FROM nation HAVING n_nationkey > 20 AND name <> 'CHINA'", "SELECT n_name AS name, n_nationkey AS k FROM nation WHERE n_nationkey > 20 AND n_name <> 'CHINA'"),
    "array_agg_mixed": ("SELECT n_regionkey AS k, ARRAY_JOIN(ARRAY_AGG(n_name ORDER BY LENGTH(n_name) DESC, n_name), '+') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS k, STRING_AGG(n_name, '+' ORDER BY LENGTH(n_name) DESC, n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_arg_min": "SELECT c_nationkey AS nat, ARG_MIN(c_custkey, -c_custkey) AS lo, ARG_MAX(c_name, c_custkey) AS hi FROM customer GROUP BY c_nationkey",
    "having_alias": "SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 3",
    "group_by_alias_ordinal": "SELECT EXTRACT(YEAR FROM o_orderdate) AS y, o_orderstatus AS s, COUNT(*) AS n FROM orders GROUP BY 1, s",
    "group_nulls": "SELECT NULLIF(o_orderstatus, 'F') AS s, COUNT(*) AS n FROM orders GROUP BY NULLIF(o_orderstatus, 'F')",
    "agg_expressions": "SELECT o_orderpriority AS p, ROUND(SUM(o_totalprice) / COUNT(*), 4) AS mean, CAST(ROUND(MAX(o_totalprice)) AS BIGINT)::VARCHAR AS top, CASE WHEN COUNT(*) > 100 THEN 'many' ELSE 'few' END AS how FROM orders GROUP BY o_orderpriority",
    "any_value": ("SELECT n_regionkey AS k, ANY_VALUE(n_regionkey * 2) AS v FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS k, ANY_VALUE(n_regionkey * 2) AS v FROM nation GROUP BY n_regionkey"),
    "rollup": "SELECT o_orderstatus AS s, o_orderpriority AS p, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube": "SELECT l_returnflag AS f, l_linestatus AS s, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT c_mktsegment AS seg, c_nationkey AS nat, COUNT(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    # windows
    "win_rank_family": "SELECT o_orderkey AS k, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, RANK() OVER (ORDER BY o_orderstatus) AS rk, DENSE_RANK() OVER (ORDER BY o_orderstatus) AS dr FROM orders",
    "win_ntile_pct_cume": "SELECT c_custkey AS k, NTILE(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS q, ROUND(PERCENT_RANK() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 8) AS pr, ROUND(CUME_DIST() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 8) AS cd FROM customer",
    "win_lag_lead": "SELECT o_orderkey AS k, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, LEAD(o_totalprice, 2, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next2 FROM orders",
    "win_first_last_nth": "SELECT o_orderkey AS k, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, NTH_VALUE(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n2 FROM orders",
    "win_running": "SELECT o_orderkey AS k, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS running, COUNT(*) OVER (PARTITION BY o_custkey) AS n, ROUND(AVG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 6) AS mean, MIN(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS lo, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS hi FROM orders",
    "win_moving": "SELECT event_id AS k, ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS m FROM events",
    "win_short_frame": "SELECT event_id AS k, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 3 PRECEDING), 3) AS m FROM events",
    "win_centered": "SELECT event_id AS k, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM events",
    "win_range": "SELECT c_custkey AS k, COUNT(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM customer",
    "win_other_aggregates": "SELECT c_custkey AS k, ROUND(STDDEV_POP(c_acctbal) OVER (PARTITION BY c_nationkey), 3) AS sd FROM customer",
    "win_named": "SELECT o_orderkey AS k, ROW_NUMBER() OVER w AS rn, CAST(SUM(o_orderkey % 10) OVER w AS BIGINT) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_arithmetic": "SELECT o_orderkey AS k, ROUND(o_totalprice * 100 / SUM(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS pct, COALESCE(o_totalprice - LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0.0) AS delta FROM orders",
    "win_over_group": "SELECT c_nationkey AS nat, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC, c_nationkey) AS rk FROM customer GROUP BY c_nationkey",
    "qualify_top1": "SELECT o_custkey AS cust, o_orderkey AS k, o_totalprice AS price FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "qualify_alias": "SELECT c_mktsegment AS seg, c_custkey AS k, RANK() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rk FROM customer QUALIFY rk <= 3",
    "qualify_hidden_order": "SELECT o_orderkey AS k FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "qualify_aggregate_alias": ("SELECT o_orderstatus AS s, o_custkey AS c, SUM(o_totalprice) AS total FROM orders GROUP BY o_orderstatus, o_custkey QUALIFY RANK() OVER (PARTITION BY o_orderstatus ORDER BY total DESC, o_custkey) <= 2 ORDER BY total",
        "SELECT s, c, total FROM (SELECT s, c, total, RANK() OVER (PARTITION BY s ORDER BY total DESC, c) AS r FROM (SELECT o_orderstatus AS s, o_custkey AS c, SUM(o_totalprice) AS total FROM orders GROUP BY ALL)) WHERE r <= 2"),
    # order and limits
    "order_limit_offset": "SELECT o_orderkey AS k, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    "order_ordinal": "SELECT n_regionkey AS r, n_name AS name FROM nation ORDER BY 1 DESC, 2 LIMIT 7",
    "order_hidden_column": "SELECT n_name AS name FROM nation ORDER BY n_nationkey DESC LIMIT 4",
    "order_nulls_default": ("SELECT k, v FROM (SELECT n_nationkey AS k, NULLIF(n_regionkey, 2) AS v FROM nation) t ORDER BY v DESC, k LIMIT 8", "SELECT k, v FROM (SELECT n_nationkey AS k, NULLIF(n_regionkey, 2) AS v FROM nation) t ORDER BY v DESC NULLS FIRST, k LIMIT 8"),
    "order_nulls_last": "SELECT k, v FROM (SELECT n_nationkey AS k, NULLIF(n_regionkey, 4) AS v FROM nation) t ORDER BY v DESC NULLS LAST, k LIMIT 8",
    "order_nulls_first": "SELECT k, v FROM (SELECT n_nationkey AS k, NULLIF(n_regionkey, 4) AS v FROM nation) t ORDER BY v NULLS FIRST, k LIMIT 8",
    # set operations
    "union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region UNION SELECT 99",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "set_op_order": "SELECT n_name AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT r_name FROM region ORDER BY name LIMIT 6",
    "set_op_parentheses": "(SELECT n_name AS name FROM nation ORDER BY n_name LIMIT 3) UNION ALL (SELECT r_name FROM region)",
    # subqueries in FROM, common table expressions
    "derived_table": "SELECT big.k AS k, big.total AS total FROM (SELECT o_custkey AS k, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) AS big WHERE big.total > 400000",
    "cte_multi": "WITH t AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey), m AS (SELECT MAX(n) AS top FROM t) SELECT t.k AS k, t.n AS n FROM t JOIN m ON t.n = m.top",
    "cte_columns": "WITH t(a, b) AS (SELECT n_nationkey, n_name FROM nation) SELECT a, b FROM t WHERE a > 20",
    "cte_recursive": "WITH RECURSIVE nums(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM nums WHERE n < 50) SELECT CAST(n AS BIGINT) AS n, CAST(n * n AS BIGINT) AS sq FROM nums",
    "cte_shadows_table": "WITH region AS (SELECT n_name AS r_name FROM nation WHERE n_nationkey < 3) SELECT r_name AS name FROM region",
    # pivot
    "pivot_sql": ("SELECT * FROM (SELECT o_orderpriority AS p, o_orderstatus AS s, o_orderkey AS k FROM orders) PIVOT (COUNT(k) FOR s IN ('F' AS f, 'O' AS o, 'P' AS pending))",
        "SELECT o_orderpriority AS p, NULLIF(COUNT(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, NULLIF(COUNT(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, NULLIF(COUNT(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS pending FROM orders GROUP BY 1"),
    "unpivot_sql": ("SELECT k, measure, amount FROM (SELECT s_suppkey AS k, s_acctbal AS bal, s_acctbal * 2 AS twice FROM supplier) UNPIVOT (amount FOR measure IN (bal, twice))",
        "SELECT s_suppkey AS k, 'bal' AS measure, s_acctbal AS amount FROM supplier UNION ALL SELECT s_suppkey, 'twice', s_acctbal * 2 FROM supplier"),
    # functions
    "fn_string_case": "SELECT c_custkey AS k, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, LENGTH(c_name) AS n, REVERSE(c_name) AS r FROM customer",
    "fn_string_length": ("SELECT doc_id AS k, LEN(text) AS n, CHAR_LENGTH(text) AS c, CHARACTER_LENGTH(text) AS cl, OCTET_LENGTH(text) AS b, BYTE_LENGTH(text) AS bb FROM documents",
        "SELECT doc_id AS k, LENGTH(text) AS n, LENGTH(text) AS c, LENGTH(text) AS cl, CAST(STRLEN(text) AS BIGINT) AS b, CAST(STRLEN(text) AS BIGINT) AS bb FROM documents"),
    "fn_string_cut": "SELECT c_custkey AS k, SUBSTR(c_name, 3, 4) AS s, SUBSTRING(c_name, 5) AS s2, LEFT(c_name, 3) AS l, RIGHT(c_name, 2) AS r, SPLIT_PART(c_name, '#', 2) AS p FROM customer",
    "fn_string_trim_pad": "SELECT n_nationkey AS k, TRIM('  ' || n_name || ' ') AS t, LTRIM('  ' || n_name) AS l, RTRIM(n_name || '  ') AS r, LPAD(n_name, 12, '*') AS lp, RPAD(n_name, 4, '-') AS rp, REPEAT('ab', 3) AS rep FROM nation",
    "fn_string_search": "SELECT p_partkey AS k, STARTS_WITH(p_name, 'a') AS s, ENDS_WITH(p_type, 'L') AS e, CONTAINS(p_name, 'e') AS c, POSITION('e' IN p_name) AS pos, REPLACE(p_brand, '#', '-') AS rep FROM part",
    "fn_string_build": ("SELECT n_nationkey AS k, CONCAT(n_name, NULL, '-', n_regionkey) AS c, CONCAT_WS('/', n_name, NULL, 'x') AS w, ASCII(n_name) AS a, CHR(8364) AS euro, CHAR(65) AS letter FROM nation",
        "SELECT n_nationkey AS k, CONCAT(n_name, NULL, '-', n_regionkey) AS c, CONCAT_WS('/', n_name, NULL, 'x') AS w, ASCII(n_name) AS a, CHR(8364) AS euro, CHR(65) AS letter FROM nation"),
    "fn_math_round": "SELECT o_orderkey AS k, ABS(-o_totalprice) AS a, CEIL(o_totalprice) AS c, FLOOR(-o_totalprice) AS f, ROUND(o_totalprice, 1) AS r, TRUNC(o_totalprice) AS t, CAST(SIGN(o_totalprice - 100000.0) AS INTEGER) AS s FROM orders",
    "fn_math_compound": ("SELECT l_orderkey AS k, l_linenumber AS n, FLOOR(l_extendedprice - l_discount) AS f, CEIL(l_extendedprice + l_tax) AS c, TRUNC(l_extendedprice * -1.5) AS t, TRUNCATE(l_quantity * 2 - 0.7) AS t2, FLOOR(CASE WHEN l_quantity > 25 THEN -l_quantity / 3 ELSE l_quantity / 3 END) AS fc, CEIL(FLOOR(l_tax * 100 + 10.5) / 3) AS nested, FLOOR(-l_quantity + 0.5) AS neg, CAST(FLOOR(l_linenumber - 3) AS BIGINT) AS whole FROM lineitem",
        "SELECT l_orderkey AS k, l_linenumber AS n, FLOOR(l_extendedprice - l_discount) AS f, CEIL(l_extendedprice + l_tax) AS c, TRUNC(l_extendedprice * -1.5) AS t, TRUNC(l_quantity * 2 - 0.7) AS t2, FLOOR(CASE WHEN l_quantity > 25 THEN -l_quantity / 3 ELSE l_quantity / 3 END) AS fc, CEIL(FLOOR(l_tax * 100 + 10.5) / 3) AS nested, FLOOR(-l_quantity + 0.5) AS neg, CAST(FLOOR(l_linenumber - 3) AS BIGINT) AS whole FROM lineitem"),
    "fn_math_power": "SELECT p_partkey AS k, ROUND(SQRT(p_retailprice), 6) AS s, ROUND(POWER(p_size, 2), 4) AS p, ROUND(POW(2, p_size), 2) AS p2, ROUND(LN(p_retailprice), 8) AS ln, ROUND(LOG10(p_retailprice), 8) AS l10, ROUND(LOG2(p_retailprice), 8) AS l2, ROUND(LOG(p_retailprice), 8) AS l, ROUND(EXP(p_size / 10.0), 6) AS e FROM part",
    "fn_math_trig": ("SELECT n_nationkey AS k, ROUND(SIN(n_nationkey), 9) AS s, ROUND(COS(n_nationkey), 9) AS c, ROUND(TAN(n_nationkey), 7) AS t, ROUND(PI(), 9) AS pi, ROUND(E(), 9) AS e, ROUND(DEGREES(n_nationkey), 7) AS d, ROUND(RADIANS(n_nationkey), 9) AS r FROM nation",
        "SELECT n_nationkey AS k, ROUND(SIN(n_nationkey), 9) AS s, ROUND(COS(n_nationkey), 9) AS c, ROUND(TAN(n_nationkey), 7) AS t, ROUND(PI(), 9) AS pi, ROUND(EXP(1), 9) AS e, ROUND(DEGREES(n_nationkey), 7) AS d, ROUND(RADIANS(n_nationkey), 9) AS r FROM nation"),
    "fn_math_mod_log": ("SELECT n_nationkey AS k, MOD(n_nationkey, 3) AS m, MOD(n_nationkey, n_regionkey) AS m0, ROUND(LOG(2, n_nationkey + 1), 8) AS lb FROM nation", "SELECT n_nationkey AS k, n_nationkey % 3 AS m, n_nationkey % NULLIF(n_regionkey, 0) AS m0, ROUND(LOG(2, n_nationkey + 1), 8) AS lb FROM nation"),
    "fn_null": ("SELECT n_nationkey AS k, COALESCE(NULLIF(n_regionkey, 1), -1) AS c, IFNULL(NULLIF(n_regionkey, 1), -2) AS i, NVL(NULLIF(n_regionkey, 1), -3) AS nv, GREATEST(n_nationkey, n_regionkey, 3) AS g, LEAST(n_nationkey, NULL, 3) AS l, IIF(n_nationkey > 5, 'a', 'b') AS iif, IF(n_nationkey > 5, 1, 0) AS one, ISNULL(NULLIF(n_regionkey, 1)) AS isn, ISNAN(n_nationkey) AS nan FROM nation",
        "SELECT n_nationkey AS k, COALESCE(NULLIF(n_regionkey, 1), -1) AS c, IFNULL(NULLIF(n_regionkey, 1), -2) AS i, COALESCE(NULLIF(n_regionkey, 1), -3) AS nv, GREATEST(n_nationkey, n_regionkey, 3) AS g, LEAST(n_nationkey, NULL, 3) AS l, CASE WHEN n_nationkey > 5 THEN 'a' ELSE 'b' END AS iif, CASE WHEN n_nationkey > 5 THEN 1 ELSE 0 END AS one, NULLIF(n_regionkey, 1) IS NULL AS isn, FALSE AS nan FROM nation"),
    "fn_typeof": ("SELECT TYPEOF(n_nationkey) AS i, TYPEOF(n_name) AS s, TYPEOF(1.5::DOUBLE) AS d, TYPEOF(TRUE) AS b FROM nation", "SELECT 'INTEGER' AS i, 'VARCHAR' AS s, 'DOUBLE' AS d, 'BOOLEAN' AS b FROM nation"),
    "fn_date_parts": "SELECT o_orderkey AS k, EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(MONTH FROM o_orderdate) AS m, EXTRACT(DAY FROM o_orderdate) AS d, EXTRACT(DOW FROM o_orderdate) AS dow, EXTRACT(DOY FROM o_orderdate) AS doy, EXTRACT(WEEK FROM o_orderdate) AS w, EXTRACT(QUARTER FROM o_orderdate) AS q, DATE_PART('hour', o_orderdate) AS h FROM orders",
    "fn_date_fields": ("SELECT event_id AS k, YEAR(ts) AS y, MONTH(ts) AS m, DAY(ts) AS d, HOUR(ts) AS h, MINUTE(ts) AS mi, SECOND(ts) AS s, EPOCH(ts) AS e, EPOCH_MS(ts) AS ms FROM events",
        "SELECT event_id AS k, YEAR(ts) AS y, MONTH(ts) AS m, DAY(ts) AS d, HOUR(ts) AS h, MINUTE(ts) AS mi, SECOND(ts) AS s, CAST(FLOOR(EPOCH_US(ts) / 1000000) AS BIGINT) AS e, EPOCH_US(ts) // 1000 AS ms FROM events"),
    "fn_date_trunc": "SELECT DATE_TRUNC('month', ts) AS m, COUNT(*) AS n FROM events GROUP BY 1",
    "fn_date_trunc_units": "SELECT event_id AS k, CAST(DATE_TRUNC('year', ts) AS DATE) AS y, CAST(DATE_TRUNC('quarter', ts) AS DATE) AS q, CAST(DATE_TRUNC('week', ts) AS DATE) AS w, CAST(DATE_TRUNC('day', ts) AS DATE) AS d, DATE_TRUNC('hour', ts) AS h, DATE_TRUNC('minute', ts) AS mi FROM events",
    "fn_date_diff": ("SELECT o_orderkey AS k, DATE_DIFF('day', DATE '1992-01-01', o_orderdate) AS d, DATE_DIFF('month', DATE '1992-01-15', o_orderdate) AS m, DATE_DIFF('year', DATE '1992-12-31', o_orderdate) AS y, DATEDIFF(o_orderdate, DATE '1992-01-01') AS d2 FROM orders",
        "SELECT o_orderkey AS k, DATE_DIFF('day', TIMESTAMP '1992-01-01', o_orderdate) AS d, DATE_DIFF('month', TIMESTAMP '1992-01-15', o_orderdate) AS m, DATE_DIFF('year', TIMESTAMP '1992-12-31', o_orderdate) AS y, DATE_DIFF('day', TIMESTAMP '1992-01-01', o_orderdate) AS d2 FROM orders"),
    "fn_date_add": ("SELECT o_orderkey AS k, DATE_ADD('day', 10, o_orderdate) AS d, DATE_ADD('month', 2, o_orderdate) AS m, DATEADD('year', 1, o_orderdate) AS y, DATE_ADD(CAST(o_orderdate AS DATE), 5) AS d5, DATE_SUB(CAST(o_orderdate AS DATE), INTERVAL '3' DAY) AS s3, CAST(o_orderdate AS DATE) - INTERVAL '1' MONTH AS im FROM orders",
        "SELECT o_orderkey AS k, CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS d, CAST(o_orderdate + INTERVAL 2 MONTH AS DATE) AS m, CAST(o_orderdate + INTERVAL 1 YEAR AS DATE) AS y, CAST(o_orderdate AS DATE) + 5 AS d5, CAST(o_orderdate AS DATE) - 3 AS s3, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS im FROM orders"),
    "fn_date_names": ("SELECT o_orderkey AS k, DAYNAME(o_orderdate) AS d, MONTHNAME(o_orderdate) AS m, LAST_DAY(o_orderdate) AS l, STRFTIME('%Y/%m/%d', o_orderdate) AS f, MAKE_DATE(2024, 2, 29) AS leap FROM orders",
        "SELECT o_orderkey AS k, DAYNAME(o_orderdate) AS d, MONTHNAME(o_orderdate) AS m, LAST_DAY(o_orderdate) AS l, STRFTIME(o_orderdate, '%Y/%m/%d') AS f, MAKE_DATE(2024, 2, 29) AS leap FROM orders"),
    "fn_date_make": ("SELECT DATE('2024-03-01') AS d, TIMESTAMP('2024-03-01 10:11:12') AS t, TO_DATE('2024-13-01') AS bad, TO_TIMESTAMP(86400) AS ts, AGE(DATE '2024-03-01', DATE '2024-02-01') = INTERVAL '29' DAY AS age, TODAY() = CURRENT_DATE AS today, NOW() <= CURRENT_TIMESTAMP AS now",
        "SELECT DATE '2024-03-01' AS d, TIMESTAMP '2024-03-01 10:11:12' AS t, CAST(NULL AS DATE) AS bad, TIMESTAMP '1970-01-02' AS ts, TRUE AS age, TRUE AS today, TRUE AS now"),
    "fn_date_compound": ("SELECT o_orderkey AS k, AGE(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) - INTERVAL '3' DAY) = INTERVAL '3' DAY AS age, YEAR(CAST(o_orderdate AS DATE) + INTERVAL '40' DAY) AS y, DATE_DIFF('day', CAST(o_orderdate AS DATE) - INTERVAL '1' DAY, CAST(o_orderdate AS DATE) + INTERVAL '1' DAY) AS d, DATE_ADD('day', o_orderkey % 5 + 1, o_orderdate) AS a, EPOCH(o_orderdate + INTERVAL '1' HOUR) AS e, EXTRACT(DAY FROM o_orderdate + INTERVAL '1' DAY) AS day FROM orders",
        "SELECT o_orderkey AS k, TRUE AS age, YEAR(CAST(o_orderdate AS DATE) + INTERVAL 40 DAY) AS y, CAST(2 AS BIGINT) AS d, CAST(o_orderdate + TO_DAYS(CAST(o_orderkey % 5 + 1 AS INTEGER)) AS DATE) AS a, EPOCH_US(o_orderdate + INTERVAL 1 HOUR) // 1000000 AS e, EXTRACT(DAY FROM o_orderdate + INTERVAL 1 DAY) AS day FROM orders"),
    "fn_strftime_column": ("SELECT o_orderkey AS k, STRFTIME(CASE WHEN o_orderkey % 2 = 0 THEN '%Y/%m' ELSE '%d of %B %%' END, o_orderdate) AS f FROM orders", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN STRFTIME(o_orderdate, '%Y/%m') ELSE STRFTIME(o_orderdate, '%d of %B %%') END AS f FROM orders"),
    "fn_time": ("SELECT n_nationkey AS k, CURRENT_TIME() IS NOT NULL AS now, CAST('10:11:12' AS TIME) = TIME '10:11:12' AS t, CAST('x' AS TIME) IS NULL AS bad, HOUR(TIME '10:11:12') AS h, MINUTE(TIME '10:11:12') AS m, SECOND(TIME '10:11:12') AS s FROM nation", "SELECT n_nationkey AS k, TRUE AS now, TRUE AS t, TRUE AS bad, 10 AS h, 11 AS m, 12 AS s FROM nation"),
    "cast_postfix": ("SELECT o_orderkey AS k, CASE WHEN o_totalprice > 100000 THEN '1' ELSE 'x' END::INTEGER AS big, SPLIT(o_orderpriority, '-')[0]::INTEGER AS pr, CAST(o_orderstatus AS INTERVAL) IS NULL AS i FROM orders", "SELECT o_orderkey AS k, TRY_CAST(CASE WHEN o_totalprice > 100000 THEN '1' ELSE 'x' END AS BIGINT) AS big, CAST(SPLIT_PART(o_orderpriority, '-', 1) AS BIGINT) AS pr, TRUE AS i FROM orders"),
    "like_backslash": "SELECT n_nationkey AS k, 'a\\b' LIKE 'a\\b' AS same, n_name || '\\' LIKE '%\\' AS tail, n_name LIKE '%' || '\\' || '%' AS none, n_name LIKE LEFT(n_name, 2) || '%' AS head, n_name ILIKE 'c\\_%' AS under FROM nation",
    "fn_cast": ("SELECT CAST('42' AS INTEGER) AS a, CAST('3.7' AS INTEGER) AS b, CAST('x' AS INTEGER) AS c, TRY_CAST('1.5' AS DOUBLE) AS d, CAST(12.345 AS DECIMAL(10, 2)) AS e, CAST(7 AS VARCHAR) AS f, CAST('yes' AS BOOLEAN) AS g, CAST('on' AS BOOLEAN) AS h, CAST('2024-02-30' AS DATE) AS i, '2024-02-29'::DATE AS j, CAST(TRUE AS INTEGER) AS l, 3.9::DOUBLE::INTEGER AS m",
        "SELECT 42::BIGINT AS a, 3::BIGINT AS b, NULL::BIGINT AS c, 1.5::DOUBLE AS d, 12.35::DECIMAL(10, 2) AS e, '7' AS f, TRUE AS g, TRUE AS h, NULL::DATE AS i, DATE '2024-02-29' AS j, 1::BIGINT AS l, 3::BIGINT AS m"),
    "fn_cast_dates": ("SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS INTEGER) AS days, CAST(o_orderdate AS INTEGER) AS micros, CAST(o_orderkey AS DATE) AS d, CAST(o_orderkey AS TIMESTAMP) AS t FROM orders",
        "SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS BIGINT) AS days, EPOCH_US(o_orderdate) AS micros, DATE '1970-01-01' + CAST(o_orderkey AS INTEGER) AS d, TIMESTAMP '1970-01-01' + TO_MICROSECONDS(o_orderkey) AS t FROM orders"),
    "fn_to": ("SELECT TO_VARCHAR(n_nationkey) AS a, TO_STRING(n_name) AS b, TO_NUMBER('1.5') AS c, TO_INTEGER('7.9') AS d, TO_DOUBLE('x') AS e, TO_INT('12') AS f FROM nation",
        "SELECT CAST(n_nationkey AS VARCHAR) AS a, n_name AS b, CAST(1.5 AS DOUBLE) AS c, CAST(7 AS BIGINT) AS d, CAST(NULL AS DOUBLE) AS e, CAST(12 AS BIGINT) AS f FROM nation"),
}


def _tables(text: str) -> list[str]:
    words = set(re.findall(r"\w+", text.lower()))
    return [t for t in TABLES if t in words]


def engine_over(spark: SparkSession, sf_dir: str, names: list[str]) -> Engine:
    engine = Engine(spark)
    for name in names:
        engine.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return engine


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine_over(spark, sf_dir, _tables(text)).query(text)

    return query


QUERIES = {name: _run(t if isinstance(t, str) else t[0]) for name, t in SQL.items()}
ORACLE_SQL = {name: t if isinstance(t, str) else t[1] for name, t in SQL.items()}
