"""The SQL surface: statements that the guard lets through, over views of the tables."""

from __future__ import annotations

from .plans.guard import guarded
from .queries import query
from .sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


def statement(name: str, sql: str, oracle: str | None = None):
    def run(spark, sf):
        for t in TABLES:
            table(spark, sf, t).createOrReplaceTempView(t)
        return guarded(spark, sql)[0]

    run.__name__, run.__doc__ = name, sql
    query(oracle or sql)(run)


statement("sql_semi_join", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
statement("sql_anti_join", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
statement("sql_not_in", "SELECT count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
statement("sql_not_in_null", "SELECT count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END FROM region)")
statement("sql_left_join", "SELECT n_name, count(s_suppkey) AS n, coalesce(round(sum(s_acctbal), 2), 0.0) AS total FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
statement("sql_full_join", "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 9) b ON a.k = b.k")
statement("sql_right_join", "SELECT r_name, n_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_nationkey % 3 = 0")
statement("sql_using_join", "SELECT count(*) AS n FROM nation JOIN (SELECT n_nationkey, n_name AS other FROM nation) t USING (n_nationkey) WHERE n_name = other")
statement("sql_theta_join", "SELECT a.s_suppkey AS one, count(*) AS richer FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal GROUP BY a.s_suppkey")
statement("sql_having", "SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY o_custkey HAVING count(*) > 15")
statement("sql_filter_clause", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(sum(o_totalprice) FILTER (WHERE o_orderstatus <> 'F'), 2) AS open FROM orders GROUP BY o_orderpriority")
statement("sql_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
statement("sql_running_sum", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three FROM orders")
statement("sql_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM part")
statement("sql_ranks", "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000))", "SELECT c_custkey, (rank() OVER w)::INTEGER AS r, (dense_rank() OVER w)::INTEGER AS d, (ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey))::INTEGER AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000))")
statement("sql_lag_lead", "SELECT user_id, event_id, lag(event_type, 1, 'none') OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
statement("sql_with", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 3000000) SELECT c_name, round(t, 2) AS total FROM top JOIN customer ON c_custkey = o_custkey")
statement("sql_recursive", "WITH RECURSIVE tree(id, up, depth) AS (SELECT s_suppkey, CAST(NULL AS BIGINT), 0 FROM supplier WHERE s_suppkey = 0 UNION ALL SELECT s_suppkey, id, depth + 1 FROM tree JOIN supplier ON s_suppkey > 0 AND CAST(floor((s_suppkey - 1) / 3) AS BIGINT) = id WHERE depth < 6) SELECT id, up, depth FROM tree")
statement("sql_union", "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region")
statement("sql_union_all", "SELECT 'n' AS t, n_nationkey AS k FROM nation UNION ALL SELECT 'r', r_regionkey FROM region")
statement("sql_intersect", "SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
statement("sql_except", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
statement("sql_offset", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 30")
statement("sql_nulls_order", "SELECT k, v FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS v FROM nation) ORDER BY v NULLS FIRST, k DESC LIMIT 9")
statement("sql_like", "SELECT count(*) AS n FROM part WHERE p_name LIKE '%ring' AND upper(p_type) NOT LIKE 'ECON%' AND substring(p_brand, 1, 6) = 'Brand#'")
statement("sql_strings", "SELECT s_suppkey, concat(upper(substring(s_name, 1, 3)), '-', lpad(CAST(s_suppkey AS STRING), 5, '0')) AS code, instr(s_name, '#') AS mark, replace(s_name, '#', ' ') AS plain, length(trim(s_name)) AS n FROM supplier", "SELECT s_suppkey, concat(upper(substring(s_name, 1, 3)), '-', lpad(CAST(s_suppkey AS VARCHAR), 5, '0')) AS code, instr(s_name, '#')::INTEGER AS mark, replace(s_name, '#', ' ') AS plain, length(trim(s_name))::INTEGER AS n FROM supplier")
statement("sql_printf", "SELECT n_nationkey, format_string('%03d:%s', n_nationkey, n_name) AS line FROM nation", "SELECT n_nationkey, printf('%03d:%s', n_nationkey, n_name) AS line FROM nation")
statement("sql_glob", "SELECT c_custkey FROM customer WHERE c_name RLIKE '^Customer#[0-9]*7[0-4]$'", "SELECT c_custkey FROM customer WHERE c_name GLOB 'Customer#*7[0-4]'")
statement("sql_integer_division", "SELECT p_partkey, p_size DIV 4 AS q, p_size % 4 AS r, -p_size DIV 4 AS neg, round(p_retailprice / 3, 2) AS third, abs(-p_size) AS a FROM part", "SELECT p_partkey, (p_size // 4)::BIGINT AS q, p_size % 4 AS r, -(p_size // 4)::BIGINT AS neg, round(p_retailprice / 3, 2) AS third, abs(-p_size) AS a FROM part")
statement("sql_dates", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS month, CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS year, datediff(DATE'2001-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, date_trunc('year', o_orderdate)::TIMESTAMP AS year, (DATE '2001-01-01' - o_orderdate::DATE)::INTEGER AS days FROM orders")
statement("sql_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, get_json_object(props, '$.none') AS none FROM events", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.none' AS none FROM events")
statement("sql_json_each", "SELECT key, count(*) AS n, sum(CAST(v AS BIGINT)) AS total FROM events LATERAL VIEW explode(from_json(props, 'map<string,string>')) t AS key, v GROUP BY key", "SELECT key, count(*) AS n, sum((props->>key)::BIGINT)::BIGINT AS total FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY key")
statement("sql_group_concat", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
statement("sql_total", "SELECT coalesce(sum(CAST(s_acctbal AS DOUBLE)), 0.0) AS total, typeof(count(*)) AS kind FROM supplier WHERE s_suppkey < 0", "SELECT coalesce(sum(s_acctbal), 0.0) AS total, lower(typeof(count(*))) AS kind FROM supplier WHERE s_suppkey < 0")
statement("sql_scalar_subquery", "SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 2) AS over FROM orders WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders)", 'SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 2) AS "over" FROM orders WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders)')
statement("sql_case_values", "SELECT kind, count(*) AS n FROM orders JOIN (VALUES ('F', 'closed'), ('O', 'open')) AS v(code, kind) ON o_orderstatus = code GROUP BY kind")
