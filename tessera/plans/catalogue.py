"""Registered queries of the engine, each with its DuckDB twin.

Most are dialect text, run by tessera.dialect; the DuckDB text is the same unless a second one is given. Functions run
through the DataFrame API where that is the surface they have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.dialect.engine import SqlSession
from tessera.sources.tables import table

REGISTRY: dict[str, tuple] = {}


def query(name: str, oracle: str | None):
    """Register a query function with the SQL that DuckDB runs on the same tables."""

    def add(fn):
        REGISTRY[name] = (fn, oracle)
        return fn

    return add


def text(name: str, sql: str, oracle: str | None = None) -> None:
    """Register dialect text; oracle where DuckDB needs other words."""
    REGISTRY[name] = (lambda spark, sf_dir: SqlSession(spark, sf_dir).sql(sql), oracle or sql)


FLAGSHIP = """
SELECT c_mktsegment, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS revenue
FROM customer INNER JOIN orders ON c_custkey = o_custkey
WHERE o_orderstatus = 'F' AND o_totalprice > 1000
GROUP BY c_mktsegment HAVING COUNT(*) > 1 ORDER BY c_mktsegment LIMIT 10
"""


@query("flagship", FLAGSHIP)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 1000")
    joined = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    grouped = joined.groupBy("c_mktsegment").agg(
        F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue")
    )
    return grouped.where("n_orders > 1").orderBy("c_mktsegment").limit(10)


text("flagship_sql", FLAGSHIP)

# ---- scans, projections, predicates
text("scan_project", "SELECT n_nationkey, n_name FROM nation")
text("select_star", "SELECT * FROM region")
text("select_qualified", "SELECT c.c_custkey, c.c_name FROM customer c WHERE c.c_nationkey = 3")
text("select_alias_arithmetic", "SELECT p_partkey AS k, p_size * 2 + 1 AS s, p_size % 7 AS m, p_name || '!' AS e FROM part")
text(
    "case_when",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
)
text("pred_eq", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
text("pred_ne", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'")
text("pred_ne_bang", "SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'")
text("pred_cmp", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice > 950.5")
text("pred_negative_literal", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -500.5")
text("pred_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9")
text("pred_not_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45")
text("pred_in", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
text("pred_not_in", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
text("pred_is_null", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 WHERE o_orderkey IS NULL")
text("pred_is_not_null", "SELECT c_custkey FROM customer WHERE NULLIF(c_mktsegment, 'BUILDING') IS NOT NULL")
text("pred_like_ci", "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE '%uIld_ng'", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%uIld_ng'")
text("pred_not_like", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT LIKE 'b%'", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT ILIKE 'b%'")
text("pred_and_or", "SELECT p_partkey FROM part WHERE p_size = 1 OR p_size > 40 AND NOT (p_retailprice < 1000 OR p_brand = 'Brand#11')")

# ---- JSON operators and functions on events.props
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
text("json_arrow", "SELECT event_id, props -> 'k' AS k FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
text("json_arrow_text", "SELECT event_id, props ->> 'k' AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
text("json_key_exists", "SELECT event_id FROM events WHERE props ? 'k'", "SELECT event_id FROM events WHERE json_exists(props, '$.k')")
text("json_all_keys", "SELECT event_id FROM events WHERE props ?& 'k'", "SELECT event_id FROM events WHERE json_exists(props, '$.k')")
text("json_any_key", "SELECT event_id FROM events WHERE props ?| 'z,k'", "SELECT event_id FROM events WHERE json_exists(props, '$.k')")
text("json_contains", "SELECT event_id FROM events WHERE props @> '{\"k\": 87}'", f"SELECT event_id FROM events WHERE {K} = 87")
text("json_contained", "SELECT event_id FROM events WHERE props <@ '{\"k\": 87, \"z\": 1}'", f"SELECT event_id FROM events WHERE {K} = 87")
text("fn_json_extract", "SELECT event_id, JSON_EXTRACT(props, '$.k') AS k FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
text("fn_json_extract_text", "SELECT event_id, JSON_EXTRACT_TEXT(props, '$.z') AS z FROM events", "SELECT event_id, coalesce(json_extract_string(props, '$.z'), '') AS z FROM events")
text("fn_json_valid", "SELECT event_id, JSON_VALID(props) AS v, JSON_VALID('{x') AS w FROM events", "SELECT event_id, json_valid(props) AS v, false AS w FROM events")
text("fn_json_typeof", "SELECT event_id, JSON_TYPEOF(props) AS t, JSON_TYPEOF('[1]') AS a, JSON_TYPEOF('null') AS n FROM events", "SELECT event_id, 'object' AS t, 'array' AS a, 'null' AS n FROM events")
text("fn_json_keys", "SELECT event_id, array_join(JSON_KEYS(props), ',') AS ks FROM events", "SELECT event_id, array_to_string(json_keys(props), ',') AS ks FROM events")
text("fn_json_array_length", "SELECT event_id, JSON_ARRAY_LENGTH('[1,2,3]') AS n FROM events", "SELECT event_id, CAST(json_array_length('[1,2,3]') AS INT) AS n FROM events")
text("fn_json_set", "SELECT event_id, JSON_SET(props, '$.z', 5) AS j FROM events", f"SELECT event_id, '{{\"k\":' || {K} || ',\"z\":5}}' AS j FROM events")
text("fn_json_remove", "SELECT event_id, JSON_REMOVE(props, '$.k') AS j FROM events", "SELECT event_id, '{}' AS j FROM events")
text("fn_json_merge", "SELECT event_id, JSON_MERGE(props, '{\"a\": 1}') AS j FROM events", f"SELECT event_id, '{{\"a\":1,\"k\":' || {K} || '}}' AS j FROM events")
text("fn_json_array_append", "SELECT event_id, JSON_ARRAY_APPEND('[1]', event_id) AS j FROM events", "SELECT event_id, '[1,' || event_id || ']' AS j FROM events")
text("fn_json_object", "SELECT event_id, JSON_OBJECT('id', event_id) AS j FROM events", "SELECT event_id, '{\"id\":' || event_id || '}' AS j FROM events")
text("fn_json_array", "SELECT event_id, JSON_ARRAY(event_id, user_id) AS j FROM events", "SELECT event_id, '[' || event_id || ',' || user_id || ']' AS j FROM events")

# ---- joins and subqueries
text("join_inner", "SELECT c_name, o_orderkey FROM customer INNER JOIN orders ON c_custkey = o_custkey")
text("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
text("join_right", "SELECT s_suppkey, n_nationkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
text("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < 0")
text("join_literal_on", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND r_regionkey = 2")
text("join_multi", "SELECT r_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
text("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey < 2")
text("semi_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
text("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
text("exists_uncorrelated", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3)")
text("exists_correlated", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
text("not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
text("scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)")

# ---- aggregates
text("agg_global", "SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s, ROUND(AVG(o_totalprice), 4) AS a, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders")
text("agg_count_column", "SELECT COUNT(NULLIF(c_mktsegment, 'BUILDING')) AS n, COUNT(*) AS m FROM customer")
text("agg_empty", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a FROM orders WHERE o_totalprice < 0")
text("agg_group", "SELECT o_orderpriority, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s FROM orders GROUP BY o_orderpriority")
text(
    "agg_group_multi",
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(AVG(l_discount), 6) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
text("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
text("agg_having_sum", "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) >= 2000000")
text("agg_string", "SELECT n_regionkey, GROUP_CONCAT(n_name, ';') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
text("agg_string_default", "SELECT n_regionkey, STRING_AGG(n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
text("agg_over_join", "SELECT n_name, COUNT(*) AS n, ROUND(AVG(c_acctbal), 4) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
text("agg_distinct", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus")
text("group_without_aggregate", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment")
text("agg_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")

# ---- order, limits, distinct, set operations, windows
text("sort_limit_offset", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 10 OFFSET 5")
text("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
text("sort_asc", "SELECT n_name FROM nation ORDER BY n_name")
text("distinct", "SELECT DISTINCT p_brand FROM part")
text("distinct_then_limit", "SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 3")
text("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
text("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
text("union_chain", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_regionkey FROM nation")
text("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
text("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
text("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
text("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
text("window_rank", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn FROM orders")
text("window_lag", "SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders")

# ---- scalar functions: name, dialect expression over a table, DuckDB expression where it differs
for _name, _from, _key, _expr, _duck in (
    ("upper", "customer", "c_custkey", "UPPER(c_name)", None),
    ("lower", "customer", "c_custkey", "LOWER(c_name)", None),
    ("length", "customer", "c_custkey", "LENGTH(c_name)", None),
    ("len", "customer", "c_custkey", "LEN(c_name)", "length(c_name)"),
    ("concat", "customer", "c_custkey", "CONCAT(c_name, '-', c_mktsegment)", None),
    ("substring", "part", "p_partkey", "SUBSTRING(p_name, 2, 4)", None),
    ("substr_low_start", "part", "p_partkey", "SUBSTR(p_name, -3, 4)", "substr(p_name, 1, 4)"),
    ("trim", "part", "p_partkey", "TRIM(CONCAT('  ', p_name, ' '))", "trim('  ' || p_name || ' ')"),
    ("ltrim", "part", "p_partkey", "LTRIM(CONCAT('  ', p_name))", "ltrim('  ' || p_name)"),
    ("rtrim", "part", "p_partkey", "RTRIM(CONCAT(p_name, '  '))", "rtrim(p_name || '  ')"),
    ("replace", "part", "p_partkey", "REPLACE(p_type, 'E', '3')", None),
    ("left", "part", "p_partkey", "LEFT(p_name, 5)", None),
    ("right", "part", "p_partkey", "RIGHT(p_name, 3)", None),
    ("reverse", "part", "p_partkey", "REVERSE(p_name)", None),
    ("repeat", "part", "p_partkey", "REPEAT(p_brand, 2)", None),
    ("abs", "customer", "c_custkey", "ABS(c_acctbal)", None),
    ("round", "customer", "c_custkey", "ROUND(c_acctbal, 1)", None),
    ("ceil", "customer", "c_custkey", "CEIL(c_acctbal)", "CAST(ceil(c_acctbal) AS BIGINT)"),
    ("ceiling", "customer", "c_custkey", "CEILING(c_acctbal)", "CAST(ceil(c_acctbal) AS BIGINT)"),
    ("floor", "customer", "c_custkey", "FLOOR(c_acctbal)", "CAST(floor(c_acctbal) AS BIGINT)"),
    ("mod", "part", "p_partkey", "MOD(p_size, 7)", "p_size % 7"),
    ("mod_zero", "part", "p_partkey", "MOD(p_size, 0)", "CAST(NULL AS INT)"),
    ("power", "part", "p_partkey", "POWER(p_size, 2)", None),
    ("pow", "part", "p_partkey", "ROUND(POW(p_size, -1), 6)", "round(pow(p_size, -1), 6)"),
    ("sqrt", "customer", "c_custkey", "ROUND(SQRT(c_acctbal), 6)", "CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END"),
    ("year", "orders", "o_orderkey", "YEAR(o_orderdate)", "CAST(year(o_orderdate) AS INT)"),
    ("month", "orders", "o_orderkey", "MONTH(o_orderdate)", "CAST(month(o_orderdate) AS INT)"),
    ("day", "orders", "o_orderkey", "DAY(o_orderdate)", "CAST(day(o_orderdate) AS INT)"),
    ("hour", "events", "event_id", "HOUR(ts)", "CAST(hour(ts) AS INT)"),
    ("minute", "events", "event_id", "MINUTE(ts)", "CAST(minute(ts) AS INT)"),
    ("second", "events", "event_id", "SECOND(ts)", "CAST(second(ts) AS INT)"),
    ("extract", "orders", "o_orderkey", "EXTRACT(YEAR, o_orderdate)", "CAST(year(o_orderdate) AS INT)"),
    ("date_add_month", "orders", "o_orderkey", "CAST(DATE_ADD(o_orderdate, 1, 'MONTH'), TEXT)", "strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S')"),
    ("date_add_days", "orders", "o_orderkey", "CAST(DATE_ADD(CAST(o_orderdate, DATE), 10), TEXT)", "strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d')"),
    ("date_sub", "orders", "o_orderkey", "CAST(DATE_SUB(o_orderdate, 2, 'DAY'), TEXT)", "strftime(o_orderdate - INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S')"),
    ("datediff", "lineitem", "l_orderkey", "DATEDIFF(l_shipdate, CAST('1995-01-01', DATE))", "CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INT)"),
    ("coalesce", "customer", "c_custkey", "COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none')", None),
    ("nullif", "customer", "c_custkey", "NULLIF(c_mktsegment, 'BUILDING')", None),
    ("ifnull", "customer", "c_custkey", "IFNULL(NULLIF(c_mktsegment, 'BUILDING'), 'x')", None),
    ("nvl", "customer", "c_custkey", "NVL(NULLIF(c_mktsegment, 'BUILDING'), 'x')", "ifnull(nullif(c_mktsegment, 'BUILDING'), 'x')"),
    ("isnull", "customer", "c_custkey", "ISNULL(NULLIF(c_mktsegment, 'BUILDING'), 'x')", "ifnull(nullif(c_mktsegment, 'BUILDING'), 'x')"),
    ("cast_int", "part", "p_partkey", "CAST(p_brand, INT)", "TRY_CAST(p_brand AS INT)"),
    ("convert_text", "part", "p_partkey", "CONVERT(p_size, TEXT)", "CAST(p_size AS VARCHAR)"),
    ("lpad", "part", "p_partkey", "LPAD(p_brand, 12, '*')", None),
    ("rpad", "part", "p_partkey", "RPAD(p_brand, 12, '*')", None),
    ("instr", "part", "p_partkey", "INSTR(p_brand, '#')", "CAST(instr(p_brand, '#') AS INT)"),
    ("sign", "customer", "c_custkey", "SIGN(c_acctbal)", "CAST(sign(c_acctbal) AS DOUBLE)"),
    ("ln", "part", "p_partkey", "ROUND(LN(p_size), 6)", None),
    ("exp", "part", "p_partkey", "ROUND(EXP(p_size / 50.0), 6)", "round(exp(p_size / 50.0), 6)"),
):
    text(f"fn_{_name}", f"SELECT {_key}, {_expr} AS v FROM {_from}", f"SELECT {_key}, {_duck or _expr} AS v FROM {_from}")


# ---- views, prepared statements, row-level security
@query("view_filter", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def view_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = SqlSession(spark, sf_dir)
    session.create_view("builders", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
    return session.sql("SELECT c_custkey, c_name FROM builders WHERE c_acctbal > 0")


@query("prepared_param", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def prepared_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = SqlSession(spark, sf_dir)
    session.prepare("big", "SELECT o_orderkey FROM orders WHERE o_orderstatus = $1 AND o_totalprice > $2")
    return session.execute("big", "F", 200000)


@query("rls_filter", "SELECT COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY'")
def rls_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = SqlSession(spark, sf_dir, row_filters={"customer": "c_mktsegment = 'MACHINERY'"})
    return session.sql("SELECT COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey")



@query("rls_join_view", "SELECT n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0 GROUP BY n_name")
def rls_join_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = SqlSession(spark, sf_dir, row_filters={"customer": "c_mktsegment = 'MACHINERY'"})
    session.sql("CREATE VIEW rich AS SELECT * FROM customer c WHERE c.c_acctbal > 0")
    return session.sql("SELECT n_name, COUNT(*) AS n FROM rich, nation WHERE c_nationkey = n_nationkey GROUP BY n_name")


# ---- names, commas, literals, theta and natural joins, windows, what is only lexed elsewhere
text("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'from nation, region'")
text("literal_with_from", "SELECT n_nationkey, 'from nation, region {x}' AS t FROM nation WHERE n_name <> 'join region'")
text("join_natural", "SELECT r_name, n_name FROM (SELECT r_regionkey AS k, r_name FROM region) a NATURAL JOIN (SELECT n_regionkey AS k, n_name FROM nation) b")
text("join_using", "SELECT a.r_name, b.n_name FROM (SELECT r_regionkey AS k, r_name FROM region) a JOIN (SELECT n_regionkey AS k, n_name FROM nation) b USING (k)")
text("join_theta", "SELECT a.p_partkey AS k, COUNT(*) AS n FROM part a JOIN supplier s ON a.p_retailprice < s.s_acctbal WHERE a.p_size < 5 GROUP BY a.p_partkey")
text("join_range", "SELECT r_name, COUNT(*) AS n FROM customer JOIN region ON c_acctbal BETWEEN r_regionkey * 1000 AND r_regionkey * 1000 + 500 GROUP BY r_name")
text("with_clause", "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE s > 1500000) SELECT c_name FROM customer JOIN top ON c_custkey = o_custkey")
text("derived_table", "SELECT k, n FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey) t WHERE n > 3")
text("json_arrow_where", "SELECT event_id FROM events WHERE CAST(props ->> 'k', INT) > 50 AND props -> 'k' IS NOT NULL", f"SELECT event_id FROM events WHERE {K} > 50")
text("json_dotted_key", "SELECT event_id, JSON_SET('{\"a.b\": 1}', '$.c', event_id) ->> 'a.b' AS v FROM events", "SELECT event_id, '1' AS v FROM events")
text("json_keys_of_array", "SELECT event_id, '[1]' ?| 'a,b' AS x, '[1]' ?& 'a' AS y, '3' ? 'a' AS z FROM events", "SELECT event_id, false AS x, false AS y, false AS z FROM events")
text("json_merge_nested", "SELECT event_id, JSON_MERGE('{\"a\": {\"x\": 1}, \"b\": 2}', '{\"a\": [1, null]}') AS j, JSON_MERGE(props, '[1]') AS n FROM events", "SELECT event_id, '{\"a\":[1,null],\"b\":2}' AS j, CAST(NULL AS VARCHAR) AS n FROM events")
text("agg_approx", "SELECT o_orderstatus, abs(approx_count_distinct(o_custkey) - COUNT(DISTINCT o_custkey)) <= 0.2 * COUNT(DISTINCT o_custkey) + 2 AS near FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, true AS near FROM orders GROUP BY o_orderstatus")
text("agg_cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
text("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
_BY = "PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey"
for _name, _call in (
    ("rank_ties", "RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)"),
    ("dense_rank", "DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)"),
    ("percent_rank", "ROUND(PERCENT_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6)"),
    ("ntile", f"NTILE(3) OVER ({_BY})"),
    ("lead", f"LEAD(o_orderkey, 2) OVER ({_BY})"),
    ("first_value", f"FIRST_VALUE(o_orderkey) OVER ({_BY})"),
    ("last_value", f"LAST_VALUE(o_orderkey) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    ("nth_value", f"NTH_VALUE(o_orderkey, 2) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    ("rows_frame", f"ROUND(SUM(o_totalprice) OVER ({_BY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2)"),
    ("range_frame", "COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING)"),
):
    text(f"window_{_name}", f"SELECT o_orderkey, CAST({_call} AS DOUBLE) AS v FROM orders")
for _name, _from, _key, _expr, _duck in (
    ("position", "part", "p_partkey", "POSITION('#' IN p_brand)", "CAST(position('#' IN p_brand) AS INT)"),
    ("locate", "part", "p_partkey", "LOCATE('#', p_brand)", "CAST(instr(p_brand, '#') AS INT)"),
    ("space", "part", "p_partkey", "CONCAT(p_brand, SPACE(3), '|')", "p_brand || '   |'"),
    ("ascii", "part", "p_partkey", "ASCII(p_brand)", "CAST(ascii(p_brand) AS INT)"),
    ("char_length", "part", "p_partkey", "CHAR_LENGTH(p_name) + CHARACTER_LENGTH(p_brand)", "CAST(length(p_name) + length(p_brand) AS INT)"),
    ("log", "part", "p_partkey", "ROUND(LOG(p_size) + LOG10(p_size) + LOG2(p_size), 5)", "round(ln(p_size) + log10(p_size) + log2(p_size), 5)"),
    ("pi", "part", "p_partkey", "ROUND(PI() * p_size, 6)", "round(pi() * p_size, 6)"),
    ("random", "part", "p_partkey", "RAND() >= 0 AND RANDOM() < 1", "true"),
    ("date_format", "orders", "o_orderkey", "DATE_FORMAT(o_orderdate, '%Y/%m/%d')", "strftime(o_orderdate, '%Y/%m/%d')"),
    ("strftime", "orders", "o_orderkey", "STRFTIME(o_orderdate, '%d of %m %H:%M')", "strftime(o_orderdate, '%d of %m %H:%M')"),
    ("time_format", "events", "event_id", "TIME_FORMAT(ts, '%H:%M:%S')", "strftime(ts, '%H:%M:%S')"),
    ("to_char", "orders", "o_orderkey", "TO_CHAR(o_orderdate, 'YYYY-MM-DD HH24:MI')", "strftime(o_orderdate, '%Y-%m-%d %H:%M')"),
    ("to_date", "orders", "o_orderkey", "CAST(TO_DATE('02.03.1997', 'DD.MM.YYYY'), TEXT)", "'1997-03-02'"),
    ("to_timestamp", "orders", "o_orderkey", "CAST(TO_TIMESTAMP('1997-03-02 04:05:06'), TEXT)", "'1997-03-02 04:05:06'"),
    ("date_trunc", "orders", "o_orderkey", "DATE_FORMAT(DATE_TRUNC('month', o_orderdate), '%Y-%m-%d')", "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')"),
    ("date_part", "orders", "o_orderkey", "CAST(DATE_PART('year', o_orderdate), INT)", "CAST(year(o_orderdate) AS INT)"),
    ("typeof", "part", "p_partkey", "TYPEOF(p_size)", "'int'"),
    ("now", "part", "p_partkey", "NOW() >= CURRENT_DATE AND CURRENT_TIMESTAMP() >= CURRENT_DATE() AND LENGTH(UUID()) = 36", "true"),
    ("current_time", "part", "p_partkey", "CURRENT_TIME() IS NOT NULL", "true"),
    ("cast_float", "part", "p_partkey", "CAST(CAST(p_retailprice, TEXT), DOUBLE)", "p_retailprice"),
    ("cast_bad", "part", "p_partkey", "CAST('12x', INT)", "CAST(NULL AS INT)"),
    ("cast_bool", "part", "p_partkey", "CAST('true', BOOLEAN)", "true"),
    ("cast_date", "orders", "o_orderkey", "CAST(CAST(o_orderdate, DATE), TEXT)", "strftime(o_orderdate, '%Y-%m-%d')"),
    ("cast_decimal", "part", "p_partkey", "CAST(CAST('1.50', DECIMAL) AS DOUBLE)", "CAST(1.5 AS DOUBLE)"),
):
    text(f"fn_{_name}", f"SELECT {_key}, {_expr} AS v FROM {_from}", f"SELECT {_key}, {_duck or _expr} AS v FROM {_from}")


def queries() -> dict:
    from tessera.plans import changing

    return {name: fn for name, (fn, _) in (REGISTRY | changing.REGISTRY).items()}


def oracle_sql() -> dict[str, str]:
    from tessera.plans import changing

    return {name: sql for name, (_, sql) in (REGISTRY | changing.REGISTRY).items() if sql}
