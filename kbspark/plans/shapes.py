"""The shapes of statements that users send, run through the guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.events import fold_events
from kbspark.plans.execute import MAX_ROWS, guarded, masked, scoped
from kbspark.plans.identity import principal
from kbspark.sources.tables import table

_TABLES = ("customer", "orders", "lineitem", "part", "supplier", "nation", "region", "events")

#: Statements that Spark and DuckDB read alike.
STATEMENTS = {
    "count_all": "SELECT count(*) AS n FROM customer",
    "count_where": "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0",
    "date_half_open": "SELECT count(*) AS n FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01'",
    "count_distinct": "SELECT count(DISTINCT o_custkey) AS n FROM orders",
    "group_in_pair": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment",
    "group_count": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "group_avg_round": "SELECT c_mktsegment, round(avg(c_acctbal), 2) AS mean FROM customer GROUP BY c_mktsegment",
    "group_max": "SELECT c_nationkey, max(c_acctbal) AS most FROM customer GROUP BY c_nationkey",
    "group_sorted": "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10",
    "top_group": "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus ORDER BY total DESC LIMIT 1",
    "top_row": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 1",
    "top3_rows": "SELECT s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 3",
    "sum_all": "SELECT round(sum(l_quantity), 2) AS total FROM lineitem",
    "avg_all": "SELECT round(avg(o_totalprice), 2) AS mean FROM orders",
    "min_max": "SELECT min(p_retailprice) AS low, max(p_retailprice) AS high FROM part",
    "avg_where": "SELECT round(avg(l_discount), 4) AS mean FROM lineitem WHERE l_returnflag = 'R'",
    "point_lookup": "SELECT c_name, c_mktsegment FROM customer WHERE c_custkey = 42",
    "year_group": "SELECT cast(extract(year FROM o_orderdate) AS bigint) AS year, count(*) AS n FROM orders GROUP BY 1",
    "scalar_subquery_gt_avg": "SELECT count(*) AS n FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "top1_per_group": "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) AS t WHERE rn = 1",
    "having_avg": "SELECT c_nationkey, round(avg(c_acctbal), 2) AS mean FROM customer GROUP BY c_nationkey HAVING avg(c_acctbal) > 4500",
    "cte_rank": "WITH t AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) SELECT c_nationkey, n, cast(rank() OVER (ORDER BY n DESC) AS bigint) AS place FROM t",
    "correlated_avg": "SELECT count(*) AS n FROM orders AS o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders AS i WHERE i.o_orderstatus = o.o_orderstatus)",
    "diff_two_counts": "SELECT (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') - (SELECT count(*) FROM customer WHERE c_mktsegment = 'MACHINERY') AS difference",
    "product_sum": "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag",
    "inner_join": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "left_join": "SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name",
    "full_join": "SELECT count(*) AS n, count(c_custkey) AS customers, count(o_orderkey) AS orders FROM customer FULL JOIN orders ON o_custkey = c_custkey",
    "semi_join": "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "anti_join": "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "in_subquery": "SELECT count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)",
    "union_inside": "SELECT kind, count(*) AS n FROM (SELECT 'customer' AS kind FROM customer UNION ALL SELECT 'supplier' FROM supplier) AS t GROUP BY kind",
    "intersect_inside": "SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) AS t",
    "except_inside": "SELECT count(*) AS n FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem) AS t",
    "case_buckets": "SELECT CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'middle' ELSE 'high' END AS band, count(*) AS n FROM orders GROUP BY 1",
    "running_total": "SELECT event_type, day, n, cast(sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS upto FROM (SELECT event_type, cast(ts AS date) AS day, count(*) AS n FROM events GROUP BY 1, 2) AS t",
    "lag_lead": "SELECT year, n, lag(n) OVER (ORDER BY year) AS before, lead(n) OVER (ORDER BY year) AS after FROM (SELECT cast(extract(year FROM o_orderdate) AS bigint) AS year, count(*) AS n FROM orders GROUP BY 1) AS t",
    "rollup_totals": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "like_between": "SELECT count(*) AS n FROM part WHERE p_name LIKE '%ring%' AND p_size BETWEEN 5 AND 25",
    "month_trunc": "SELECT cast(date_trunc('month', l_shipdate) AS date) AS month, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1",
    "right_join": "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name",
    "using_join": "SELECT n_name, count(*) AS n FROM nation JOIN (SELECT c_nationkey AS n_nationkey FROM customer) AS c USING (n_nationkey) GROUP BY n_name",
    "natural_join": "SELECT n_regionkey, count(*) AS n FROM nation NATURAL JOIN (SELECT s_nationkey AS n_nationkey, s_suppkey FROM supplier) AS s GROUP BY n_regionkey",
    "lateral_join": "SELECT n_name, most FROM nation, LATERAL (SELECT max(c_acctbal) AS most FROM customer WHERE c_nationkey = n_nationkey) AS x",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    "cube_totals": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "ntile": "SELECT c_nationkey, tile, count(*) AS n, max(c_acctbal) AS most FROM (SELECT c_nationkey, c_acctbal, cast(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS bigint) AS tile FROM customer) AS t GROUP BY c_nationkey, tile",
    "edge_values": "SELECT DISTINCT o_custkey, first_value(o_orderkey) OVER w AS first_order, last_value(o_orderkey) OVER w AS last_order, nth_value(o_orderkey, 2) OVER w AS second_order FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "range_frame": "SELECT event_type, day, cast(sum(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL '6' DAY PRECEDING AND CURRENT ROW) AS bigint) AS week FROM (SELECT event_type, cast(ts AS date) AS day, count(*) AS n FROM events GROUP BY 1, 2) AS t",
    "rank_shares": "SELECT s_nationkey, s_suppkey, cast(dense_rank() OVER w AS bigint) AS place, round(percent_rank() OVER w, 6) AS share, round(cume_dist() OVER w, 6) AS upto FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)",
}
#: Statements that DuckDB words otherwise: Spark's, and DuckDB's.
WORDED = {
    "integer_division": ("SELECT o_custkey DIV 7 AS part, count(*) AS n, sum(o_orderkey) DIV count(*) AS mean FROM orders GROUP BY 1", "SELECT o_custkey // 7 AS part, count(*) AS n, CAST(sum(o_orderkey) // count(*) AS BIGINT) AS mean FROM orders GROUP BY 1"),
    "row_json": ("SELECT c_custkey, to_json(struct(c_custkey, c_name, c_mktsegment)) AS row FROM customer", "SELECT c_custkey, CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_mktsegment': c_mktsegment}) AS VARCHAR) AS row FROM customer"),
    "pivot": ("SELECT * FROM (SELECT l_returnflag, l_linestatus FROM lineitem) PIVOT (count(*) FOR l_linestatus IN ('O' AS open, 'F' AS filled))", "SELECT l_returnflag, nullif(count(*) FILTER (l_linestatus = 'O'), 0) AS open, nullif(count(*) FILTER (l_linestatus = 'F'), 0) AS filled FROM lineitem GROUP BY 1"),
}


def _statement(sql: str):
    named = [t for t in _TABLES if t in sql]
    return lambda spark, folder: guarded(spark, sql, {t: table(spark, folder, t) for t in named})


def headline(spark: SparkSession, folder: str) -> DataFrame:
    """Two segments and their difference, in one guarded statement."""
    sql = """SELECT count_if(c_mktsegment = 'BUILDING') AS building, count_if(c_mktsegment = 'MACHINERY') AS machinery,
    count_if(c_mktsegment = 'BUILDING') - count_if(c_mktsegment = 'MACHINERY') AS difference FROM customer"""
    return guarded(spark, sql, {"customer": table(spark, folder, "customer")})


def q_tenant_rows(spark: SparkSession, folder: str) -> DataFrame:
    own = scoped(table(spark, folder, "documents", "tenant_id", "doc_type", "n_chars"), principal("tn-harvel", "analyst"))
    return guarded(spark, "SELECT doc_type, count(*) AS n, sum(n_chars) AS chars, count(DISTINCT tenant_id) AS tenants FROM documents GROUP BY doc_type", {"documents": own})


def q_masked(spark: SparkSession, folder: str) -> DataFrame:
    rows = fold_events(table(spark, folder, "sql_audit", "id", "loaded_at", "actor", "tenant_id"), "id", "loaded_at", ["actor", "tenant_id"])
    return masked(rows, {"ACTOR"}).groupBy("actor", "tenant_id").agg(F.count(F.lit(1)).alias("n"))


def q_probe(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that a capped fetch reads: one more than it gives."""
    return guarded(spark, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", {"orders": table(spark, folder, "orders")}).limit(MAX_ROWS + 1)


QUERIES = {"headline": headline, **{f"shape_{n}": _statement(s) for n, s in STATEMENTS.items()}, **{f"shape_{n}": _statement(s) for n, (s, _) in WORDED.items()}, "tenant_rows": q_tenant_rows, "masked_columns": q_masked, "truncation_probe": q_probe}
SQL = {
    "headline": "SELECT count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery, count(*) FILTER (c_mktsegment = 'BUILDING') - count(*) FILTER (c_mktsegment = 'MACHINERY') AS difference FROM customer",
    **{f"shape_{n}": s for n, s in STATEMENTS.items()},
    **{f"shape_{n}": s for n, (_, s) in WORDED.items()},
    "tenant_rows": "SELECT doc_type, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT tenant_id) AS tenants FROM documents WHERE tenant_id IS NULL OR tenant_id = 'tn-harvel' GROUP BY doc_type",
    "masked_columns": "SELECT CASE WHEN actor IS NOT NULL THEN '***' END AS actor, tenant_id, count(*) AS n FROM (SELECT * FROM sql_audit QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1) GROUP BY 1, 2",
    "truncation_probe": f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT {MAX_ROWS + 1}",
}
