"""One query for each relational operator of the inventory: projection, filter, join, aggregation, OVER windows, order, set operations and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.operators.asof import asof_join
from millrace.plans.dialect import OTHER, query, render
from millrace.spec import QuerySpec

TEXTS = {
    # projection, filter, predicates
    "pf_star": "SELECT * FROM nation",
    "pf_columns": "SELECT o_orderkey, o_custkey, o_orderdate FROM orders",
    "pf_alias": "SELECT c_custkey AS id, c_acctbal AS balance FROM customer",
    "pf_arithmetic": "SELECT event_id, round(CAST(0.908 AS DOUBLE) * value, 4) AS scaled FROM events",
    "pf_add": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_orderkey + l_quantity, 2) AS added FROM lineitem",
    "pf_compare_value": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_partkey >= l_suppkey AS ge FROM lineitem",
    "pf_modulo": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 123 = 0",
    "pf_mod_function": "SELECT o_orderkey FROM orders WHERE mod(o_orderkey, 77) = 5",
    "pf_or_chain": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY' OR c_mktsegment = 'FURNITURE'",
    "pf_range_and": "SELECT p_partkey FROM part WHERE p_size < 20 AND p_retailprice > 910",
    "pf_between": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'",
    "pf_between_arithmetic": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_discount BETWEEN CAST(0.06 AS DOUBLE) - CAST(0.0101 AS DOUBLE) AND CAST(0.06 AS DOUBLE) + CAST(0.0101 AS DOUBLE)",
    "pf_in": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)",
    "pf_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%' OR p_name LIKE '%ring' OR p_name LIKE '%e%o%'",
    "pf_not_like": "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%l%'",
    "pf_not_equal": "SELECT p_partkey, p_brand FROM part WHERE p_brand <> 'Brand#12'",
    "pf_columns_compared": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey < l_linenumber * 10",
    "pf_or_of_ands": "SELECT l.l_orderkey, l.l_linenumber, p.p_partkey FROM lineitem l JOIN part p ON (p.p_partkey = l.l_partkey AND p.p_size = 5 AND l.l_quantity < 10) OR (p.p_partkey = l.l_partkey AND p.p_size = 7 AND l.l_quantity > 45)",
    "pf_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "pf_cast": "SELECT s_suppkey, CAST(floor(s_acctbal) AS INT) AS whole FROM supplier",
    "pf_ratio": "SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 6) AS open_share FROM lineitem GROUP BY l_returnflag",
    # joins
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey",
    "join_interval": lambda x: f"""WITH a AS (SELECT DISTINCT a_id, category, a_date_time, expires FROM auction), b AS (SELECT DISTINCT bid_id, auction, b_date_time FROM bid)
SELECT b.bid_id, a.a_id, a.category FROM a JOIN b ON b.auction = a.a_id AND b.b_date_time >= a.a_date_time AND b.b_date_time <= a.expires""",
    "join_multi_key": "SELECT a.l_orderkey, a.l_linenumber, b.n FROM lineitem a JOIN (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey) b ON b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey",
    "join_scalar_aggregate": "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders JOIN (SELECT max(o_totalprice) AS top FROM orders) m ON m.top = o_totalprice",
    "join_aggregates": "SELECT a.user_id, a.n, b.kinds FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) a JOIN (SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id) b ON a.user_id = b.user_id",
    "join_deduplicated": "SELECT p.o_custkey, p.o_orderstatus FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) p JOIN (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 5000) q ON q.c_custkey = p.o_custkey",
    "join_static_side": "SELECT e.event_id, n.n_name FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25",
    "join_comma": "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c, nation n, region r WHERE n.n_nationkey = c.c_nationkey AND r.r_regionkey = n.n_regionkey",
    "join_comma_many": """SELECT r.r_name, b.n_name AS seller_nation, p.p_brand, count(*) AS n, round(sum(l.l_extendedprice), 2) AS price
FROM part p, supplier s, lineitem l, orders o, customer c, nation a, nation b, region r
WHERE p.p_partkey = l.l_partkey AND s.s_suppkey = l.l_suppkey AND l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = a.n_nationkey AND a.n_regionkey = r.r_regionkey AND s.s_nationkey = b.n_nationkey AND p.p_size > 40
GROUP BY r.r_name, b.n_name, p.p_brand""",
    "join_self": "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000",
    "join_right": "SELECT o.o_orderkey, c.c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 400000) o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_full": "SELECT a.k AS a_k, b.k AS b_k FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 450000) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000) b ON a.k = b.k",
    "join_cross": "SELECT r.r_name, s.l_returnflag FROM region r CROSS JOIN (SELECT DISTINCT l_returnflag FROM lineitem) s",
    "join_semi": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')",
    "join_anti": "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey <> o.o_custkey)",
    "join_in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))",
    "join_not_in": "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)",
    "join_scalar_subquery": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)",
    "join_correlated_scalar": "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "join_theta": "SELECT o.o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate + INTERVAL '100' DAY)",
    # aggregation
    "agg_grouped": "SELECT l_shipdate, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_shipdate",
    "agg_global": "SELECT count(*) AS n, count(category) AS with_category, min(initial_bid) AS low, max(reserve) AS high, round(avg(initial_bid), 4) AS mean FROM auction",
    "agg_count_distinct": "SELECT count(DISTINCT bidder) AS bidders, count(DISTINCT auction) AS auctions FROM bid",
    "agg_count_distinct_grouped": "SELECT p_brand, p_type, count(DISTINCT p_size) AS sizes FROM part GROUP BY p_brand, p_type",
    "agg_min_max": "SELECT auction, min(price) AS low, max(price) AS high, min(b_date_time) AS first_at, max(b_date_time) AS last_at FROM bid GROUP BY auction",
    "agg_nested": "SELECT event_type, round(avg(n), 4) AS avg_n, max(n) AS max_n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id) t GROUP BY event_type",
    "agg_keys_only": "SELECT c_nationkey, c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment",
    "agg_having": "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 3000000",
    "agg_having_subquery": "SELECT l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > (SELECT sum(l_quantity) / count(DISTINCT l_suppkey) FROM lineitem)",
    "agg_conditional": "SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 2) AS spent FROM events GROUP BY user_id",
    "agg_pipeline": "SELECT p_type, max(p_size) AS big, min(p_retailprice) AS cheap FROM part WHERE p_retailprice < 1500 GROUP BY p_type ORDER BY p_type LIMIT 3",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "agg_stddev": "SELECT event_type, round(stddev_samp(value), 4) AS sd, round(var_pop(value), 3) AS var FROM events GROUP BY event_type",
    "agg_collected": lambda x: f"SELECT o_custkey, {x.joined('o_orderkey')} AS orders FROM orders GROUP BY o_custkey",
    "agg_approx_distinct": lambda x: f"SELECT abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.25 * count(DISTINCT o_custkey) AS near FROM orders",
    # OVER windows
    "win_rownum_top1": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn FROM orders) t WHERE rn = 1",
    "win_rownum_topn_avg": "SELECT o_custkey, round(avg(o_totalprice), 2) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn <= 10 GROUP BY o_custkey",
    "win_frame_avg": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), 6) AS running FROM events",
    "win_rank": "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d FROM part",
    "win_ntile": "SELECT p_partkey, CAST(ntile(7) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS BIGINT) AS part FROM part",
    "win_first_last": "SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_order, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_order FROM orders",
    "win_range": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS near FROM part",
    "win_lag_lead": "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    # order, limit, sets
    "sort_limit_nulls": "SELECT a_id, category, seller FROM (SELECT DISTINCT a_id, category, seller FROM auction) t ORDER BY category ASC NULLS LAST, seller DESC NULLS FIRST, a_id LIMIT 50",
    "sort_join": "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 200",
    "sort_multi_limit": "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type ORDER BY n DESC, p_brand, p_type LIMIT 25",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "set_except": "SELECT p_brand, p_size FROM part EXCEPT SELECT p_brand, p_size FROM part WHERE p_type = 'PROMO'",
    "sub_column_aliases": "SELECT t.customer, t.orders FROM (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey) AS t (customer, orders)",
    # functions
    "fn_extract_year": "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m FROM orders",
    "fn_date_interval": "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-01-01' + INTERVAL '3' MONTH AND o_orderdate < DATE '1996-01-01' + INTERVAL '1' YEAR",
    "fn_substring": "SELECT c_custkey, substring(c_name FROM 10 FOR 9) AS part FROM customer",
    "fn_date_format": lambda x: f"SELECT event_id, {x.text('ts', 'yyyy-MM-dd')} AS dt, {x.text('ts', 'HH:mm')} AS hm FROM events",
    "fn_string_date_compare": "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1997-05-01' AND o_orderdate < '1997-06-01'",
    "fn_now": lambda x: f"SELECT event_id, ts < {x.now()} AS past, {x.now()} = {x.now()} AS steady FROM events",
    "fn_tumble": lambda x: f"SELECT {x.us('window_start')} AS start_us, {x.us('window_end')} AS end_us, count(*) AS n FROM ({x.tumble('ts', 7)}) t GROUP BY window_start, window_end",
    "fn_hop": lambda x: f"SELECT {x.us('window_start')} AS start_us, {x.us('window_end')} AS end_us, count(*) AS n FROM ({x.hop_windows('ts', 6, 2)}) t GROUP BY window_start, window_end",
    "fn_session": lambda x: f"SELECT user_id, {x.us('session_start')} AS start_us, {x.us('session_end')} AS end_us, n FROM ({x.session('events', 'user_id', 'ts', 6)}) t",
    "fn_math_text": lambda x: f"SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, abs(p_size - 25) AS away, upper(p_brand) AS brand, length(p_name) AS size, {x.regex_replace('p_name', '[aeiou]')} AS bare FROM part",
    # the four micro operators
    "op_filter": "SELECT bid_id, auction, price FROM (SELECT DISTINCT bid_id, auction, price FROM bid) b WHERE auction % 123 = 0",
    "op_join": "SELECT b.bid_id, a.category FROM (SELECT DISTINCT bid_id, auction FROM bid) b JOIN (SELECT DISTINCT a_id, category FROM auction) a ON a.a_id = b.auction",
    "op_groupby": "SELECT auction, count(*) AS n FROM (SELECT DISTINCT bid_id, auction FROM bid) b GROUP BY auction",
    "op_sort": "SELECT bid_id, price FROM (SELECT DISTINCT bid_id, price FROM bid) b ORDER BY price NULLS LAST, bid_id",
}


def join_asof(spark: SparkSession, d: str) -> DataFrame:
    """Every event with its user's last click at or before it."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    clicks = e.where("event_type = 'click'").select("user_id", "us", "event_id")
    return asof_join(e.where("event_type != 'click'"), clicks, "user_id", "us", "event_id", 24 * 3_600_000_000).select("event_id", F.col("match.event_id").alias("click"))


def fn_array_map(spark: SparkSession, d: str) -> DataFrame:
    """Functions of arrays and maps."""
    o = table(spark, d, "orders").select("o_orderkey", F.split("o_orderpriority", "-").alias("a"))
    m = F.map_from_arrays(F.array(F.lit("rank"), F.lit("name")), F.slice("a", 1, 2))
    return o.select("o_orderkey", F.size("a").cast("bigint").alias("parts"), F.element_at(m, "rank").alias("rank"), F.array_contains("a", "LOW").alias("low"), F.array_join(F.reverse("a"), "/").alias("turned"))


def fn_json_base64(spark: SparkSession, d: str) -> DataFrame:
    """A JSON column taken through base64 and back, and read with a declared schema."""
    e = table(spark, d, "events").select("event_id", F.base64(F.col("props").cast("binary")).alias("b"))
    return e.select("event_id", F.from_json(F.unbase64("b").cast("string"), "k bigint").getField("k").alias("k"))


def ddl_view(spark: SparkSession, d: str) -> DataFrame:
    """A script of several statements: a view with named columns, a query over it, and its removal."""
    orders = {"shown_orders": table(spark, d, "orders")}
    made = QuerySpec("ddl", "CREATE OR REPLACE TEMP VIEW spent (who, total) AS SELECT o_custkey, round(sum(o_totalprice), 2) FROM shown_orders GROUP BY o_custkey; SELECT who, total FROM spent WHERE total > 2000000;", orders).plan(spark)
    spark.sql("DROP VIEW spent")
    return made


QUERIES = {k: query(v) for k, v in TEXTS.items()} | {f.__name__: f for f in (join_asof, fn_array_map, fn_json_base64, ddl_view)}
SQL = {k: render(v, OTHER) for k, v in TEXTS.items()} | {
    "fn_json_base64": "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events",
    "ddl_view": "SELECT o_custkey AS who, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING round(sum(o_totalprice), 2) > 2000000",
    "join_asof": """SELECT event_id, click FROM (
  SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END, event_id ROWS UNBOUNDED PRECEDING) AS click
  FROM events) WHERE event_type != 'click'""",
    "fn_array_map": "SELECT o_orderkey, len(a) AS parts, a[1] AS rank, list_contains(a, 'LOW') AS low, array_to_string(list_reverse(a), '/') AS turned FROM (SELECT o_orderkey, string_split(o_orderpriority, '-') AS a FROM orders)",
}
