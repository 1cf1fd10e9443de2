"""Queries of the SQL surface: one text each, or one for this engine and one in DuckDB's spelling."""

from __future__ import annotations

#: There is no table of parts and suppliers; the pairs that were sold stand in for it.
_PS = "ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, sum(l_quantity) AS ps_availqty, min(l_extendedprice) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)"
_REV = "l_extendedprice * (1 - l_discount)"

SQL: dict[str, str | tuple[str, str]] = {
    # reporting queries over orders and line items
    "q01_pricing_summary": f"""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum({_REV}), 2) AS sum_disc_price, round(sum({_REV} * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 8) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= date '2001-12-01' - interval '90' day
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "q02_minimum_cost": f"""
WITH {_PS}
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand
FROM part, supplier, ps, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND p_type LIKE '%M' AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
  AND ps_supplycost = (SELECT min(ps_supplycost) FROM ps, supplier, nation, region
                       WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "q03_shipping_priority": f"""
SELECT l_orderkey, round(sum({_REV}), 2) AS revenue, o_orderdate, o_orderpriority
FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < date '1998-03-15' AND l_shipdate > date '1998-03-15'
GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "q04_order_priority": """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= date '1997-07-01' AND o_orderdate < date '1997-07-01' + interval '3' month
  AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "q05_local_supplier": f"""
SELECT n_name, round(sum({_REV}), 2) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= date '1996-01-01' AND o_orderdate < date '1996-01-01' + interval '1' year
GROUP BY n_name ORDER BY revenue DESC""",
    "q06_forecast": """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1996-01-01' + interval '1' year AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""",
    "q07_volume_shipping": f"""
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue
FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS bigint) AS l_year, {_REV} AS volume
      FROM supplier, lineitem, orders, customer, nation n1, nation n2
      WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
        AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6'))
        AND l_shipdate BETWEEN date '1996-01-01' AND date '1997-12-31') shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "q08_market_share": f"""
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_2' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share
FROM (SELECT CAST(extract(year FROM o_orderdate) AS bigint) AS o_year, {_REV} AS volume, n2.n_name AS nation
      FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
      WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
        AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN date '1995-01-01' AND date '1998-12-31' AND p_type = 'ECONOMY') all_nations
GROUP BY o_year ORDER BY o_year""",
    "q09_product_profit": f"""
WITH {_PS}
SELECT nation, o_year, round(sum(amount), 2) AS sum_profit
FROM (SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS bigint) AS o_year, {_REV} - ps_supplycost * l_quantity AS amount
      FROM part, supplier, lineitem, ps, orders, nation
      WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%ring%') profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    "q10_returned": f"""
SELECT c_custkey, c_name, round(sum({_REV}), 2) AS revenue, c_acctbal, n_name
FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= date '1996-10-01' AND o_orderdate < date '1996-10-01' + interval '3' month
  AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q11_important_stock": f"""
WITH {_PS}
SELECT ps_partkey, round(sum(ps_supplycost * ps_availqty), 2) AS worth
FROM ps, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_3'
GROUP BY ps_partkey
HAVING sum(ps_supplycost * ps_availqty) > (SELECT sum(ps_supplycost * ps_availqty) * 0.001 FROM ps, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_3')
ORDER BY worth DESC, ps_partkey""",
    "q12_priority_by_status": """
SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS bigint) AS high_line_count,
       CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS bigint) AS low_line_count
FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= date '1996-01-01' AND l_shipdate < date '1996-01-01' + interval '1' year AND o_orderdate < l_shipdate
GROUP BY l_linestatus ORDER BY l_linestatus""",
    "q13_customer_distribution": """
SELECT c_count, count(*) AS custdist
FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) c_orders
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "q14_promo": f"""
SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= date '1996-09-01' AND l_shipdate < date '1996-09-01' + interval '1' month""",
    "q15_top_supplier": f"""
WITH revenue0 AS (SELECT l_suppkey AS supplier_no, round(sum({_REV}), 2) AS total_revenue FROM lineitem
                  WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1996-01-01' + interval '3' month GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue0
WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue0) ORDER BY s_suppkey""",
    "q16_parts_suppliers": f"""
WITH {_PS}
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt
FROM ps, part
WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "q17_small_quantity": """
SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND p_type = 'MEDIUM'
  AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""",
    "q18_large_orders": """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS total_quantity
FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 230) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "q19_discounted_revenue": f"""
SELECT round(sum({_REV}), 2) AS revenue FROM lineitem, part
WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 25)
   OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 30)
   OR (p_partkey = l_partkey AND p_brand = 'Brand#4' AND l_quantity >= 20 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 35)""",
    "q20_part_promotion": f"""
WITH {_PS}
SELECT s_suppkey, s_name FROM supplier, nation
WHERE s_suppkey IN (SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%')
                    AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= date '1996-01-01'))
  AND s_nationkey = n_nationkey AND n_regionkey = 3 ORDER BY s_name""",
    "q21_waiting": """
SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
  AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
  AND s_nationkey = n_nationkey AND n_regionkey = 1
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "q22_sales_opportunity": """
SELECT segment, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal
FROM (SELECT substring(c_mktsegment, 1, 2) AS segment, c_acctbal FROM customer
      WHERE substring(c_mktsegment, 1, 2) IN ('BU', 'MA', 'HO')
        AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00)
        AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')) custsale
GROUP BY segment ORDER BY segment""",
    # joins
    "sql_join_inner": "SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey = r_regionkey",
    "sql_join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
    "sql_join_right": "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    "sql_join_full": "SELECT a.doc_id AS doc_id, b.doc_id AS label_id, b.toxic AS toxic FROM documents a FULL OUTER JOIN labels b ON a.doc_id = b.doc_id + 300",
    "sql_join_cross": "SELECT a.r_name AS a_name, b.r_name AS b_name FROM region a CROSS JOIN region b",
    "sql_join_comma": "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey",
    "sql_join_natural": "SELECT item_id, n FROM benchmark NATURAL JOIN (SELECT item_id, length(text) AS n FROM benchmark) b",
    "sql_join_using": "SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)",
    "sql_join_self": "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_join_theta": "SELECT a.n_name AS a_name, b.r_name AS b_name FROM nation a JOIN region b ON a.n_nationkey > b.r_regionkey * 5",
    "sql_join_multiway": "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY r_name",
    "sql_join_left_is_null": "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL",
    "sql_semi_join": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "sql_anti_join": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    # aggregates
    "sql_count_star": "SELECT count(*) AS n FROM lineitem",
    "sql_count_kinds": "SELECT count(*) AS n, count(o_orderkey) AS n_key, count(DISTINCT o_custkey) AS n_cust, CAST(sum(o_custkey) AS bigint) AS total, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders",
    "sql_stddev": "SELECT o_orderstatus, round(stddev(o_totalprice), 4) AS sd, round(variance(o_totalprice), 2) AS var, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderstatus",
    "sql_having": "SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 7) AS mean FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND avg(o_totalprice) > 100000",
    "sql_group_expression": "SELECT CAST(floor(o_totalprice / 50000) AS bigint) AS bucket, count(*) AS n FROM orders GROUP BY floor(o_totalprice / 50000)",
    # windows, passed on as they are
    "sql_window_rank": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS bigint) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS bigint) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS bigint) AS dr FROM orders",
    "sql_window_frame": "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS running, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders",
    # order, limit, sets, subqueries
    "sql_order_nulls": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000 ORDER BY o_orderkey NULLS LAST, c_custkey LIMIT 50 OFFSET 10",
    "sql_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 AS k FROM region",
    "sql_union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey + 3 AS k FROM region",
    "sql_intersect": "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_partkey AS k FROM lineitem WHERE l_discount > 0.09",
    "sql_intersect_all": "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT ALL SELECT l_partkey AS k FROM lineitem WHERE l_discount > 0.09",
    "sql_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40",
    "sql_except_all": "SELECT l_partkey AS k FROM lineitem EXCEPT ALL SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 10",
    "sql_cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big, top WHERE n >= m - 1",
    "sql_scalar_subquery": "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
    "sql_from_subquery": "SELECT lang, max(n) AS longest FROM (SELECT lang, length(text) AS n FROM documents) t GROUP BY lang",
    # strings, numbers, dates, casts
    "sql_strings": "SELECT p_partkey, p_brand || '/' || p_type AS label, lpad(CAST(p_size AS varchar(9)), 5, '0') AS padded, substring(p_name, 2, 3) AS part_name, upper(p_name) AS up, length(p_name) AS n, replace(p_name, 'r', 'R') AS replaced FROM part",
    "sql_like": "SELECT p_partkey FROM part WHERE p_name LIKE '%ring%' OR (p_name NOT LIKE '%e%' AND p_name LIKE '_e%')",
    "sql_ilike": "SELECT p_partkey FROM part WHERE p_name ILIKE 'RED%'",
    "sql_regexp_substr": ("SELECT page_id, regexp_substr(url, '[a-z]+/[0-9]+') AS tail FROM pages", "SELECT page_id, CASE WHEN regexp_matches(url, '[a-z]+/[0-9]+') THEN regexp_extract(url, '[a-z]+/[0-9]+') END AS tail FROM pages"),
    "sql_extract": "SELECT event_id, CAST(extract(year FROM ts) AS bigint) AS y, CAST(extract(month FROM ts) AS bigint) AS m, CAST(extract(day FROM ts) AS bigint) AS d, CAST(extract(hour FROM ts) AS bigint) AS h, CAST(extract(minute FROM ts) AS bigint) AS mi FROM events",
    "sql_epoch": ("SELECT event_id, CAST(EXTRACT(EPOCH FROM ts) AS bigint) AS secs FROM events", "SELECT event_id, CAST(floor(epoch(ts)) AS bigint) AS secs FROM events"),
    "sql_epoch_between": ("SELECT user_id, CAST(EXTRACT(EPOCH FROM (last_ts - first_ts)) * 1000 AS bigint) AS millis FROM (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id) u", "SELECT user_id, CAST(round(date_diff('microsecond', min(ts), max(ts)) / 1000.0 - 0.5) AS bigint) AS millis FROM events GROUP BY user_id"),
    "sql_to_date": ("SELECT o_orderkey, to_date('1997-03-05', '%Y-%m-%d') AS day FROM orders WHERE o_orderdate < to_date('1995-02-01', '%Y-%m-%d')", "SELECT o_orderkey, strptime('1997-03-05', '%Y-%m-%d') AS day FROM orders WHERE o_orderdate < strptime('1995-02-01', '%Y-%m-%d')"),
    "sql_div": ("SELECT p_partkey, CAST(DIV(p_size - 25, 7) AS bigint) AS q, (p_size - 25) % 7 AS r FROM part", "SELECT p_partkey, CAST((p_size - 25) // 7 AS bigint) AS q, (p_size - 25) % 7 AS r FROM part"),
    "sql_math": "SELECT c_custkey, round(c_acctbal, 1) AS r1, CAST(ceil(c_acctbal) AS double) AS up, CAST(floor(c_acctbal) AS double) AS down, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS double) AS s, round(sqrt(abs(c_acctbal)), 6) AS root, round(power(c_acctbal, 2), 2) AS sq FROM customer",
    "sql_trunc": ("SELECT c_custkey, TRUNC(c_acctbal) AS t, TRUNC(c_acctbal, 1) AS t1 FROM customer", "SELECT c_custkey, trunc(c_acctbal) AS t, trunc(c_acctbal * 10) / 10 AS t1 FROM customer"),
    "sql_arrays": ("SELECT vec_id, CAST(embedding[1] AS double) AS a, CAST(embedding[64] AS double) AS z, array_length(embedding, 1) AS n FROM embeddings", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[64] AS DOUBLE) AS z, len(embedding) AS n FROM embeddings"),
    "sql_generate_series": ("SELECT o_orderpriority, generate_series AS n FROM orders JOIN generate_series(1, 3) ON generate_series = o_custkey % 5", "SELECT o_orderpriority, generate_series AS n FROM orders JOIN generate_series(1, 3) ON generate_series = o_custkey % 5"),
    "json_contains": ("SELECT event_id FROM events WHERE props @> '{\"k\": 69}'", "SELECT event_id FROM events WHERE (props ->> 'k') = '69'"),
    "sql_casts": ("SELECT o_orderkey, o_totalprice::int8 AS whole, o_orderkey::text AS t, (o_custkey::text || '.5')::float8 AS f, '12'::int4 AS i FROM orders", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS t, CAST(CAST(o_custkey AS VARCHAR) || '.5' AS DOUBLE) AS f, CAST('12' AS INTEGER) AS i FROM orders"),
    "sql_case": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS seg, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS other FROM customer",
    # JSON in events
    "json_arrow_hourly": ("SELECT CAST(extract(hour FROM ts) AS bigint) AS hour, count(*) AS n, CAST(sum((props ->> 'k')::int4) AS bigint) AS total FROM events GROUP BY extract(hour FROM ts)", "SELECT CAST(extract(hour FROM ts) AS BIGINT) AS hour, count(*) AS n, CAST(sum(CAST(props ->> 'k' AS INTEGER)) AS BIGINT) AS total FROM events GROUP BY extract(hour FROM ts)"),
    "json_arrow_filter": ("SELECT event_id, user_id FROM events WHERE props ->> 'k' = '42' AND event_type = 'click'", "SELECT event_id, user_id FROM events WHERE (props ->> 'k') = '42' AND event_type = 'click'"),
    "json_top_kinds": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type ORDER BY n DESC",
    "json_first_by_user": ("SELECT user_id, min(ts) AS first_ts FROM events WHERE (props ->> 'k')::int4 > 50 GROUP BY user_id ORDER BY first_ts LIMIT 3", "SELECT user_id, min(ts) AS first_ts FROM events WHERE CAST(props ->> 'k' AS INTEGER) > 50 GROUP BY user_id ORDER BY first_ts LIMIT 3"),
}
