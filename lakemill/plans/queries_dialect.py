"""Queries written in the dialect, each with an independent DuckDB form.

Each pair is (statement in the dialect, SQL for DuckDB).  Tables are temporary
views over the Parquet files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakemill.plans import dialect, queries_functions

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

PAIRS: dict[str, tuple[str, str]] = {
    # Scan, filter, projection, literals
    "scan_project": ("SELECT l_orderkey k, l_quantity q FROM lineitem WHERE l_shipdate < '1996-01-01' AND l_discount BETWEEN 0.05 AND 0.07", "SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_discount BETWEEN 0.05 AND 0.07"),
    "dual": ("SELECT 1 + 1 AS a, 'x' AS b, CAST(NULL AS SIGNED) AS c, TRUE AS d FROM dual", "SELECT 2 AS a, 'x' AS b, CAST(NULL AS BIGINT) AS c, true AS d"),
    "pred_in_like": ("SELECT p_partkey, p_name FROM part WHERE p_size IN (1, 5, 9) AND p_name NOT LIKE '%z%' AND p_brand LIKE 'Brand#_%'", "SELECT p_partkey, p_name FROM part WHERE p_size IN (1, 5, 9) AND p_name NOT LIKE '%z%' AND p_brand LIKE 'Brand#_%'"),
    "pred_xor_is": ("SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000 XOR o_orderstatus = 'F') AND (o_custkey = 1) IS FALSE AND (o_custkey > 5) IS NOT UNKNOWN", "SELECT o_orderkey FROM orders WHERE ((o_totalprice > 100000) <> (o_orderstatus = 'F')) AND o_custkey <> 1 AND o_custkey IS NOT NULL"),
    "pred_null_logic": ("SELECT count(*) n, count(nullif(p_size, 1)) m, sum((nullif(p_size, 1) IN (2, NULL)) IS UNKNOWN) u FROM part", "SELECT count(*) AS n, count(nullif(p_size, 1)) AS m, sum(CASE WHEN (nullif(p_size, 1) IN (2, NULL)) IS NULL THEN 1 ELSE 0 END) AS u FROM part"),
    "pred_row_in": ("SELECT n_name FROM nation WHERE (n_regionkey, n_nationkey) IN ((0, 0), (1, 2), (2, 8))", "SELECT n_name FROM nation WHERE (n_regionkey, n_nationkey) IN ((0, 0), (1, 2), (2, 8))"),
    "pred_regexp_exact": ("SELECT p_partkey FROM part WHERE p_type REGEXP '^[A-M]' OR p_name EXACT_LIKE '%1|2%'", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^[A-M]') OR p_name ILIKE '%1%' OR p_name ILIKE '%2%'"),
    "op_arithmetic": ("SELECT l_orderkey k, l_linenumber n, l_quantity / l_tax a, l_orderkey % 7 b, l_orderkey MOD 0 c, -l_quantity d, l_orderkey << 2 e, l_orderkey & 6 f, l_orderkey | 1 g, l_orderkey ^ 3 h, l_quantity / 0 i FROM lineitem", "SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity / l_tax END AS a, l_orderkey % 7 AS b, CAST(NULL AS BIGINT) AS c, -l_quantity AS d, l_orderkey << 2 AS e, l_orderkey & 6 AS f, l_orderkey | 1 AS g, xor(l_orderkey, 3) AS h, CAST(NULL AS DOUBLE) AS i FROM lineitem"),
    "op_case_if": ("SELECT o_orderkey, IF(o_totalprice > 1000, 'big', 'small') a, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END b, IFNULL(NULLIF(o_orderpriority, '1-URGENT'), 'none') c FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 1000 THEN 'big' ELSE 'small' END AS a, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS b, coalesce(nullif(o_orderpriority, '1-URGENT'), 'none') AS c FROM orders"),
    "op_interval": ("SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH a, o_orderdate - INTERVAL 10 DAY b, DATE_ADD(o_orderdate, INTERVAL 1 YEAR) c FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS a, o_orderdate - INTERVAL 10 DAY AS b, o_orderdate + INTERVAL 1 YEAR AS c FROM orders"),
    # Joins
    "join_inner_using": ("SELECT n_name, r_name, k FROM (SELECT n_name, n_regionkey k FROM nation) a JOIN (SELECT r_regionkey k, r_name FROM region) b USING (k)", "SELECT n_name, r_name, n_regionkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_left": ("SELECT c_custkey, count(o_orderkey) n FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000 GROUP BY c_custkey", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000 GROUP BY c_custkey"),
    "join_right": ("SELECT n_name, count(s_suppkey) n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"),
    "join_full": ("SELECT a.k ak, b.k bk FROM (SELECT o_custkey k FROM orders WHERE o_custkey < 200 GROUP BY o_custkey) a FULL JOIN (SELECT c_custkey k FROM customer WHERE c_custkey BETWEEN 100 AND 300) b ON a.k = b.k", "SELECT a.k AS ak, b.k AS bk FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey < 200) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey BETWEEN 100 AND 300) b ON a.k = b.k"),
    "join_comma_theta": ("SELECT a.n_name x, b.n_name y FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", "SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "join_five": ("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name"),
    "join_index_hint": ("SELECT count(*) n FROM orders USE INDEX (pk) JOIN lineitem IGNORE INDEX FOR JOIN (x) ON o_orderkey = l_orderkey", "SELECT count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    # Subqueries
    "sub_scalar": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)"),
    "sub_scalar_correlated": ("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) m FROM customer", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer"),
    "sub_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"),
    "sub_not_in_null": ("SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey BETWEEN 5 AND 20)) a, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, o_custkey) FROM orders)) b FROM dual", "SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey BETWEEN 5 AND 20)) AS a, 0 AS b"),
    "sub_exists": ("SELECT o_orderpriority, count(*) n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority"),
    "sub_not_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"),
    "sub_any_all": ("SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size = 3) AND p_size > ANY (SELECT p_size FROM part WHERE p_brand = 'Brand#11') AND p_partkey = SOME (SELECT l_partkey FROM lineitem)", "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size = 3) AND p_size > ANY (SELECT p_size FROM part WHERE p_brand = 'Brand#11') AND p_partkey = ANY (SELECT l_partkey FROM lineitem)"),
    "sub_all_empty": ("SELECT count(*) n FROM part WHERE p_size < ALL (SELECT p_size FROM part WHERE p_size < 0)", "SELECT count(*) AS n FROM part"),
    "sub_derived": ("SELECT k, t FROM (SELECT o_custkey k, sum(o_totalprice) t FROM orders GROUP BY o_custkey) d WHERE t > 500000", "SELECT k, t FROM (SELECT o_custkey AS k, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) d WHERE t > 500000"),
    "sub_cte": ("WITH a AS (SELECT o_custkey k, count(*) n FROM orders GROUP BY o_custkey), b AS (SELECT max(n) m FROM a) SELECT k, n FROM a, b WHERE n = m", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT max(n) AS m FROM a) SELECT k, n FROM a, b WHERE n = m"),
    # Aggregates
    "agg_pricing": ("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) sum_disc, round(avg(l_discount), 6) avg_disc, count(*) n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING n > 10", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10"),
    "agg_min_max_avg": ("SELECT p_brand, min(p_size) a, max(p_name) b, avg(p_size) c, sum(p_size) d, count(nullif(p_size, 3)) e FROM part WHERE p_size > 2 GROUP BY p_brand", "SELECT p_brand, min(p_size) AS a, max(p_name) AS b, avg(p_size) AS c, sum(p_size) AS d, count(nullif(p_size, 3)) AS e FROM part WHERE p_size > 2 GROUP BY p_brand"),
    "agg_count_multi": ("SELECT count(p_brand, nullif(p_size, 1)) a, count(DISTINCT p_brand, p_size) b, count(DISTINCT p_type) c FROM part", "SELECT count(CASE WHEN p_brand IS NOT NULL AND nullif(p_size, 1) IS NOT NULL THEN 1 END) AS a, (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_size FROM part)) AS b, count(DISTINCT p_type) AS c FROM part"),
    "agg_multi_distinct": ("SELECT l_returnflag, count(DISTINCT l_orderkey) a, count(DISTINCT l_partkey) b, sum(DISTINCT l_quantity) c, avg(DISTINCT l_linenumber) d FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS a, count(DISTINCT l_partkey) AS b, sum(DISTINCT l_quantity) AS c, avg(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY l_returnflag"),
    "agg_group_concat": ("SELECT n_regionkey, GROUP_CONCAT(DISTINCT n_name ORDER BY n_name DESC SEPARATOR '|') a, GROUP_CONCAT(n_name ORDER BY n_nationkey) b FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(DISTINCT n_name, '|' ORDER BY n_name DESC) AS a, string_agg(n_name, ',' ORDER BY n_nationkey) AS b FROM nation GROUP BY n_regionkey"),
    "agg_loose": ("SELECT n_regionkey, r_name, count(*) n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey", "SELECT n_regionkey, any_value(r_name) AS r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey"),
    "agg_distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "agg_bitmap": ("SELECT l_returnflag, rb_cardinality(rb_build_agg(l_suppkey)) n, rb_maximum(rb_build_agg(l_suppkey)) m FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, max(l_suppkey) AS m FROM lineitem GROUP BY l_returnflag"),
    "agg_bitmap_merge": ("SELECT rb_cardinality(rb_or_agg(b)) o, rb_cardinality(rb_and_agg(b)) a FROM (SELECT l_returnflag, rb_build_agg(l_suppkey) b FROM lineitem GROUP BY l_returnflag) t", "SELECT count(*) AS o, sum(CASE WHEN k = (SELECT count(DISTINCT l_returnflag) FROM lineitem) THEN 1 ELSE 0 END) AS a FROM (SELECT l_suppkey, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY l_suppkey)"),
    "agg_hll_error": ("SELECT o_orderstatus, hll_estimate(hll_add_agg(o_orderpriority)) a, hll_estimate(hll_add_agg(month(o_orderdate))) b, abs(hll_estimate(hll_add_agg(o_custkey)) - count(DISTINCT o_custkey)) < 0.05 * count(DISTINCT o_custkey) c FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS a, count(DISTINCT month(o_orderdate)) AS b, true AS c FROM orders GROUP BY o_orderstatus"),
    "agg_hll_merge": ("SELECT hll_estimate(hll_merge_agg(h)) n, count(*) g FROM (SELECT c_mktsegment, hll_add_agg(c_nationkey) h FROM customer GROUP BY c_mktsegment) t", "SELECT count(DISTINCT c_nationkey) AS n, count(DISTINCT c_mktsegment) AS g FROM customer"),
    "agg_tdigest": ("SELECT n_regionkey, tdigest_total_count(d) n, tdigest_total_sum(d) s, tdigest_percentile(d, 0) a, tdigest_percentile(d, 1) b FROM (SELECT n_regionkey, tdigest_build_agg(n_nationkey) d FROM nation GROUP BY n_regionkey) t", "SELECT n_regionkey, CAST(count(*) AS DOUBLE) AS n, CAST(sum(n_nationkey) AS DOUBLE) AS s, CAST(min(n_nationkey) AS DOUBLE) AS a, CAST(max(n_nationkey) AS DOUBLE) AS b FROM nation GROUP BY n_regionkey"),
    # Windows
    "window_rank": ("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) dr, percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) pr, cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) cd, ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) nt FROM orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pr, cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS cd, ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nt FROM orders"),
    "window_shift": ("SELECT event_id, lag(event_id, 1, 0) OVER w a, lead(event_id, 2) OVER w b, first_value(event_id) OVER w c, last_value(event_id) OVER w d, nth_value(event_id, 2) OVER w e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "SELECT event_id, lag(event_id, 1, 0) OVER w AS a, lead(event_id, 2) OVER w AS b, first_value(event_id) OVER w AS c, last_value(event_id) OVER w AS d, nth_value(event_id, 2) OVER w AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "window_frames": ("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) a, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) b, max(o_totalprice) OVER (PARTITION BY o_custkey) c, min(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) d FROM orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS a, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, max(o_totalprice) OVER (PARTITION BY o_custkey) AS c, min(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS d FROM orders"),
    "window_no_order": ("SELECT n_nationkey, rank() OVER (PARTITION BY n_regionkey) a, dense_rank() OVER (PARTITION BY n_regionkey) b, cume_dist() OVER (PARTITION BY n_regionkey) c FROM nation", "SELECT n_nationkey, CAST(1 AS BIGINT) AS a, CAST(1 AS BIGINT) AS b, CAST(1 AS DOUBLE) AS c FROM nation"),
    # Order, limit, sets
    "sort_limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5, 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"),
    "sort_nulls": ("SELECT p_partkey, nullif(p_size, 1) s FROM part ORDER BY s, p_partkey LIMIT 20", "SELECT p_partkey, nullif(p_size, 1) AS s FROM part ORDER BY s ASC NULLS FIRST, p_partkey LIMIT 20"),
    "set_union_all": ("SELECT n_regionkey k FROM nation UNION ALL SELECT r_regionkey FROM region", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region"),
    "set_union_sticky": ("SELECT n_regionkey k FROM nation UNION SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region ORDER BY k LIMIT 4", "SELECT DISTINCT k FROM (SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) ORDER BY k LIMIT 4"),
    # Functions over columns
    "fn_math": ("SELECT o_orderkey, round(o_totalprice, 1) a, floor(o_totalprice) b, ceil(o_totalprice) c, abs(-o_totalprice) d, sqrt(o_totalprice) e, mod(o_totalprice, 7) f, sign(o_totalprice - 100000) g, pow(2, 3) h, greatest(o_custkey, 500) i, least(o_custkey, 500) j, bit_count(o_custkey) k, log(2, 8) l, ln(o_totalprice) m FROM orders", "SELECT o_orderkey, round(o_totalprice, 1) AS a, CAST(floor(o_totalprice) AS BIGINT) AS b, CAST(ceil(o_totalprice) AS BIGINT) AS c, abs(o_totalprice) AS d, sqrt(o_totalprice) AS e, o_totalprice % 7 AS f, CAST(sign(o_totalprice - 100000) AS BIGINT) AS g, 8.0::DOUBLE AS h, greatest(o_custkey, 500)::DOUBLE AS i, least(o_custkey, 500)::DOUBLE AS j, bit_count(o_custkey)::BIGINT AS k, 3.0::DOUBLE AS l, ln(o_totalprice) AS m FROM orders"),
    "fn_trig": ("SELECT p_partkey, sin(p_size) a, cos(p_size) b, tan(p_size) c, atan(p_size) d, asin(p_size / 100) e, acos(p_size / 100) f, cot(p_size) g, asin(p_size + 1) h, pi() i FROM part", "SELECT p_partkey, sin(p_size) AS a, cos(p_size) AS b, tan(p_size) AS c, atan(p_size) AS d, asin(p_size / 100.0) AS e, acos(p_size / 100.0) AS f, cot(p_size) AS g, CAST(NULL AS DOUBLE) AS h, pi() AS i FROM part"),
    "fn_string": ("SELECT p_partkey, length(p_name) a, upper(p_name) b, concat(p_brand, '-', p_type) c, substr(p_name, 2, 3) d, left(p_name, 3) e, right(p_name, 3) f, replace(p_name, 'a', 'b') g, reverse(p_name) h, locate('e', p_name) i, instr(p_name, 'e') j, lpad(p_size, 5, '0') k, rpad(p_size, 5, 'x') l, concat_ws('/', p_brand, NULL, p_size) m, strcmp(p_name, p_type) n, substr(p_name, -2) o, char_length(p_name) p FROM part", "SELECT p_partkey, strlen(p_name) AS a, upper(p_name) AS b, p_brand || '-' || p_type AS c, substr(p_name, 2, 3) AS d, left(p_name, 3) AS e, right(p_name, 3) AS f, replace(p_name, 'a', 'b') AS g, reverse(p_name) AS h, instr(p_name, 'e') AS i, instr(p_name, 'e') AS j, lpad(p_size::VARCHAR, 5, '0') AS k, rpad(p_size::VARCHAR, 5, 'x') AS l, p_brand || '/' || p_size AS m, CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 ELSE 0 END AS n, right(p_name, 2) AS o, length(p_name) AS p FROM part"),
    "fn_string_sets": ("SELECT p_partkey, field(p_brand, 'Brand#11', 'Brand#12') a, elt(p_size, 'a', 'b', 'c') b, find_in_set(p_size, '3,5,7') c, make_set(p_size, 'a', 'b', 'c') d, hex(p_brand) e, bin(p_size) f, oct(p_size) g, split_part(p_type, ' ', 2) h, substring_index(p_type, ' ', 1) i, repeat('ab', p_size - 3) j FROM part", "SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 ELSE 0 END AS a, CASE p_size WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END AS b, CASE p_size WHEN 3 THEN 1 WHEN 5 THEN 2 WHEN 7 THEN 3 ELSE 0 END AS c, concat_ws(',', CASE WHEN p_size & 1 > 0 THEN 'a' END, CASE WHEN p_size & 2 > 0 THEN 'b' END, CASE WHEN p_size & 4 > 0 THEN 'c' END) AS d, hex(p_brand) AS e, bin(p_size) AS f, CASE WHEN p_size >= 8 THEN (p_size // 8)::VARCHAR ELSE '' END || (p_size % 8)::VARCHAR AS g, split_part(p_type, ' ', 2) AS h, split_part(p_type, ' ', 1) AS i, CASE WHEN p_size > 3 THEN repeat('ab', p_size - 3) END AS j FROM part"),
    "fn_datetime": ("SELECT o_orderkey, year(o_orderdate) a, month(o_orderdate) b, day(o_orderdate) c, quarter(o_orderdate) d, dayofweek(o_orderdate) e, weekday(o_orderdate) f, dayofyear(o_orderdate) g, weekofyear(o_orderdate) h, datediff(o_orderdate, '1995-01-01') i, to_days(o_orderdate) j, date_format(o_orderdate, '%Y/%m/%d %H:%i:%s') k, dayname(o_orderdate) l, monthname(o_orderdate) m, timestampdiff(DAY, '1992-01-01', o_orderdate) n, extract(YEAR FROM o_orderdate) o, date(o_orderdate) p FROM orders", "SELECT o_orderkey, year(o_orderdate) AS a, month(o_orderdate) AS b, day(o_orderdate) AS c, quarter(o_orderdate) AS d, dayofweek(o_orderdate) + 1 AS e, isodow(o_orderdate) - 1 AS f, dayofyear(o_orderdate) AS g, weekofyear(o_orderdate) AS h, datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS i, datediff('day', DATE '1970-01-01', o_orderdate::DATE) + 719528 AS j, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS k, dayname(o_orderdate) AS l, monthname(o_orderdate) AS m, datediff('day', DATE '1992-01-01', o_orderdate::DATE) AS n, year(o_orderdate) AS o, o_orderdate::DATE AS p FROM orders"),
    "fn_week": ("SELECT o_orderkey, week(o_orderdate, 3) a, yearweek(o_orderdate, 3) b, week(o_orderdate, 1) c, week(o_orderdate, 0) d, week(o_orderdate, 5) e FROM orders", "SELECT o_orderkey, weekofyear(o_orderdate) AS a, yearweek(o_orderdate) AS b, CASE WHEN isoyear(o_orderdate) < year(o_orderdate) THEN 0 WHEN isoyear(o_orderdate) > year(o_orderdate) THEN 53 ELSE weekofyear(o_orderdate) END AS c, CAST(strftime(o_orderdate, '%U') AS INT) AS d, CAST(strftime(o_orderdate, '%W') AS INT) AS e FROM orders"),
    "fn_time": ("SELECT event_id, hour(ts) a, minute(ts) b, second(ts) c, time_to_sec(ts) d, sec_to_time(event_id) e, addtime('10:00:00', '01:30:00') f, period_add(199801, 2) g, unix_timestamp(ts) h, from_unixtime(event_id) i FROM events", "SELECT event_id, hour(ts) AS a, minute(ts) AS b, second(ts) AS c, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS d, lpad((event_id // 3600)::VARCHAR, greatest(2, length((event_id // 3600)::VARCHAR))::INT, '0') || ':' || lpad((event_id // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') AS e, '11:30:00' AS f, '199803' AS g, epoch_us(ts) // 1000000 AS h, make_timestamp(event_id * 1000000) AS i FROM events"),
    "fn_cast": ("SELECT o_orderkey, CAST(o_orderpriority AS SIGNED) a, CAST(o_totalprice AS CHAR) IS NOT NULL b, CAST('1998-02-30' AS DATE) c, CAST(concat(o_custkey, 'x') AS SIGNED) d, CONVERT('12.5kg', DECIMAL(10, 2)) e, CAST(o_orderdate AS DATE) f FROM orders", "SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS BIGINT) AS a, true AS b, CAST(NULL AS DATE) AS c, o_custkey AS d, CAST(12.5 AS DOUBLE) AS e, o_orderdate::DATE AS f FROM orders"),
    "fn_json": ("SELECT event_id, json_valid(props) a, json_extract(concat('{\"k\":', event_id, ',\"s\":\"x\"}'), '$.k') b, json_extract(concat('{\"k\":', event_id, ',\"s\":\"x\"}'), '$.s') c, json_extract1('{\"s\":\"x\"}', '$.s') d, json_object('a', event_id) e, json_array(event_id, 'b') f FROM events", "SELECT event_id, json_valid(props) AS a, event_id::VARCHAR AS b, 'x' AS c, '\"x\"' AS d, '{\"a\":\"' || event_id || '\"}' AS e, '[\"' || event_id || '\",\"b\"]' AS f FROM events"),
    "fn_hash": ("SELECT c_custkey, md5(c_name) a, sha1(c_name) b, to_base64(c_name) c, from_base64(to_base64(c_name)) d, point_distance(c_nationkey, 1, c_nationkey, 1) e FROM customer", "SELECT c_custkey, md5(c_name) AS a, sha1(c_name) AS b, base64(c_name::BLOB) AS c, c_name AS d, CAST(0 AS BIGINT) AS e FROM customer"),
    "fn_bitmap": ("SELECT n_nationkey, rb_cardinality(rb_or(rb_build(n_nationkey, 1), rb_build(2))) a, rb_contains(rb_build(n_nationkey, 1), 1) b, rb_cardinality(rb_xor(rb_build(n_nationkey, 1), rb_build(1))) c, rb_minimum(rb_add_range(rb_build(n_nationkey), 3, 6)) d FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey IN (1, 2) THEN 2 ELSE 3 END AS a, true AS b, CASE WHEN n_nationkey = 1 THEN 0 ELSE 1 END AS c, least(n_nationkey, 3) AS d FROM nation"),
    # Full text
    "fulltext_match": ("SELECT doc_id FROM documents WHERE MATCH (text) AGAINST ('+the -of' IN BOOLEAN MODE)", "SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[A-Za-z0-9_À-ɏ]+'), 'the') AND NOT list_contains(regexp_extract_all(lower(text), '[A-Za-z0-9_À-ɏ]+'), 'of')"),
}

PAIRS |= queries_functions.PAIRS


def views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _query(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    used = tuple(t for t in TABLES if t in statement)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, used)
        return dialect.sql(spark, statement)

    return run


QUERIES = {k: _query(s) for k, (s, _) in PAIRS.items()}
ORACLE = {k: o for k, (_, o) in PAIRS.items()}
