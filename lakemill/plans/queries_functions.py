"""Queries over the rest of the function library, each with a DuckDB form.

Together with the dialect queries they call every function: values come from
columns where DuckDB can say the same, else from constants with known results.
"""

from __future__ import annotations

PAIRS: dict[str, tuple[str, str]] = {
    "fn_math_more": (
        "SELECT p_partkey, power(p_size, 2) a, ceiling(p_retailprice) b, rand() >= 0 AND rand() < 1 c, abs(p_size - 25) d, sign(p_size - 25) e, mod(p_size, 7) f FROM part",
        "SELECT p_partkey, power(p_size, 2)::DOUBLE AS a, CAST(ceil(p_retailprice) AS BIGINT) AS b, true AS c, abs(p_size - 25)::DOUBLE AS d, CAST(sign(p_size - 25) AS BIGINT) AS e, (p_size % 7)::DOUBLE AS f FROM part",
    ),
    "fn_string_case": (
        "SELECT p_partkey, bit_length(p_name) a, lower_gbk(p_name) b, ucase(p_name) c, lcase(p_type) d, mid(p_name, 2, 3) e, ltrim(concat('  ', p_name)) f, rtrim(concat(p_name, '  ')) g, trim(concat(' ', p_name, ' ')) h, ascii(p_name) i, position('a' IN p_name) j, space(3) k, unhex(hex(p_brand)) l FROM part",
        "SELECT p_partkey, strlen(p_name) * 8 AS a, lower(p_name) AS b, upper(p_name) AS c, lower(p_type) AS d, substr(p_name, 2, 3) AS e, p_name AS f, p_name AS g, p_name AS h, ascii(p_name) AS i, instr(p_name, 'a') AS j, '   ' AS k, p_brand AS l FROM part",
    ),
    "fn_string_forms": (
        "SELECT s_suppkey, format(s_acctbal, 2) a, quote(s_name) b, char(65, 66) c, soundex('Robert') d, export_set(s_suppkey % 4, 'Y', 'N', ',', 2) e, insert(s_name, 1, 2, 'zz') f, regexp_replace(s_name, '[0-9]+', '#') g, trim(LEADING 'S' FROM s_name) h FROM supplier",
        "SELECT s_suppkey, format('{:,.2f}', s_acctbal) AS a, '''' || s_name || '''' AS b, 'AB' AS c, 'R163' AS d, CASE s_suppkey % 4 WHEN 0 THEN 'N,N' WHEN 1 THEN 'Y,N' WHEN 2 THEN 'N,Y' ELSE 'Y,Y' END AS e, 'zz' || substr(s_name, 3) AS f, regexp_replace(s_name, '[0-9]+', '#', 'g') AS g, ltrim(s_name, 'S') AS h FROM supplier",
    ),
    "fn_date_shift": (
        "SELECT o_orderkey, timestampadd(HOUR, 5, o_orderdate) a, adddate(o_orderdate, 10) b, date_sub(o_orderdate, INTERVAL 3 DAY) c, subdate(o_orderdate, 5) d, dayofmonth(o_orderdate) e, str_to_date(date_format(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') f, to_seconds(o_orderdate) g, timestamp(o_orderdate) h FROM orders",
        "SELECT o_orderkey, o_orderdate + INTERVAL 5 HOUR AS a, o_orderdate + INTERVAL 10 DAY AS b, o_orderdate - INTERVAL 3 DAY AS c, o_orderdate - INTERVAL 5 DAY AS d, day(o_orderdate) AS e, date_trunc('day', o_orderdate)::TIMESTAMP AS f, epoch_us(o_orderdate) // 1000000 + 62167219200 AS g, o_orderdate AS h FROM orders",
    ),
    "fn_now": (
        "SELECT o_orderkey, now() > o_orderdate a, sysdate() > o_orderdate b, utc_timestamp() > o_orderdate c, utc_date() > date(o_orderdate) d, length(utc_time()) e, curdate() > date(o_orderdate) f, current_date() > date(o_orderdate) g, length(curtime()) h, length(current_time()) i, current_timestamp() > o_orderdate j FROM orders",
        "SELECT o_orderkey, true AS a, true AS b, true AS c, true AS d, 8 AS e, true AS f, true AS g, 8 AS h, 8 AS i, true AS j FROM orders WHERE o_orderdate < current_date",
    ),
    "fn_time_more": (
        "SELECT event_id, time(ts) a, subtime('10:00:00', sec_to_time(event_id % 1000)) b, time_format(time(ts), '%H-%i-%s') c, timediff('10:00:00', '09:30:00') d, microsecond('10:00:00.000123') e, period_diff(199803, 199801) f, convert_tz('2020-01-01 00:00:00', '+00:00', '+08:00') g, tso_to_timestamp(timestamp_to_tso(date_format(ts, '%Y-%m-%d %H:%i:%s'))) h FROM events",
        "SELECT event_id, strftime(ts, '%H:%M:%S') AS a, strftime(TIMESTAMP '2000-01-01 10:00:00' - to_seconds(event_id % 1000), '%H:%M:%S') AS b, strftime(ts, '%H-%M-%S') AS c, '00:30:00' AS d, 123 AS e, 2 AS f, '2020-01-01 08:00:00' AS g, date_trunc('second', ts)::TIMESTAMP AS h FROM events",
    ),
    "fn_bitmap_sets": (
        "SELECT n_nationkey, rb_cardinality(rb_and(rb_build(n_nationkey, 1, 2), rb_build(1, 3))) a, rb_cardinality(rb_andnot(rb_build(n_nationkey, 1), rb_build(1))) b, rb_empty(rb_andnot(rb_build(n_nationkey), rb_build(4))) c, rb_equals(rb_build(n_nationkey, 1), rb_build(1, n_nationkey)) d, rb_intersect(rb_build(n_nationkey), rb_build(3, 4)) e, rb_maximum(rb_add(rb_build(n_nationkey), 9)) f, rb_cardinality(rb_remove(rb_build(n_nationkey, 1), 1)) g, rb_cardinality(rb_remove_range(rb_add_range(rb_build(n_nationkey), 0, 10), 2, 8)) h FROM nation",
        "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 2 ELSE 1 END AS a, CASE WHEN n_nationkey = 1 THEN 0 ELSE 1 END AS b, n_nationkey = 4 AS c, true AS d, n_nationkey IN (3, 4) AS e, greatest(n_nationkey, 9) AS f, CASE WHEN n_nationkey = 1 THEN 0 ELSE 1 END AS g, CASE WHEN n_nationkey < 10 THEN 4 ELSE 5 END AS h FROM nation",
    ),
    "fn_bitmap_ranges": (
        "SELECT n_nationkey, rb_cardinality(rb_flip_range(rb_build(n_nationkey), 0, 10)) a, rb_cardinality(rb_flip(rb_build(n_nationkey, 1), 0, 3)) b, rb_rank(rb_build(1, 5, 9, 13), n_nationkey) c, rb_jaccard_index(rb_build(n_nationkey, 1), rb_build(1)) d, rb_contains_range(rb_add_range(rb_build(30), 0, 10), 0, n_nationkey + 1) e FROM nation",
        "SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN 9 ELSE 11 END AS a, CASE n_nationkey WHEN 1 THEN 3 WHEN 0 THEN 2 WHEN 3 THEN 2 ELSE 4 END AS b, (n_nationkey >= 1)::INT + (n_nationkey >= 5)::INT + (n_nationkey >= 9)::INT + (n_nationkey >= 13)::INT AS c, CASE WHEN n_nationkey = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS d, n_nationkey < 10 AS e FROM nation",
    ),
    "fn_sketches": (
        "SELECT n_nationkey, hll_estimate(hll_merge(hll_init(n_nationkey), hll_init(1, 2))) a, hll_estimate(hll_add(hll_init('x'), n_nationkey)) b, tdigest_total_count(tdigest_add(tdigest_build(1, 2), n_nationkey)) c, tdigest_total_sum(tdigest_merge(tdigest_build(1, 2), tdigest_build(n_nationkey))) d, tdigest_location(tdigest_build(0, 10, 20, n_nationkey), 100) e FROM nation",
        "SELECT n_nationkey, CASE WHEN n_nationkey IN (1, 2) THEN 2 ELSE 3 END AS a, 2 AS b, 3.0::DOUBLE AS c, (3 + n_nationkey)::DOUBLE AS d, 1.0::DOUBLE AS e FROM nation",
    ),
    "fn_control": (
        "SELECT c_custkey, isnull(nullif(c_nationkey, 3)) a, murmur_hash(c_name) = murmur_hash(concat(c_name, '')) AND murmur_hash(c_name) <> murmur_hash(concat(c_name, 'x')) b, sha(c_name) c, length(version()) > 0 d, last_insert_id(c_custkey) e, cast_to_time('10:11:12') f, cast_to_datetime('1998-01-02 03:04:05') g, cast_to_unsigned(-c_custkey) h, database() = database() i, length(user()) > 0 j, session_user() = system_user() k FROM customer",
        "SELECT c_custkey, c_nationkey = 3 AS a, true AS b, sha1(c_name) AS c, true AS d, c_custkey AS e, '10:11:12' AS f, TIMESTAMP '1998-01-02 03:04:05' AS g, CASE WHEN c_custkey = 0 THEN 0 ELSE 18446744073709551616 - c_custkey END AS h, true AS i, true AS j, true AS k FROM customer",
    ),
    "fn_json_types": (
        "SELECT event_id, json_type(concat('', event_id)) a, json_type(concat('[', event_id, ']')) b, json_object('a', event_id, 'a', 2) c, json_valid('{') d FROM events",
        "SELECT event_id, 'INTEGER' AS a, 'ARRAY' AS b, '{\"a\":\"' || event_id || '\",\"a\":\"2\"}' AS c, false AS d FROM events",
    ),
    "fn_case": (
        "SELECT o_orderkey, case_when(o_totalprice > 100000, 'big', 'small') a, case_expr_when(o_orderstatus, 'F', 1, 'O', 2, 3) b FROM orders",
        "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS a, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS b FROM orders",
    ),
    # Operators whose meaning is easily missed
    "op_number_conditions": (
        "SELECT p_partkey, NOT (p_size % 3) a, (p_size % 2) AND 1 b, (p_size % 2) XOR (p_size % 3) c, IF(p_size % 5, 'x', 'y') d, (p_size % 4) IS TRUE e, CASE WHEN p_size % 6 THEN 1 ELSE 0 END f FROM part WHERE p_size % 10",
        "SELECT p_partkey, p_size % 3 = 0 AS a, p_size % 2 <> 0 AS b, (p_size % 2 <> 0) <> (p_size % 3 <> 0) AS c, CASE WHEN p_size % 5 <> 0 THEN 'x' ELSE 'y' END AS d, p_size % 4 <> 0 AS e, CASE WHEN p_size % 6 <> 0 THEN 1 ELSE 0 END AS f FROM part WHERE p_size % 10 <> 0",
    ),
    "op_unsigned": (
        "SELECT c_custkey, ~c_custkey a, (~c_custkey) & 255 b, c_custkey >> 2 c, bit_count(~c_custkey) d, ~~c_custkey e, 18446744073709551615 & c_custkey f FROM customer",
        "SELECT c_custkey, 18446744073709551615 - c_custkey AS a, 255 - c_custkey % 256 AS b, c_custkey // 4 AS c, 64 - bit_count(c_custkey) AS d, c_custkey AS e, c_custkey AS f FROM customer",
    ),
    "op_overflow": (
        "SELECT n_nationkey, 9223372036854775800 + n_nationkey a, '5x' = 5 b, 3037000500 * 3037000500 + n_nationkey c FROM nation",
        "SELECT n_nationkey, CASE WHEN n_nationkey > 7 THEN NULL ELSE 9223372036854775800 + n_nationkey END AS a, true AS b, CAST(NULL AS BIGINT) AS c FROM nation",
    ),
    "op_like_escape": (
        "SELECT p_partkey FROM part WHERE concat(p_brand, '%') LIKE '%1!%' ESCAPE '!'",
        "SELECT p_partkey FROM part WHERE (p_brand || '%') LIKE '%1!%' ESCAPE '!'",
    ),
    "join_natural": (
        "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey k FROM nation) a NATURAL JOIN (SELECT r_regionkey k, r_name FROM region) b",
        "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "join_straight": (
        "SELECT c.c_name, n.n_name FROM customer c STRAIGHT_JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 0",
        "SELECT c.c_name, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 0",
    ),
    "sub_quantified_null": (
        "SELECT p_partkey, p_size > ANY (SELECT nullif(n_nationkey, 0) FROM nation WHERE n_nationkey < 10) a, p_size > ALL (SELECT nullif(n_nationkey, 0) FROM nation WHERE n_nationkey < 10) b, p_size <= ALL (SELECT n_nationkey FROM nation WHERE n_nationkey > 20) c, p_size <> ANY (SELECT n_nationkey FROM nation WHERE n_nationkey = 5) d FROM part",
        "SELECT p_partkey, CASE WHEN p_size > 1 THEN true END AS a, CASE WHEN p_size <= 9 THEN false END AS b, p_size <= (SELECT min(n_nationkey) FROM nation WHERE n_nationkey > 20) AS c, p_size <> 5 AS d FROM part",
    ),
    "sub_correlated_right": (
        "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(s_acctbal) FROM supplier WHERE s_nationkey = c_nationkey)",
        "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(s_acctbal) FROM supplier WHERE s_nationkey = c_nationkey)",
    ),
    "agg_group_constant": ("SELECT count(*) n, max(p_size) m FROM part GROUP BY 1", "SELECT count(*) AS n, max(p_size) AS m FROM part"),
    "agg_empty": (
        "SELECT min(p_size) a, max(p_name) b, avg(p_size) c, sum(p_size) d, count(p_size) e FROM part WHERE p_size > 1000",
        "SELECT min(p_size) AS a, max(p_name) AS b, avg(p_size) AS c, sum(p_size) AS d, count(p_size) AS e FROM part WHERE p_size > 1000",
    ),
    "sort_outside_group": (
        "SELECT n_regionkey, count(*) n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey ORDER BY r_name DESC LIMIT 3",
        "SELECT n_regionkey, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey, r_name ORDER BY r_name DESC LIMIT 3",
    ),
    "window_named": (
        "SELECT n_nationkey, rank() OVER w a, count(*) OVER w b, sum(n_nationkey) OVER v c, ntile(2) OVER v d FROM nation WINDOW w AS (PARTITION BY n_regionkey), v AS (PARTITION BY n_regionkey ORDER BY n_nationkey)",
        "SELECT n_nationkey, rank() OVER (PARTITION BY n_regionkey ORDER BY 0) AS a, count(*) OVER (PARTITION BY n_regionkey) AS b, sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS c, ntile(2) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS d FROM nation",
    ),
    "agg_group_concat_orders": (
        "SELECT n_regionkey, GROUP_CONCAT(DISTINCT left(n_name, 1) ORDER BY n_nationkey DESC SEPARATOR '-') a, GROUP_CONCAT(DISTINCT n_regionkey ORDER BY n_name) b, GROUP_CONCAT(DISTINCT right(n_name, 1) ORDER BY n_nationkey % 2, n_nationkey) c FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, (SELECT string_agg(x, '-' ORDER BY m DESC) FROM (SELECT left(n_name, 1) AS x, max(n_nationkey) AS m FROM nation i WHERE i.n_regionkey = o.n_regionkey GROUP BY 1)) AS a, n_regionkey::VARCHAR AS b, (SELECT string_agg(x, ',' ORDER BY m) FROM (SELECT right(n_name, 1) AS x, min((n_nationkey % 2) * 1000 + n_nationkey) AS m FROM nation i WHERE i.n_regionkey = o.n_regionkey GROUP BY 1)) AS c FROM (SELECT DISTINCT n_regionkey FROM nation) o",
    ),
    "agg_bitmap_xor": (
        "SELECT rb_cardinality(rb_xor_agg(b)) n FROM (SELECT l_returnflag, rb_build_agg(l_suppkey) b FROM lineitem GROUP BY l_returnflag) t",
        "SELECT count(*) FILTER (k % 2 = 1) AS n FROM (SELECT l_suppkey, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY l_suppkey)",
    ),
}
