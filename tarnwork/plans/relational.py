"""Relational queries: scans, predicates, joins, aggregates, windows, sorting, set operations and scalar functions.

Each entry is Spark SQL; where the oracle's dialect differs, its own text follows. Every query reads whole tables, and a limit
stands only where it is the feature.
"""

from __future__ import annotations

import re

from tarnwork.runtime import load

TABLES = "region nation customer supplier part orders lineitem events documents embeddings docs exported_row training_tag embedding_row semantic_match_result live_server_log doc_label mix_target".split()
NAMES = re.compile(r"\b(" + "|".join(TABLES) + r")\b")


def run(text: str):
    """A query function: registers the tables the text names and hands it to Catalyst."""

    def query(spark, sf):
        for t in sorted(set(NAMES.findall(text))):
            load(spark, sf, t).createOrReplaceTempView(t)
        return spark.sql(text)

    return query


REVENUE = "l_extendedprice * (1 - l_discount)"
Q: dict[str, tuple[str, str]] = {}


def q(name: str, text: str, oracle: str | None = None) -> None:
    Q[name] = (text, oracle or text)


# Scans and predicates
q("scan_projection", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
q("filter_compare", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus <> 'F'")
q("filter_and_or", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice < 20000) AND 1000 < o_custkey")
q("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%' OR lower(p_name) LIKE '%1_'")
q("filter_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
q("filter_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount BETWEEN 0.02 AND 0.04")
q("filter_is_null", "SELECT id, category FROM docs WHERE category IS NULL OR created_at IS NULL")
q("filter_distinct_from", "SELECT id FROM docs WHERE category IS DISTINCT FROM 'changelog' AND category IS NOT NULL")
q("filter_case_cast", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, CAST(o_totalprice AS BIGINT) AS whole FROM orders",
  "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders")
q("filter_negative", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -500.0")
q("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 77")
q("select_constants", "SELECT 7 div 2 AS a, -7 % 2 AS b, 'x' || 'y' AS c, CAST(NULL AS STRING) AS d", "SELECT 7 // 2 AS a, -7 % 2 AS b, 'x' || 'y' AS c, CAST(NULL AS VARCHAR) AS d")
q("values_source", "SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, NULL) AS t(id, name)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)")

# Subqueries
q("subquery_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
q("subquery_not_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
q("subquery_exists", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)")
q("subquery_not_exists", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
q("subquery_scalar", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
q("subquery_correlated", "SELECT o_orderkey, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS n FROM orders o")
q("subquery_from", "SELECT seg, count(*) AS n FROM (SELECT c_mktsegment AS seg, c_acctbal FROM customer WHERE c_acctbal > 0) t GROUP BY seg")
q("cte_with", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 500000) SELECT c_nationkey, count(*) AS n, round(sum(total), 2) AS total FROM top JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")

# Joins
q("join_inner", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
q("join_left", "SELECT o.o_orderkey, count(l.l_orderkey) AS n FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey")
q("join_right", "SELECT d.doc_id, l.abusive FROM doc_label l RIGHT JOIN documents d ON l.doc_id = d.doc_id")
q("join_full", "SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal < 3000 GROUP BY s_nationkey) s ON c.c_nationkey = s.s_nationkey")
q("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
q("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
q("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
q("join_anti", "SELECT o_orderkey FROM orders LEFT ANTI JOIN lineitem ON o_orderkey = l_orderkey", "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
q("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
q("join_using", "SELECT tag_name, count(*) AS n, max(seed) AS seed FROM exported_row JOIN training_tag USING (tag_name) GROUP BY tag_name")
q("join_natural", "SELECT tag_name, primary_key, seed FROM exported_row NATURAL JOIN training_tag")
q("join_lateral", "SELECT n_name, t.best FROM nation, LATERAL (SELECT max(c_acctbal) AS best FROM customer WHERE c_nationkey = n_nationkey) t")
q("join_asof", """
SELECT event_id, purchase_id FROM (
  SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END) IGNORE NULLS OVER (
    PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, event_id ROWS UNBOUNDED PRECEDING) AS purchase_id
  FROM events WHERE event_type IN ('purchase', 'error')) t
WHERE event_type = 'error' AND purchase_id IS NOT NULL
""",
  "SELECT e.event_id, max_by(p.event_id, struct_pack(a := p.ts, b := p.event_id)) AS purchase_id FROM events e JOIN events p ON e.user_id = p.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts WHERE e.event_type = 'error' GROUP BY e.event_id")

# Aggregates
q("agg_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber) AS lines, round(sum(l_extendedprice), 2) AS total, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
  "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, round(sum(l_extendedprice), 2) AS total, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
q("agg_avg_minmax", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY o_orderpriority")
q("agg_stddev_var", "SELECT event_type, round(stddev(value), 6) AS sd, round(stddev_pop(value), 6) AS sdp, round(stddev_samp(value), 6) AS sds, round(variance(value), 4) AS v, round(var_pop(value), 4) AS vp, round(var_samp(value), 4) AS vs FROM events GROUP BY event_type")
q("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, sum(DISTINCT CAST(o_totalprice / 10000 AS INT)) AS steps FROM orders GROUP BY o_orderstatus",
  "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, CAST(sum(DISTINCT CAST(trunc(o_totalprice / 10000) AS INT)) AS BIGINT) AS steps FROM orders GROUP BY o_orderstatus")
q("agg_filter", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS spent FROM events GROUP BY user_id")
q("agg_string", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
q("agg_array", "SELECT n_regionkey, array_join(sort_array(array_agg(n_nationkey)), ',') AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_nationkey)), ',') AS keys FROM nation GROUP BY n_regionkey")
q("agg_argmax", "SELECT o_orderpriority, max_by(o_orderkey, o_totalprice) AS top FROM orders GROUP BY o_orderpriority")
q("agg_median", "SELECT event_type, round(percentile(value, 0.5), 6) AS median FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type")
q("group_multi", "SELECT n_regionkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, c_mktsegment")
q("group_expr", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)")
q("group_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
q("group_having", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 50 AND avg(c_acctbal) > 4000")
q("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
q("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
q("rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
q("pivot", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
  "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY o_orderpriority")
q("select_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
q("distinct_on", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r = 1",
  "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
q("agg_on_nulls", "SELECT count(*) AS rows, count(abusive) AS rated, count(DISTINCT rater) AS raters, sum(abusive) AS abusive FROM doc_label", "SELECT count(*) AS rows, count(abusive) AS rated, count(DISTINCT rater) AS raters, CAST(sum(abusive) AS BIGINT) AS abusive FROM doc_label")

# Windows
W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
q("win_row_number", f"SELECT o_orderkey, row_number() OVER ({W}) AS rn FROM orders")
q("win_rank", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment), 8) AS pr, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment), 8) AS cd FROM customer")
q("win_ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quarter FROM customer")
q("win_lag_lead", f"SELECT o_orderkey, lag(o_totalprice, 1) OVER ({W}) AS before, lead(o_orderkey, 2, -1) OVER ({W}) AS after FROM orders")
q("win_first_last", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({W}) AS a, last_value(o_orderkey) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z, nth_value(o_orderkey, 2) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders")
q("win_running_sum", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({W} ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
q("win_moving_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS m FROM events")
q("win_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 10000 PRECEDING AND 10000 FOLLOWING) AS near FROM orders")
q("win_share", "SELECT n_nationkey, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY n_regionkey), 6) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey")
q("win_qualify", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) t WHERE r <= 3", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")

# Sorting and limits
q("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
q("sort_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 20")
q("offset_past_end", "SELECT r_name FROM region ORDER BY r_name LIMIT 5 OFFSET 10")
q("sort_nulls", "SELECT id, category FROM docs ORDER BY category ASC NULLS LAST, id LIMIT 50")
q("sort_nulls_first", "SELECT id, category FROM docs ORDER BY category DESC NULLS FIRST, id LIMIT 50")
q("topn_per_group", "SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) t WHERE r <= 3")

# Set operations
q("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
q("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
q("intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
q("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
q("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
q("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")

# Scalar functions
q("fn_arith_div_mod", "SELECT o_orderkey, o_custkey div 7 AS d, o_custkey % 7 AS m, -o_custkey div 7 AS nd, -o_custkey % 7 AS nm, o_totalprice / 3 AS f FROM orders",
  "SELECT o_orderkey, o_custkey // 7 AS d, o_custkey % 7 AS m, -(o_custkey // 7) AS nd, -o_custkey % 7 AS nm, o_totalprice / 3 AS f FROM orders")
q("fn_math", "SELECT event_id, round(sqrt(abs(value)), 6) AS s, ceil(value) AS c, floor(value) AS f, round(power(value, 2), 4) AS p, round(ln(1 + abs(value)), 6) AS l, round(exp(-abs(value) / 1000), 6) AS e, sign(value) AS g, round(cbrt(value), 6) AS cb, round(sin(value), 6) AS sn, round(atan2(value, 2), 6) AS at FROM events",
  "SELECT event_id, round(sqrt(abs(value)), 6) AS s, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(value) AS BIGINT) AS f, round(power(value, 2), 4) AS p, round(ln(1 + abs(value)), 6) AS l, round(exp(-abs(value) / 1000), 6) AS e, CAST(sign(value) AS DOUBLE) AS g, round(cbrt(value), 6) AS cb, round(sin(value), 6) AS sn, round(atan2(value, 2), 6) AS at FROM events")
q("fn_string", "SELECT c_custkey, upper(c_name) AS u, length(c_name) AS n, substr(c_name, 1, 4) AS s, lpad(c_mktsegment, 12, '.') AS lp, rpad(c_mktsegment, 12, '.') AS rp, reverse(c_name) AS rv, replace(c_name, '0', 'o') AS rep, repeat(left(c_name, 1), 3) AS rr, concat_ws('-', c_mktsegment, c_name) AS cw, instr(c_name, '#') AS pos, startswith(c_name, 'Cust') AS sw, initcap(lower(c_mktsegment)) AS ic, translate(c_name, '01', 'ab') AS tr, ascii(c_name) AS a, md5(c_name) AS h, sha2(c_name, 256) AS h2, levenshtein(c_mktsegment, 'BUILDING') AS lev, split_part(c_name, '#', 2) AS sp FROM customer",
  "SELECT c_custkey, upper(c_name) AS u, CAST(length(c_name) AS INT) AS n, substr(c_name, 1, 4) AS s, lpad(c_mktsegment, 12, '.') AS lp, rpad(c_mktsegment, 12, '.') AS rp, reverse(c_name) AS rv, replace(c_name, '0', 'o') AS rep, repeat(left(c_name, 1), 3) AS rr, concat_ws('-', c_mktsegment, c_name) AS cw, CAST(instr(c_name, '#') AS INT) AS pos, starts_with(c_name, 'Cust') AS sw, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS ic, translate(c_name, '01', 'ab') AS tr, ascii(c_name) AS a, md5(c_name) AS h, sha256(c_name) AS h2, CAST(levenshtein(c_mktsegment, 'BUILDING') AS INT) AS lev, split_part(c_name, '#', 2) AS sp FROM customer")
q("fn_regex", "SELECT p_partkey, p_type RLIKE '^[A-M]' AS early, regexp_replace(p_name, '[0-9]+', 'N') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS number FROM part",
  "SELECT p_partkey, regexp_matches(p_type, '^[A-M]') AS early, regexp_replace(p_name, '[0-9]+', 'N', 'g') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS number FROM part")
q("fn_date", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, extract(quarter FROM o_orderdate) AS qtr, dayofyear(o_orderdate) AS doy, o_orderdate + INTERVAL 3 DAYS AS later, datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS left, date_format(o_orderdate, 'yyyy-MM') AS ym FROM orders",
  "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, CAST(extract(quarter FROM o_orderdate) AS INT) AS qtr, CAST(dayofyear(o_orderdate) AS INT) AS doy, o_orderdate + INTERVAL 3 DAYS AS later, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INT) AS left, strftime(o_orderdate, '%Y-%m') AS ym FROM orders")
q("fn_conditional", "SELECT id, coalesce(category, 'none') AS c, nullif(batch_no, 0) AS b, greatest(batch_no, 2) AS g, least(batch_no, 2) AS l, if(length(text) > 100, 'long', 'short') AS size FROM docs",
  "SELECT id, coalesce(category, 'none') AS c, nullif(batch_no, 0) AS b, greatest(batch_no, 2) AS g, least(batch_no, 2) AS l, CASE WHEN length(text) > 100 THEN 'long' ELSE 'short' END AS size FROM docs")
q("fn_array", "SELECT vec_id, size(embedding) AS n, array_position(sort_array(array(label, 3, 1)), 3) AS pos, array_contains(array(1, 2, 3), label) AS has, array_join(array_distinct(array(label, 1, 1)), '-') AS d, array_join(array_union(array(1, 2), array(label)), '-') AS u, array_join(slice(array(5, 6, 7, 8), 2, 2), '-') AS s FROM embeddings",
  "SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(list_position(list_sort([label, 3, 1]), 3) AS BIGINT) AS pos, list_contains([1, 2, 3], label) AS has, CASE WHEN label = 1 THEN '1' ELSE concat_ws('-', label, 1) END AS d, CASE WHEN label IN (1, 2) THEN '1-2' ELSE concat_ws('-', 1, 2, label) END AS u, '6-7' AS s FROM embeddings")
q("fn_unnest", "SELECT vec_id, pos, round(CAST(x AS DOUBLE), 6) AS x FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, x", "SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(CAST(embedding[i] AS DOUBLE), 6) AS x FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) t")
q("fn_struct_map", "SELECT n_nationkey, named_struct('a', n_name, 'b', n_regionkey).a AS a, map('k', n_name, 'j', 'x')['k'] AS v, element_at(map_values(map('r', n_regionkey)), 1) AS r FROM nation",
  "SELECT n_nationkey, n_name AS a, n_name AS v, n_regionkey AS r FROM nation")
q("fn_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
q("fn_cast", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST(o_totalprice AS DECIMAL(12, 1)) AS d, CAST(o_orderdate AS DATE) AS dt, try_cast(o_orderpriority AS INT) AS bad, o_custkey::double AS f FROM orders",
  "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_totalprice AS DECIMAL(12, 1)) AS d, CAST(o_orderdate AS DATE) AS dt, TRY_CAST(o_orderpriority AS INT) AS bad, o_custkey::double AS f FROM orders")
q("fn_concat_null", "SELECT id, category || '!' AS c FROM docs")

# Hybrid analytical shapes
q("htap_count", "SELECT count(*) AS n FROM lineitem")
q("htap_group", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
q("htap_filtered_sum", f"SELECT round(sum({REVENUE}), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount > 0.03")
q("htap_top_users", "SELECT user_id, round(sum(value), 4) AS total FROM events GROUP BY user_id ORDER BY total DESC, user_id LIMIT 20")
q("htap_two_dims", "SELECT event_type, hour(ts) AS h, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type, hour(ts)", "SELECT event_type, CAST(hour(ts) AS INT) AS h, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type, hour(ts)")
q("htap_star", f"SELECT r_name AS region, count(*) AS n, round(sum({REVENUE}), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")

# Event-time windows in their batch form
q("stream_tumbling", "SELECT w.start AS start, event_type, count(*) AS n FROM (SELECT window(ts, '1 day') AS w, event_type FROM events) t GROUP BY w, event_type", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
q("stream_sliding", "SELECT w.start AS start, count(*) AS n FROM (SELECT window(ts, '2 hours', '1 hour') AS w FROM events) t GROUP BY w", "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY start")
q("stream_session", "SELECT user_id, w.start AS start, count(*) AS n FROM (SELECT user_id, session_window(ts, '2 hours') AS w FROM events) t GROUP BY user_id, w",
  "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 2 HOURS, true) AS gap FROM events)) GROUP BY user_id, s")

def queries():
    return {name: run(text) for name, (text, _) in Q.items()}


def oracle_sql():
    return {name: oracle for name, (_, oracle) in Q.items()}
