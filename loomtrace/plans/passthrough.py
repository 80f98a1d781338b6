"""Relational queries that users run through the SQL surface (class P). One statement serves both
engines where their dialects agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views as V

#: name: (tables, statement, DuckDB statement if it differs)
STATEMENTS: dict[str, tuple[str, str] | tuple[str, str, str]] = {
    "p_join_inner": ("customer nation orders", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "p_join_left": ("customer orders", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "p_join_full": ("customer supplier", "SELECT c_nationkey, s_nationkey, count(*) AS n FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey > 3) c FULL JOIN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 20) s ON c_nationkey = s_nationkey GROUP BY c_nationkey, s_nationkey"),
    "p_join_semi": ("customer orders", "SELECT c_custkey FROM customer LEFT SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON o_custkey = c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "p_join_anti": ("customer orders", "SELECT c_custkey FROM customer LEFT ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON o_custkey = c_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "p_join_theta": ("nation region", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    # One window over both event types: a purchase takes the last click before it, in one sort per user.
    "p_asof": ("events", "SELECT event_id, last_click FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'click' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click FROM events WHERE event_type IN ('purchase', 'click')) t WHERE event_type = 'purchase'", "SELECT p.event_id, max(c.ts) AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND c.ts <= p.ts GROUP BY p.event_id"),
    "p_join_right": ("customer orders", "SELECT c_custkey, count(o_orderkey) AS n FROM orders RIGHT JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey"),
    "p_join_cross": ("nation region", "SELECT n_name, r_name FROM nation CROSS JOIN region"),
    # Hour buckets make the range an equality: each click meets the two buckets that its hour reaches.
    "p_join_range": ("events", "SELECT p.event_id, count(*) AS clicks FROM (SELECT event_id, user_id, ts, explode(array(unix_seconds(ts) div 3600 - 1, unix_seconds(ts) div 3600)) AS h FROM (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE event_type = 'purchase') x) p JOIN (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, unix_seconds(CAST(ts AS TIMESTAMP)) div 3600 AS h FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.h = c.h AND c.ts <= p.ts AND c.ts > p.ts - INTERVAL '1' HOUR GROUP BY p.event_id", "SELECT p.event_id, count(*) AS clicks FROM events p JOIN events c ON p.event_type = 'purchase' AND c.event_type = 'click' AND p.user_id = c.user_id AND c.ts <= p.ts AND c.ts > p.ts - INTERVAL '1 hour' GROUP BY p.event_id"),
    "p_percentile": ("orders", "SELECT o_orderpriority, round(percentile(o_totalprice, 0.5), 4) AS med, round(percentile(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority"),
    # A sketch is compared by its promise: within a tenth of the exact count.
    "p_approx_distinct": ("orders", "SELECT o_orderpriority, abs(approx_count_distinct(o_custkey, 0.02) - count(DISTINCT o_custkey)) <= 0.1 * count(DISTINCT o_custkey) AS close FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.25 * count(DISTINCT o_custkey) AS close FROM orders GROUP BY o_orderpriority"),
    "p_union_all": ("customer supplier", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) t GROUP BY k"),
    "p_intersect_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    "p_except_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "p_pivot_clause": ("lineitem", "SELECT * FROM (SELECT l_returnflag, l_linestatus FROM lineitem) PIVOT (count(*) FOR l_linestatus IN ('O' AS o, 'F' AS f))", "SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS f FROM lineitem GROUP BY l_returnflag"),
    "p_math": ("orders", "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS s, round(ln(o_totalprice), 6) AS l, o_orderkey % 7 AS m, sign(o_totalprice - 100000) AS g FROM orders", "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS s, round(ln(o_totalprice), 6) AS l, o_orderkey % 7 AS m, CAST(sign(o_totalprice - 100000) AS DOUBLE) AS g FROM orders"),
    "p_map": ("labels", "SELECT doc_id, map_values(m)[0] AS q, size(map_keys(m)) AS n FROM (SELECT doc_id, map('quality', quality, 'toxic', toxic) AS m FROM labels) t", "SELECT doc_id, map_values(m)[1] AS q, CAST(cardinality(m) AS INTEGER) AS n FROM (SELECT doc_id, MAP {'quality': quality, 'toxic': toxic} AS m FROM labels) t"),
    "p_hop": ("events", "SELECT window(ts, '2 hours', '1 hour').start AS w, count(*) AS n FROM events GROUP BY window(ts, '2 hours', '1 hour')", "SELECT time_bucket(INTERVAL '1 hour', ts) - to_hours(CAST(k AS INTEGER)) AS w, count(*) AS n FROM events, range(0, 2) r(k) GROUP BY ALL"),
    "p_agg_pricing": ("lineitem", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"),
    "p_agg_distinct": ("lineitem", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag"),
    "p_agg_filter_having": ("lineitem", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 10"),
    "p_rollup": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "p_cube": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "p_gsets": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
    "p_pivot": ("lineitem", "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS o, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS f FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f FROM lineitem GROUP BY l_returnflag"),
    "p_win_rank": ("events", "SELECT event_id, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "p_win_dist": ("events", "SELECT event_id, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "p_win_shift": ("events", "SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id) OVER w AS next, first_value(event_id) OVER w AS first, nth_value(event_id, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "p_win_rows": ("events", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s FROM events"),
    "p_win_range": ("events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM events"),
    "p_topk": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "p_topk_group": ("orders", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3"),
    "p_union": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "p_intersect": ("customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "p_except": ("customer orders", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000"),
    "p_recursive": ("conversations", "WITH RECURSIVE t(conv_id, turn, depth) AS (SELECT conv_id, turn, 0 FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, t.depth + 1 FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1) SELECT conv_id, max(depth) AS depth FROM t GROUP BY conv_id"),
    "p_subquery": ("customer orders", "SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey) AND c_nationkey IN (SELECT max(c_nationkey) FROM customer)"),
    "p_correlated": ("orders", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)"),
    "p_json": ("events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "p_variant": ("events", "SELECT event_id, variant_get(v, '$.k', 'int') AS k, try_variant_get(v, '$.none', 'string') AS none, schema_of_variant(variant_get(v, '$.k')) = 'BIGINT' AS whole FROM (SELECT event_id, parse_json(props) AS v FROM events) t", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(NULL AS VARCHAR) AS none, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS whole FROM events"),
    "p_date": ("orders", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS n FROM orders GROUP BY ALL"),
    "p_string": ("customer", "SELECT c_custkey, upper(c_mktsegment) AS u, substr(c_name, 1, 5) AS s, length(c_name) AS l, replace(c_name, '#', '-') AS r FROM customer", "SELECT c_custkey, upper(c_mktsegment) AS u, substr(c_name, 1, 5) AS s, CAST(length(c_name) AS INTEGER) AS l, replace(c_name, '#', '-') AS r FROM customer"),
    "p_explode": ("embeddings", "SELECT vec_id, pos AS i, round(CAST(x AS DOUBLE), 6) AS x FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x", "SELECT vec_id, CAST(i AS INTEGER) AS i, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS x FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings) t"),
    "p_tumble": ("events", "SELECT window(ts, '1 hour').start AS w, event_type, count(*) AS n, round(sum(value), 6) AS v FROM events GROUP BY window(ts, '1 hour'), event_type", "SELECT time_bucket(INTERVAL '1 hour', ts) AS w, event_type, count(*) AS n, round(sum(value), 6) AS v FROM events GROUP BY ALL"),
    "p_session": ("events", "SELECT user_id, session_window(ts, '6 hours').start AS s, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '6 hours')", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '6 hours' AND ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS s, count(*) AS n FROM g GROUP BY user_id, g"),
}


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    tables, statement = STATEMENTS[name][:2]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        V.load(spark, sf_dir, *tables.split())
        return spark.sql(statement)

    return run


QUERIES = {name: _run(name) for name in STATEMENTS}
SQL = {name: x[-1] for name, x in STATEMENTS.items()}
