"""Generic relational coverage on the star schema and the event stream (inventory 2.16); names begin with x_."""

from __future__ import annotations

from quillstone.queries.measures import big, near
from quillstone.queries.registry import Registry

R = Registry()


def sql(name: str):
    def register(build):
        R.sql(name, build)
        return build

    return register


@sql("x_inner_join_revenue")
def _(d):
    return f"SELECT n_name, {near('sum(l_extendedprice * (1 - l_discount))', 'revenue')}, {big('count(*)', 'n')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


@sql("x_left_join_customers")
def _(d):
    return f"SELECT c_custkey, {big('count(o_orderkey)', 'orders')}, {near('coalesce(sum(o_totalprice), 0.0)', 'total')} FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"


@sql("x_semi_join")
def _(d):
    return "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"


@sql("x_anti_join")
def _(d):
    return "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"


@sql("x_band_join")
def _(d):
    # the order key equates first; the band is a residual of that join
    days = "datediff(l_shipdate, o_orderdate)" if d.engine == "spark" else "datediff('day', o_orderdate, l_shipdate)"
    return f"SELECT o_orderpriority, {big('count(*)', 'n')} FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND {days} BETWEEN 0 AND 30 GROUP BY o_orderpriority"


@sql("x_asof_last_purchase")
def _(d):
    return f"SELECT event_id, user_id, {'last_value(CASE WHEN event_type = ' + chr(39) + 'purchase' + chr(39) + ' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)' if d.engine == 'duckdb' else 'last(CASE WHEN event_type = ' + chr(39) + 'purchase' + chr(39) + ' THEN event_id END, true) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)'} AS last_purchase FROM events"


@sql("x_cube")
def _(d):
    return f"SELECT l_returnflag, l_linestatus, {near('sum(l_quantity)', 'quantity')} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"


@sql("x_rollup")
def _(d):
    return f"SELECT l_returnflag, l_linestatus, {big('count(*)', 'n')}, {near('avg(l_discount) + 1e-9', 'discount')} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"


@sql("x_grouping_sets")
def _(d):
    return f"SELECT o_orderstatus, o_orderpriority, {big('count(*)', 'n')} FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"


@sql("x_pricing_summary")
def _(d):
    return f"SELECT l_returnflag, l_linestatus, {near('sum(l_quantity)', 'qty')}, {near('sum(l_extendedprice)', 'base')}, {near('sum(l_extendedprice * (1 - l_discount))', 'disc')}, {near('avg(l_quantity)', 'avg_qty')}, {big('count(*)', 'n')} FROM lineitem GROUP BY l_returnflag, l_linestatus"


@sql("x_rank_lag_lead")
def _(d):
    return f"SELECT o_orderkey, {big('rank() OVER w', 'rk')}, {big('row_number() OVER w', 'rn')}, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@sql("x_running_frame")
def _(d):
    return f"SELECT o_orderkey, {near('sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 'recent')} FROM orders"


@sql("x_union_of_keys")
def _(d):
    return "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"


@sql("x_intersect_of_keys")
def _(d):
    return "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part"


@sql("x_except_of_keys")
def _(d):
    return "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders"


@sql("x_tumbling_window")
def _(d):
    bucket = d.div(d.micros("ts"), "3600000000")
    return f"SELECT {big(bucket, 'hour')}, event_type, {big('count(*)', 'n')}, {near('sum(value)', 'total')} FROM events GROUP BY {bucket}, event_type"


@sql("x_sliding_window")
def _(d):
    first = d.div(d.micros("ts"), "1800000000")
    return f"WITH s AS (SELECT {first} AS w, value FROM events UNION ALL SELECT {first} - 1, value FROM events) SELECT {big('w', 'half_hour')}, {big('count(*)', 'n')}, {near('avg(value)', 'mean')} FROM s GROUP BY w"


@sql("x_session_window")
def _(d):
    return f"WITH g AS (SELECT user_id, ts, event_id, CASE WHEN {d.micros('ts')} - lag({d.micros('ts')}) OVER w <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, {big('session', 'session')}, {big('count(*)', 'events')} FROM s GROUP BY user_id, session"


@sql("x_json_extract")
def _(d):
    return f"SELECT event_id, {big('CAST(' + d.json('props', 'k') + ' AS BIGINT)', 'k')} FROM events"


@sql("x_date_truncation")
def _(d):
    return f"SELECT year(o_orderdate) * 100 + month(o_orderdate) AS ym, {big('count(*)', 'n')} FROM orders GROUP BY year(o_orderdate) * 100 + month(o_orderdate)".replace("SELECT year", "SELECT CAST(year").replace("month(o_orderdate) AS ym", "month(o_orderdate) AS BIGINT) AS ym")


@sql("x_top_parts_per_brand")
def _(d):
    return f"WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_brand, p_partkey, p_retailprice, {big('k', 'k')} FROM r WHERE k <= 3"


@sql("x_pivot_by_hand")
def _(d):
    return f"SELECT o_orderpriority, {d.pick(chr(39) + 'F' + chr(39) + ' = o_orderstatus')} AS f, {d.pick(chr(39) + 'O' + chr(39) + ' = o_orderstatus')} AS o, {d.pick(chr(39) + 'P' + chr(39) + ' = o_orderstatus')} AS p FROM orders GROUP BY o_orderpriority"
