"""Queries for the operators of the query surface, with the SQL that gives the same rows."""

from __future__ import annotations

import dataclasses
import datetime as dt
import io
import operator
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import naming
from sparkloom.operators import explore, results
from sparkloom.operators.query import Inputs, Query, is_in, is_in_collection, lag, rank, row_number, same, select, values
from sparkloom.runtime import shared_path, table

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "sales_order", "order_detail")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def given(spark: SparkSession, root: str) -> Inputs:
    return Inputs({n: table(spark, root, n) for n in NAMES})


def query(sql: str | None) -> Callable:
    """Register a function that builds a Query (or a DataFrame from session and directory) under its name."""

    def add(f: Callable) -> Callable:
        if f.__code__.co_argcount:
            QUERIES[f.__name__] = f
        else:
            QUERIES[f.__name__] = lambda spark, root: f().to_df(given(spark, root))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def money(c):
    return F.round(c, 2)


# --- scans, projections, filters


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled, year(o_orderdate) AS year FROM orders")
def scan_map() -> Query:
    return select("orders").map(lambda o: {"o_orderkey": o.o_orderkey, "doubled": o.o_totalprice * 2, "year": F.year(o.o_orderdate).cast("bigint")})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def where_chain() -> Query:
    q = select("orders").where(lambda o: o.o_totalprice > 100000).where(lambda o: o.o_orderstatus == "F")
    return q.map(lambda o: {"o_orderkey": o.o_orderkey, "o_totalprice": o.o_totalprice})


@query("SELECT id, freight FROM sales_order WHERE NOT coalesce(freight > 50, false)")
def where_not() -> Query:
    return select("sales_order").where_not(lambda s: s.freight > 50).map(lambda s: {"id": s.id, "freight": s.freight})


@query("SELECT c_custkey, upper(c_name) AS name FROM customer WHERE c_acctbal < 0")
def collect_partial() -> Query:
    return select("customer").collect(lambda c: c.c_acctbal < 0, lambda c: {"c_custkey": c.c_custkey, "name": F.upper(c.c_name)})


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS value FROM part")
def map_concat() -> Query:
    return select("part").map_concat(lambda p: F.transform(F.split(p.p_name, " "), lambda w: F.struct(p.p_partkey.alias("p_partkey"), w.alias("value"))))


@query("SELECT n_name, r_name FROM region, nation WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def flat_map_join() -> Query:
    return select("region").where(lambda r: r.r_name != "ASIA").flat_map(
        lambda r: select("nation").where(lambda n: n.n_regionkey == r.r_regionkey).map(lambda n: {"n_name": n.n_name, "r_name": r.r_name})
    )


@query("SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def flat_map_grouped() -> Query:
    """A dependent query that groups: the enclosing row joins the group's key."""
    return select("region").flat_map(
        lambda r: select("nation").where(lambda n: n.n_regionkey == r.r_regionkey).group_by(lambda n: n.n_regionkey).aggregate(lambda k, a: {"n": a.size()}).map(lambda g: {"r_name": r.r_name, "n": g.n})
    )


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def where_exists() -> Query:
    q = select("customer").where_exists(lambda c: select("orders").where(lambda o: (o.o_custkey == c.c_custkey) & (o.o_totalprice > 400000)))
    return q.map(lambda c: {"c_custkey": c.c_custkey})


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def where_not_exists() -> Query:
    q = select("customer").where_not_exists(lambda c: select("orders").where(lambda o: (o.o_custkey == c.c_custkey) & (o.o_totalprice > 400000)))
    return q.map(lambda c: {"c_custkey": c.c_custkey})


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey < s_nationkey AND n_regionkey = 4)")
def where_exists_theta() -> Query:
    q = select("supplier").where_exists(lambda s: select("nation").where(lambda n: (n.n_nationkey < s.s_nationkey) & (n.n_regionkey == 4)))
    return q.map(lambda s: {"s_suppkey": s.s_suppkey})


@query("SELECT id FROM sales_order WHERE ship_region IS NULL OR ship_region IN ('Coast', 'Lakes')")
def is_in_null_safe() -> Query:
    return select("sales_order").where(lambda s: is_in(s.ship_region, "Coast", "Lakes", None)).map(lambda s: {"id": s.id})


@query("SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
def is_in_local_collection() -> Query:
    return select("nation").where(lambda n: is_in_collection(n.n_regionkey, {1, 3})).map(lambda n: {"n_name": n.n_name})


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(k, v)")
def constant_scan(spark: SparkSession, root: str) -> DataFrame:
    return values(spark, [(1, "a"), (2, "b")], "k int, v string").to_df()


@query(
    "SELECT id, upper(trim(customer_id)) AS customer, substr(ship_name, 1, 6) AS head, length(ship_city) AS n, ship_city = reverse(ship_city) AS palindrome, "
    "regexp_replace(ship_address, '[0-9]+', '#') AS address, upper(substr(ship_country, 1, 1)) || substr(ship_country, 2) AS country FROM sales_order"
)
def string_expressions() -> Query:
    return select("sales_order").map(
        lambda s: {
            "id": s.id, "customer": F.upper(F.trim(s.customer_id)), "head": F.substring(s.ship_name, 1, 6), "n": F.length(s.ship_city).cast("bigint"),
            "palindrome": s.ship_city == F.reverse(s.ship_city), "address": F.regexp_replace(s.ship_address, "^([^0-9]*)[0-9]+", "$1#"),
            "country": F.concat(F.upper(F.substring(s.ship_country, 1, 1)), F.substr(s.ship_country, F.lit(2))),
        }
    )


# --- joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def inner_join() -> Query:
    q = select("orders").join(select("customer").where(lambda c: c.c_mktsegment == "BUILDING")).on(lambda o, c: o.o_custkey == c.c_custkey)
    return q.map(lambda o, c: {"o_orderkey": o.o_orderkey, "c_name": c.c_name})


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 1000 * n_regionkey")
def theta_join() -> Query:
    q = select("supplier").join(select("nation")).on(lambda s, n: (s.s_nationkey == n.n_nationkey) & (s.s_acctbal > 1000 * n.n_regionkey))
    return q.map(lambda s, n: {"s_suppkey": s.s_suppkey, "n_name": n.n_name})


@query("SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join() -> Query:
    q = select("nation").join(select("nation")).on(lambda a, b: (a.n_regionkey == b.n_regionkey) & (a.n_nationkey < b.n_nationkey))
    return q.map(lambda a, b: {"low": a.n_name, "high": b.n_name})


@query("SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey < n_regionkey")
def cross_join() -> Query:
    q = select("region").cross_join(select("nation")).on(lambda r, n: r.r_regionkey < n.n_regionkey)
    return q.map(lambda r, n: {"r_name": r.r_name, "n_name": n.n_name})


@query("SELECT c_custkey, o_orderkey, o_orderkey IS NOT NULL AS matched FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
def left_join() -> Query:
    q = select("customer").left_join(select("orders")).on(lambda c, o: (o.o_custkey == c.c_custkey) & (o.o_totalprice > 400000))
    return q.map(lambda c, o: {"c_custkey": c.c_custkey, "o_orderkey": o.o_orderkey, "matched": o.is_defined()})


@query("SELECT s.id, s.ship_region, g.n FROM sales_order s JOIN (SELECT ship_region, count(*) AS n FROM sales_order GROUP BY 1) g ON s.ship_region IS NOT DISTINCT FROM g.ship_region")
def null_safe_join() -> Query:
    """Missing regions meet the missing region's count."""
    sizes = select("sales_order").group_by(lambda s: s.ship_region).aggregate(lambda k, a: {"region": k, "n": a.size()})
    q = select("sales_order").join(sizes).on(lambda s, g: same(s.ship_region, g.region))
    return q.map(lambda s, g: {"id": s.id, "ship_region": s.ship_region, "n": g.n})


@query("SELECT p_partkey, n_name FROM part JOIN nation ON list_contains([p_size, p_size + 1, 2 * p_size], n_nationkey)")
def contains_join() -> Query:
    parts = select("part").map(lambda p: {"p_partkey": p.p_partkey, "sizes": F.array(p.p_size, p.p_size + 1, p.p_size * 2)})
    return parts.join_containing(select("nation"), lambda p: p.sizes, lambda n: n.n_nationkey).map(lambda p, n: {"p_partkey": p.p_partkey, "n_name": n.n_name})


# --- grouping and aggregation


@query(
    "SELECT c_mktsegment AS segment, round(avg(o_totalprice), 2) AS mean, round(sum(o_totalprice), 2) AS total, count(*) AS n "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY 1 ORDER BY 1"
)
def segment_report() -> Query:
    """The flagship: filter, joins, grouping with combined aggregates, order."""
    near = select("customer").join(select("nation").where(lambda n: n.n_regionkey == 1)).on(lambda c, n: c.c_nationkey == n.n_nationkey)
    q = select("orders").join(near).on(lambda o, cn: o.o_custkey == cn.left.c_custkey)
    return (
        q.group_by(lambda p: p.right.left.c_mktsegment)
        .aggregate(lambda s, a: {"segment": s, "stats": a.avg_by(lambda p: p.left.o_totalprice) & a.sum_by(lambda p: p.left.o_totalprice) & a.size()})
        .map(lambda r: {"segment": r.segment, "mean": money(r.stats._1), "total": money(r.stats._2), "n": r.stats._3})
        .order_by(lambda r: r.segment)
    )


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def group1() -> Query:
    return select("lineitem").group_by(lambda x: x.l_returnflag).aggregate(lambda k, a: {"l_returnflag": k, "n": a.size()})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def group2() -> Query:
    return select("lineitem").group_by(lambda x: x.l_returnflag, lambda x: x.l_linestatus).aggregate(lambda k, j, a: {"l_returnflag": k, "l_linestatus": j, "n": a.size()})


@query("SELECT ship_region, ship_via, year(order_date) AS year, count(*) AS n FROM sales_order GROUP BY ALL")
def group3_with_nulls() -> Query:
    q = select("sales_order").group_by(lambda s: s.ship_region, lambda s: s.ship_via, lambda s: F.year(s.order_date).cast("bigint"))
    return q.aggregate(lambda r, v, y, a: {"ship_region": r, "ship_via": v, "year": y, "n": a.size()})


@query(
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS a, round(stddev_pop(l_discount), 8) AS d, "
    "count(*) FILTER (WHERE l_tax > 0.04) AS c FROM lineitem GROUP BY ALL"
)
def agg_numeric() -> Query:
    q = select("lineitem").group_by(lambda x: x.l_returnflag, lambda x: x.l_linestatus)
    return q.aggregate(
        lambda k, j, a: {
            "l_returnflag": k, "l_linestatus": j, "s": a.sum_by(lambda x: x.l_quantity).map(money), "a": a.avg_by(lambda x: x.l_extendedprice).map(lambda c: F.round(c, 4)),
            "d": a.std_by(lambda x: x.l_discount).map(lambda c: F.round(c, 8)), "c": a.count(lambda x: x.l_tax > 0.04),
        }
    )


@query(
    "SELECT ship_country, CASE WHEN count(*) > count(freight) THEN NULL ELSE min(freight) END AS least, max(freight) AS most, min(order_date) FILTER (WHERE order_date IS NOT NULL) AS d FROM sales_order GROUP BY 1"
)
def agg_min_max() -> Query:
    """A missing value counts as the least."""
    q = select("sales_order").group_by(lambda s: s.ship_country)
    return q.aggregate(lambda k, a: {"ship_country": k, "least": a.min_of(lambda s: s.freight), "most": a.max_of(lambda s: s.freight), "d": a.custom(F.min, lambda s: s.order_date)})


@query("SELECT n_regionkey, round(ln(product(n_nationkey + 1)), 8) AS p FROM nation GROUP BY 1")
def agg_product() -> Query:
    q = select("nation").group_by(lambda n: n.n_regionkey)
    return q.aggregate(lambda k, a: {"n_regionkey": k, "p": a.product_by(lambda n: n.n_nationkey + 1).map(lambda c: F.round(F.ln(c), 8))})


@query(
    "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments, array_to_string(list(CAST(c_custkey AS VARCHAR) ORDER BY c_custkey), ',') AS keys FROM customer GROUP BY 1"
)
def agg_lists() -> Query:
    q = select("customer").group_by(lambda c: c.c_nationkey)
    return q.aggregate(
        lambda k, a: {
            "c_nationkey": k, "segments": a.distinct_by(lambda c: c.c_mktsegment).map(lambda x: F.array_join(x, ",")),
            "keys": a.to_list_by(lambda c: c.c_custkey.cast("string"), lambda c: c.c_custkey).map(lambda x: F.array_join(x, ",")),
        }
    )


@query("SELECT label, array_to_string(list_sort(list(DISTINCT x)), ',') AS xs FROM (SELECT label, CAST(unnest(embedding) > 0 AS INTEGER) AS x FROM embeddings) GROUP BY 1")
def agg_flat_distinct() -> Query:
    q = select("embeddings").group_by(lambda e: e.label)
    return q.aggregate(lambda k, a: {"label": k, "xs": a.flat_distinct_by(lambda e: F.transform(e.embedding, lambda x: (x > 0).cast("int"))).map(lambda x: F.array_join(x, ","))})


@query(
    "SELECT user_id, round(sum(value), 2) AS added, max(value) AS most, string_agg(event_type, '>' ORDER BY ts) AS path, round(list_reduce(list(value ORDER BY ts), lambda x, y: 0.5 * x + y), 6) AS decayed FROM events GROUP BY 1"
)
def agg_reduce_fold() -> Query:
    q = select("events").group_by(lambda e: e.user_id)
    return q.aggregate(
        lambda k, a: {
            "user_id": k, "added": a.reduce_by(lambda e: e.value, operator.add).map(money), "most": a.reduce_by(lambda e: e.value, max),
            "path": a.fold_left_by(lambda e: e.event_type, "", lambda s, x: F.when(s == "", x).otherwise(F.concat(s, F.lit(">"), x)), lambda e: e.ts),
            "decayed": a.reduce_by(lambda e: e.value, lambda x, y: 0.5 * x + y, lambda e: e.ts).map(lambda c: F.round(c, 6)),
        }
    )


@query(
    "SELECT s, n, string_agg(p || ':' || m, ',' ORDER BY p) AS parts FROM (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS m, sum(count(*)) OVER (PARTITION BY o_orderstatus) AS n FROM orders GROUP BY 1, 2) GROUP BY 1, 2"
)
def report1() -> Query:
    q = select("orders").group_by(lambda o: o.o_orderstatus)
    return q.aggregate(
        lambda s, a: {"s": s, "n": a.size(), "parts": a.report(lambda o: o.o_orderpriority, lambda p, b: {"p": p, "m": b.size()})}
    ).map(lambda r: {"s": r.s, "n": r.n.cast("double"), "parts": F.array_join(F.transform(r.parts, lambda x: F.concat(x["p"], F.lit(":"), x["m"].cast("string"))), ",")})


@query(
    "SELECT s, string_agg(p || ':' || best || ':' || years, ',' ORDER BY p) AS parts FROM (SELECT s, p, max(m) AS best, count(*) AS years FROM "
    "(SELECT o_orderstatus AS s, o_orderpriority AS p, year(o_orderdate) AS y, count(*) AS m FROM orders GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1"
)
def report2() -> Query:
    q = select("orders").group_by(lambda o: o.o_orderstatus)
    return q.aggregate(
        lambda s, a: {
            "s": s,
            "parts": a.report(lambda o: o.o_orderpriority, lambda o: F.year(o.o_orderdate), lambda p, y, b: {"m": b.size()}).combine(
                lambda p, b: {"p": p, "best": b.max_of(lambda r: r.m), "years": b.size()}
            ),
        }
    ).map(lambda r: {"s": r.s, "parts": F.array_join(F.transform(r.parts, lambda x: F.concat_ws(":", x["p"], x["best"].cast("string"), x["years"].cast("string"))), ",")})


@query("SELECT count(*) AS n, round(max(l_quantity), 2) AS most FROM lineitem WHERE l_tax < 0 HAVING count(*) > 0")
def global_aggregate_of_nothing() -> Query:
    """No rows, no group."""
    return select("lineitem").where(lambda x: x.l_tax < 0).group_by().aggregate(lambda a: {"n": a.size(), "most": a.max_of(lambda x: x.l_quantity)})


# --- windows, order, sets


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS mean, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def window_whole_partition() -> Query:
    q = select("orders").window(lambda a: {"mean": a.avg_by(lambda o: o.o_totalprice).map(lambda c: F.round(c, 6)), "n": a.size()}).partition_by(lambda o: o.o_custkey).order_by(lambda o: o.o_orderdate).over()
    return q.map(lambda o: {"o_orderkey": o.o_orderkey, "mean": o["mean"], "n": o.n})


@query(
    "SELECT event_id, row_number() OVER w AS i, rank() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('day', ts)) AS r, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)"
)
def window_rankings() -> Query:
    by = [lambda e: e.user_id, lambda e: e.event_type]
    first = select("events").window(lambda a: {"i": row_number(), "before": lag(lambda e: e.value)}).partition_by(*by).order_by(lambda e: e.ts).over()
    both = first.window(lambda a: {"r": rank()}).partition_by(*by).order_by(lambda e: F.date_trunc("day", e.ts)).over()
    return both.map(lambda e: {"event_id": e.event_id, "i": e.i.cast("bigint"), "r": e.r.cast("bigint"), "before": e.before})


@query("SELECT id, lag(quantity) OVER (PARTITION BY product_id, ship_country ORDER BY order_date DESC, shipped_date DESC, did, loaded_at, freight) AS before FROM (SELECT DISTINCT o.id, d.id AS did, product_id, ship_country, order_date, shipped_date, quantity, o.loaded_at, o.freight FROM sales_order o JOIN order_detail d ON o.id = d.order_id)")
def window_lag_over_join() -> Query:
    joined = select("sales_order").join(select("order_detail")).on(lambda o, d: o.id == d.order_id)
    rows = joined.map(lambda o, d: {"id": o.id, "did": d.id, "product_id": d.product_id, "ship_country": o.ship_country, "order_date": o.order_date, "shipped_date": o.shipped_date, "quantity": d.quantity, "loaded_at": o.loaded_at, "freight": o.freight}).deduplicate()
    w = rows.window(lambda a: {"before": lag(lambda r: r.quantity)}).partition_by(lambda r: r.product_id, lambda r: r.ship_country)
    w = w.order_by(lambda r: r.order_date.desc(), lambda r: r.shipped_date.desc(), lambda r: r.did.asc_nulls_last(), lambda r: r.loaded_at.asc_nulls_last(), lambda r: r.freight.asc_nulls_last())
    return w.over().map(lambda r: {"id": r.id, "before": r.before})


@query("SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey) AS r FROM customer")
def window_unordered_rank() -> Query:
    return select("customer").window(lambda a: {"r": rank()}).partition_by(lambda c: c.c_nationkey).over().map(lambda c: {"c_custkey": c.c_custkey, "r": c.r.cast("bigint")})


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC")
def order_by_mixed() -> Query:
    return select("supplier").map(lambda s: {"s_suppkey": s.s_suppkey, "s_nationkey": s.s_nationkey, "s_acctbal": s.s_acctbal}).order_by(lambda s: s.s_nationkey, lambda s: s.s_acctbal.desc())


@query("SELECT * FROM nation ORDER BY ALL")
def ordered_rows() -> Query:
    return select("nation").ordered()


@query("SELECT c_name AS name, c_nationkey AS k FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def union_all() -> Query:
    return select("customer").map(lambda c: {"name": c.c_name, "k": c.c_nationkey}) + select("supplier").map(lambda s: {"name": s.s_name, "k": s.s_nationkey})


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def deduplicate() -> Query:
    return select("lineitem").map(lambda x: {"l_returnflag": x.l_returnflag, "l_linestatus": x.l_linestatus}).deduplicate()


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events) WHERE i = 1")
def deduplicate_by() -> Query:
    return select("events").deduplicate_by(lambda e: e.user_id, lambda e: e.ts).map(lambda e: {"event_id": e.event_id, "user_id": e.user_id})


@query("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1) SELECT c_name, n FROM big JOIN customer ON o_custkey = c_custkey WHERE n > 3")
def and_then() -> Query:
    big = select("orders").where(lambda o: o.o_totalprice > 300000).group_by(lambda o: o.o_custkey).aggregate(lambda k, a: {"o_custkey": k, "n": a.size()})
    names = select("big").where(lambda b: b.n > 3).join(select("customer")).on(lambda b, c: b.o_custkey == c.c_custkey).map(lambda b, c: {"c_name": c.c_name, "n": b.n})
    return big.and_then(names, "big")


# --- stateful


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def stateful_running() -> Query:
    q = select("events").stateful_map(
        lambda: 0.0, lambda s, e: (s + e["value"], {"event_id": e["event_id"], "running": s + e["value"]}), "event_id bigint, running double", lambda e: e.ts, lambda e: e.user_id
    )
    return q.map(lambda r: {"event_id": r.event_id, "running": F.round(r.running, 4)})


def _session(state: tuple, e: dict) -> tuple:
    last, n = state
    n += last is None or e["ts"] - last > dt.timedelta(hours=6)
    return (e["ts"], n), [{"event_id": e["event_id"], "session": n}]


@query(
    "SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)"
)
def stateful_sessions() -> Query:
    return select("events").stateful_map_concat(lambda: (None, 0), _session, "event_id bigint, session bigint", lambda e: e.ts, lambda e: e.user_id)


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def accumulate_merged() -> Query:
    """A fold with Python state in all partitions; the states are merged."""

    def step(s: dict, e: dict) -> dict:
        n, t = s.get(e["event_type"], (0, 0.0))
        return {**s, e["event_type"]: (n + 1, t + e["value"])}

    def merge(a: dict, b: dict) -> dict:
        return {k: (a.get(k, (0, 0.0))[0] + b.get(k, (0, 0.0))[0], a.get(k, (0, 0.0))[1] + b.get(k, (0, 0.0))[1]) for k in {**a, **b}}

    q = select("events").map(lambda e: {"event_type": e.event_type, "value": e.value})
    out = q.accumulate(dict, step, lambda s: [{"event_type": k, "n": n, "total": t} for k, (n, t) in s.items()], "event_type string, n bigint, total double", merge)
    return out.map(lambda r: {"event_type": r.event_type, "n": r.n, "total": money(r.total)})


# --- exploration and files


def _described(name: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS field, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS least, CAST(quantile_disc({c}, 0.25) AS DOUBLE) AS percentile25, "
        f"CAST(quantile_disc({c}, 0.75) AS DOUBLE) AS percentile75, CAST(quantile_disc({c}, 0.9) AS DOUBLE) AS percentile90, CAST(max({c}) AS DOUBLE) AS most FROM {name}"
        for c in columns
    )


_MEASURED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(_described("lineitem", _MEASURED))
def describe_lineitem(spark: SparkSession, root: str) -> DataFrame:
    m = explore.measures(table(spark, root, "lineitem").select(*_MEASURED))
    numbers = {"least": "min", "percentile25": "percentile25", "percentile75": "percentile75", "percentile90": "percentile90", "most": "max"}
    return m.select("field", "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), *[F.col(c).cast("double").alias(n) for n, c in numbers.items()])


_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_MEASURED)


def _described_fields(name: str, numeric: tuple[str, ...], times: tuple[str, ...], texts: tuple[str, ...]) -> str:
    def digits(x: str) -> str:
        x = f"CAST({x} AS DOUBLE)"
        return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round({x}, 6 - CAST(floor(log10(abs({x}))) AS INTEGER)) END"

    no_numbers = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("mean", "std", "least", "percentile25", "percentile75", "percentile90", "most"))
    parts = [
        f"SELECT '{c}' AS field, count({c}) AS count, {digits(f'avg({c})')} AS mean, {digits(f'stddev_pop({c})')} AS std, {digits(f'min({c})')} AS least, "
        f"{digits(f'quantile_disc({c}, 0.25)')} AS percentile25, {digits(f'quantile_disc({c}, 0.75)')} AS percentile75, {digits(f'quantile_disc({c}, 0.9)')} AS percentile90, "
        f"{digits(f'max({c})')} AS most, CAST(NULL AS VARCHAR) AS first, CAST(NULL AS VARCHAR) AS last, '' AS unique_values FROM {name}"
        for c in numeric
    ]
    parts += [f"SELECT '{c}', count({c}), {no_numbers}, CAST(min({c}) AS VARCHAR), CAST(max({c}) AS VARCHAR), '' FROM {name}" for c in times]
    parts += [f"SELECT '{c}', count({c}), {no_numbers}, NULL, NULL, string_agg(DISTINCT {c}, ',' ORDER BY {c}) FROM {name}" for c in texts]
    return " UNION ALL ".join(parts)


@query(_described_fields("lineitem", _NUMERIC, ("l_shipdate",), ("l_returnflag", "l_linestatus")))
def describe_lineitem_fields(spark: SparkSession, root: str) -> DataFrame:
    """Every field of lineitem by describe, its 7-digit texts read as numbers again."""
    d = explore.describe(table(spark, root, "lineitem"), unique=True)
    numbers = {"mean": "mean", "std": "std", "min": "least", "percentile25": "percentile25", "percentile75": "percentile75", "percentile90": "percentile90", "max": "most"}
    timed = F.col("mean").isNull()
    return d.select(
        "field", F.col("count").cast("bigint").alias("count"), *[F.col(c).try_cast("double").alias(n) for c, n in numbers.items()],
        F.when(timed, F.col("min")).alias("first"), F.when(timed, F.col("max")).alias("last"), F.array_join("unique", ",").alias("unique_values"),
    )


@dataclasses.dataclass
class Supplier:
    sSuppkey: int
    sName: str
    sNationkey: int | None
    sAcctbal: float


def _scratch(spark: SparkSession) -> str:
    return shared_path(spark, "io")


_SUPPLIERS = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


def _renamed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(naming.snake_case(c)) for c in df.columns]).withColumn("s_nationkey", F.col("s_nationkey").cast("int"))


def _camel(df: DataFrame) -> DataFrame:
    return df.select(F.col("s_suppkey").alias("sSuppkey"), F.col("s_name").alias("sName"), F.col("s_nationkey").alias("sNationkey"), F.col("s_acctbal").alias("sAcctbal"))


@query(_SUPPLIERS)
def csv_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    from sparkloom.sources import csv

    path, options = _scratch(spark), csv.Options(naming=naming.with_spaces_capitalize, terminator="\n")
    csv.write(_camel(table(spark, root, "supplier")), path, options)
    return _renamed(csv.read(spark, Supplier, options).file(path))


@query(_SUPPLIERS)
def json_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    from sparkloom.sources import json

    path = _scratch(spark)
    json.write(_camel(table(spark, root, "supplier")), path)
    return _renamed(json.read(spark, Supplier, path))


@query(_SUPPLIERS)
def excel_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    from sparkloom.sources import excel

    book = io.BytesIO()
    excel.write_file(_camel(table(spark, root, "supplier")), book, header=True, naming=naming.kebab_case)
    return _renamed(excel.read(spark, Supplier).option(by_name=True, naming=naming.kebab_case).bytes(book.getvalue()))


@query("SELECT CAST(n_regionkey AS BIGINT) AS key, arg_max(n_name, n_nationkey) AS name FROM nation GROUP BY 1")
def to_map_last_wins(spark: SparkSession, root: str) -> DataFrame:
    q = select("nation").map(lambda n: {"k": n.n_regionkey, "v": {"name": n.n_name, "at": n.n_nationkey}})
    got = results.to_map(q, lambda r: r.v.at).run(given(spark, root))
    return spark.createDataFrame([(k, v["name"]) for k, v in got.items()], "key bigint, name string")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 1")
def find_first(spark: SparkSession, root: str) -> DataFrame:
    q = select("orders").map(lambda o: {"o_orderkey": o.o_orderkey, "o_totalprice": o.o_totalprice})
    hit = results.find(q, lambda o: o.o_totalprice > 400000, lambda o: o.o_orderkey).run(given(spark, root))
    return spark.createDataFrame([hit] if hit else [], "o_orderkey bigint, o_totalprice double")
