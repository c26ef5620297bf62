"""Queries for the forms of operators that ``relational`` leaves out: rows as such, results, sources and reports."""

from __future__ import annotations

import dataclasses
import io
import json
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import naming
from sparkloom.operators import explore, results
from sparkloom.operators.query import Inputs, Query, ranking, row_number, select, values
from sparkloom.plans.relational import given, query
from sparkloom.runtime import shared_path, table

# --- inputs


@query("SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey - 1")
def input_alias(spark: SparkSession, root: str) -> DataFrame:
    nation = Inputs({"nation": table(spark, root, "nation")})
    q = select("nation").join(select("later")).on(lambda a, b: a.n_nationkey == b.n_nationkey - 1)
    return q.map(lambda a, b: {"low": a.n_name, "high": b.n_name}).to_df(nation & nation.alias("nation", "later"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def merged_inputs(spark: SparkSession, root: str) -> DataFrame:
    both = Inputs({"nation": table(spark, root, "nation")}) & Inputs({"region": table(spark, root, "region")})
    q = select("nation").join(select("region")).on(lambda n, r: n.n_regionkey == r.r_regionkey)
    return q.map(lambda n, r: {"n_name": n.n_name, "r_name": r.r_name}).to_df(both)


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000")
def collection_joined(spark: SparkSession, root: str) -> DataFrame:
    """A collection at hand as one side of a join."""
    nations = [(r.n_nationkey, r.n_name) for r in table(spark, root, "nation").collect()]  # a dimension of 25 rows
    q = select("customer").where(lambda c: c.c_acctbal > 5000).join(values(spark, nations, "key int, name string")).on(lambda c, n: c.c_nationkey == n.key)
    return q.map(lambda c, n: {"c_custkey": c.c_custkey, "n_name": n.name}).to_df(given(spark, root))


# --- aggregates of rows as such


def _totals() -> Query:
    return select("orders").map(lambda o: {"s": o.o_orderstatus, "v": F.round(o.o_totalprice).cast("bigint")})


@query("SELECT o_orderstatus AS s, CAST(sum(v) AS BIGINT) AS total, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS least, max(v) AS most, count(DISTINCT v) AS kinds, 'x' AS mark "
       "FROM (SELECT o_orderstatus, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders) GROUP BY 1")  # fmt: skip
def agg_of_rows() -> Query:
    """Aggregates that take the row itself."""
    grouped = _totals().group_by(lambda o: o.s)
    out = grouped.aggregate(
        lambda s, a: {
            "s": s,
            "total": a.sum().contramap(lambda o: o.v),
            "mean": a.avg().contramap(lambda o: o.v).map(lambda c: F.round(c, 6)),
            "std": a.std().contramap(lambda o: o.v).map(lambda c: F.round(c, 6)),
            "least": a.min().contramap(lambda o: o.v),
            "most": a.max().contramap(lambda o: o.v),
            "kinds": a.distinct().contramap(lambda o: o.v).map(F.size),
            "mark": a.const("x"),
        }
    )
    return out.map(lambda r: {"s": r.s, "total": r.total, "mean": r["mean"], "std": r["std"], "least": r.least, "most": r.most, "kinds": r.kinds.cast("bigint"), "mark": r.mark})


@query("SELECT n_regionkey AS k, string_agg(n_name, ',' ORDER BY n_name) AS names, CAST(sum(n_nationkey) AS BIGINT) AS total, round(ln(product(n_nationkey + 1.0)), 8) AS p, max(n_nationkey) AS most FROM nation GROUP BY 1")
def agg_lists_of_rows() -> Query:
    """Lists, reductions, folds and products of the row itself."""
    q = select("nation").map(lambda n: {"k": n.n_regionkey, "name": n.n_name, "v": n.n_nationkey.cast("bigint")})
    out = q.group_by(lambda n: n.k).aggregate(
        lambda k, a: {
            "k": k,
            "names": a.to_list(lambda n: n.name).contramap(lambda n: n).map(lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")),
            "total": a.fold_left(F.lit(0).cast("bigint"), lambda s, x: s + x).contramap(lambda n: n.v),
            "p": a.product().contramap(lambda n: n.v + F.lit(1.0)).map(lambda c: F.round(F.log(c), 8)),
            "most": a.reduce(lambda x, y: F.greatest(x, y)).contramap(lambda n: n.v),
        }
    )
    return out.map(lambda r: {"k": r.k, "names": r.names, "total": r.total, "p": r.p, "most": r.most.cast("int")})


@query("SELECT s, string_agg(y || ':' || n, ',' ORDER BY y) AS years FROM (SELECT o_orderstatus AS s, year(o_orderdate) AS y, sum(n) AS n FROM (SELECT o_orderstatus, o_orderdate, 1 AS n FROM orders) GROUP BY 1, 2) GROUP BY 1")
def report_three_keys() -> Query:
    """Three levels: status, year and priority, the last two combined to the year."""
    q = select("orders").group_by(lambda o: o.o_orderstatus)
    out = q.aggregate(
        lambda s, a: {
            "s": s,
            "r": a.report(lambda o: F.year(o.o_orderdate), lambda o: o.o_orderpriority, lambda y, p, b: {"y": y, "n": b.size()}).combine(
                lambda y, b: {"y": y, "n": b.sum_by(lambda x: x.n)}
            ),
        }
    )
    return out.map(lambda r: {"s": r.s, "years": F.array_join(F.transform(r.r, lambda x: F.concat_ws(":", x["y"].cast("string"), x["n"].cast("string"))), ",")})


# --- windows


@query("SELECT c_custkey, dense_rank() OVER w AS d, lead(c_acctbal) OVER w AS next, (row_number() OVER w) * 10 AS tens FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
def window_own_rankings() -> Query:
    """Rankings of one's own, a mapped one, and partition and order in one call."""
    w = select("customer").window(lambda a: {"d": ranking(F.dense_rank), "next": ranking(F.lead, lambda c: c.c_acctbal), "tens": row_number().map(lambda c: c * 10)})
    q = w.over(partition_by=lambda c: c.c_nationkey, order_by=[lambda c: c.c_acctbal, lambda c: c.c_custkey])
    return q.map(lambda c: {"c_custkey": c.c_custkey, "d": c.d.cast("bigint"), "next": c["next"], "tens": c.tens.cast("bigint")})


# --- stateful


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE rise) AS rises FROM (SELECT value > lag(value) OVER (ORDER BY ts) AS rise FROM events)")
def accumulate_in_order() -> Query:
    """A fold whose states can't be merged: all rows in order."""
    q = select("events").map(lambda e: {"ts": e.ts, "value": e.value})
    return q.accumulate(
        lambda: (0, 0, None), lambda s, e: (s[0] + 1, s[1] + (s[2] is not None and e["value"] > s[2]), e["value"]), lambda s: [{"rows": s[0], "rises": s[1]}], "rows bigint, rises bigint", order=lambda e: e.ts
    )


@query("SELECT event_id, round(sum(value) OVER w, 4) AS total, count(*) OVER w AS n, max(value) OVER w AS most FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)")
def running_aggregates() -> Query:
    """States that are aggregates, as windows."""
    q = select("events").running(lambda a: {"total": a.sum_by(lambda e: e.value), "n": a.size(), "most": a.max_of(lambda e: e.value)}, lambda e: e.ts, lambda e: e.user_id)
    return q.map(lambda e: {"event_id": e.event_id, "total": F.round(e.total, 4), "n": e.n, "most": e.most})


# --- results


def _made(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("SELECT n_name FROM nation WHERE n_regionkey = 3")
def result_to_list(spark: SparkSession, root: str) -> DataFrame:
    q = select("nation").where(lambda n: n.n_regionkey == 3).map(lambda n: {"n_name": n.n_name})
    return _made(spark, results.to_list(q).run(given(spark, root)), "n_name string")


@query("SELECT DISTINCT c_mktsegment FROM customer")
def result_distinct(spark: SparkSession, root: str) -> DataFrame:
    return _made(spark, results.distinct(select("customer").map(lambda c: {"c_mktsegment": c.c_mktsegment})).run(given(spark, root)), "c_mktsegment string")


@query("SELECT count(DISTINCT r_name) AS n FROM region")
def result_to_collection(spark: SparkSession, root: str) -> DataFrame:
    names = results.to(select("region").map(lambda r: {"r_name": r.r_name}), lambda rows: {r.r_name for r in rows})
    return _made(spark, [(len(names.run(given(spark, root))),)], "n bigint")


@query("SELECT CAST(r_regionkey AS BIGINT) AS k, r_name FROM region")
def result_to_map_by(spark: SparkSession, root: str) -> DataFrame:
    got = results.to_map_by(select("region"), lambda r: r.r_regionkey).run(given(spark, root))
    return _made(spark, [(k, v["r_name"]) for k, v in got.items()], "k bigint, r_name string")


@query("SELECT (SELECT count(*) > 0 FROM orders WHERE o_totalprice > 100000) AS large, (SELECT count(*) > 0 FROM orders WHERE o_totalprice < 0) AS negative, 7 AS fixed, 14 AS twice")
def result_exists_and_const(spark: SparkSession, root: str) -> DataFrame:
    """Results composed before anything runs."""
    orders = select("orders")
    both = results.exists(orders, lambda o: o.o_totalprice > 100000).flat_map(lambda a: results.exists(orders, lambda o: o.o_totalprice < 0).map(lambda b: (a, b)))
    fixed = results.const(7)
    return _made(spark, [(*both.run(given(spark, root)), fixed.run(), fixed.map(lambda x: 2 * x).run())], "large boolean, negative boolean, fixed int, twice int")


@query("SELECT count(*) AS rows, CAST(sum(n_nationkey) AS BIGINT) AS total, 'opened,before,after,closed,exit' AS log FROM nation")
def result_side_effect(spark: SparkSession, root: str) -> DataFrame:
    """A sink with a resource, a state and hooks."""
    log: list[str] = []

    def noted(word: str, value: object) -> object:
        log.append(word)
        return value

    def sink() -> results.SideEffect:
        effect = results.SideEffect((0, 0), lambda: noted("opened", log), lambda r, s: noted("closed", s), lambda r, s, row: (s[0] + 1, s[1] + row["n_nationkey"]))
        return effect.before_all(lambda r, s: noted("before", s)).after_all(lambda r, s: noted("after", s)).on_exit(lambda: noted("exit", None))

    rows, total = results.foreach(select("nation"), sink).run(given(spark, root))
    return _made(spark, [(rows, total, ",".join(log))], "rows bigint, total bigint, log string")


@query("SELECT '|' || rpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || '|' AS line FROM region UNION ALL SELECT '|r_regionkey|'")
def result_show(spark: SparkSession, root: str) -> DataFrame:
    """The lines of a shown table, without rules and brought to one padding."""
    out: list[str] = []
    results.show(select("region").map(lambda r: {"r_regionkey": r.r_regionkey}), 20, True, out.append).run(given(spark, root))
    lines = [line.strip("|").strip() for line in "".join(out).splitlines() if line.startswith("|")]
    return _made(spark, [(f"|{line:<11}|",) for line in lines], "line string")


@query("SELECT 'FROM(nation)' AS source, true AS has_filter, true AS has_join")
def explained(spark: SparkSession, root: str) -> DataFrame:
    q = select("nation").where(lambda n: n.n_regionkey == 1).join(select("region")).on(lambda n, r: n.n_regionkey == r.r_regionkey)
    text = q.explain() if isinstance(q.explain(), str) else str(q)
    return _made(spark, [("FROM(nation)" if "FROM(nation)" in text else text, "WHERE" in text.upper(), "JOIN" in text.upper())], "source string, has_filter boolean, has_join boolean")


# --- exploration


@query("SELECT 'unit_price' AS field, count(unit_price) AS count FROM order_detail UNION ALL SELECT 'quantity', count(quantity) FROM order_detail UNION ALL SELECT 'product_id', count(product_id) FROM order_detail UNION ALL SELECT 'id', count(id) FROM order_detail")
def describe_counts_with_nulls(spark: SparkSession, root: str) -> DataFrame:
    d = explore.describe(table(spark, root, "order_detail").select("unit_price", "quantity", "product_id", "id"))
    return d.select("field", F.col("count").cast("bigint").alias("count"))


@query("SELECT 'n.key' AS field, count(*) AS count, CAST(min(n_nationkey) AS DOUBLE) AS least, CAST(max(n_nationkey) AS DOUBLE) AS most FROM nation UNION ALL SELECT 'n.region', count(*), CAST(min(n_regionkey) AS DOUBLE), CAST(max(n_regionkey) AS DOUBLE) FROM nation")
def describe_nested(spark: SparkSession, root: str) -> DataFrame:
    nested = table(spark, root, "nation").select(F.struct(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("region")).alias("n"))
    return explore.describe(nested).select("field", F.col("count").cast("bigint").alias("count"), F.col("min").cast("double").alias("least"), F.col("max").cast("double").alias("most"))


# --- sources and sinks


@dataclasses.dataclass
class Region:
    r_regionkey: int
    r_name: str


@dataclasses.dataclass
class Nation:
    n_nationkey: int
    n_name: str
    region: Region


_NATIONS = "SELECT n_nationkey, n_name, n_regionkey AS r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


def _nations(spark: SparkSession, root: str) -> DataFrame:
    """Nations with their region as a nested record."""
    q = select("nation").join(select("region")).on(lambda n, r: n.n_regionkey == r.r_regionkey)
    return q.map(lambda n, r: {"n_nationkey": n.n_nationkey, "n_name": n.n_name, "region": {"r_regionkey": r.r_regionkey, "r_name": r.r_name}}).to_df(given(spark, root))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("region.r_regionkey").cast("int").alias("r_regionkey"), "region.r_name")


@query(_NATIONS)
def csv_string_nested(spark: SparkSession, root: str) -> DataFrame:
    """Nested records to one CSV text and back."""
    from sparkloom.sources import csv

    out = io.StringIO()
    csv.write_file(_nations(spark, root), out)
    return _flat(csv.read(spark, Nation).string(out.getvalue()))


@query(_NATIONS)
def csv_by_http(spark: SparkSession, root: str) -> DataFrame:
    """A file behind a URL, served by this process meanwhile."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from sparkloom.sources import csv

    out = io.StringIO()
    csv.write_file(_nations(spark, root), out)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out.getvalue().encode())

        def log_message(self, *_: object) -> None:
            pass

    with HTTPServer(("127.0.0.1", 0), Handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        try:
            return _flat(csv.read(spark, Nation).url(f"http://127.0.0.1:{server.server_port}/nations.csv"))
        finally:
            server.shutdown()


@query(_NATIONS)
def csv_many_files(spark: SparkSession, root: str) -> DataFrame:
    """Files in the shared folder, found by a glob."""
    from sparkloom.sources import csv

    path = shared_path(spark, "io")
    for k in range(3):
        csv.write(_nations(spark, root).where(F.col("n_nationkey") % 3 == k), f"{path}/part{k}")
    return _flat(csv.read(spark, Nation).directory(path, "**/*.csv"))


@query(_NATIONS)
def csv_tsv_and_quoting(spark: SparkSession, root: str) -> DataFrame:
    """Tab-separated, and with all but numbers quoted: the union of halves."""
    from sparkloom.sources import csv

    parts, df = [], _nations(spark, root)
    for k, options in enumerate((csv.TSV, csv.Options(quoting=csv.QUOTE_NON_NUMERIC, delimiter=";"))):
        out = io.StringIO()
        csv.write_file(df.where(F.col("n_nationkey") % 2 == k), out, options)
        parts.append(csv.read(spark, Nation, options).string(out.getvalue()))
    return _flat(parts[0].unionByName(parts[1]))


@dataclasses.dataclass
class Strict:
    order_id: int
    product_id: int
    unit_price: Decimal


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE order_id IS NULL OR product_id IS NULL OR unit_price IS NULL OR isnan(unit_price)) AS refused FROM order_detail")
def csv_errors_gathered(spark: SparkSession, root: str) -> DataFrame:
    """Records with all their errors gathered: fields that lack, and numbers that are none."""
    from sparkloom.sources import csv

    path = shared_path(spark, "io")
    csv.write(table(spark, root, "order_detail").select("order_id", "product_id", "unit_price"), path)
    got = csv.read(spark, Strict).lenient().file(path)
    return got.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("errors") > 0).alias("refused"))


@query("SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part")
def csv_own_parser(spark: SparkSession, root: str) -> DataFrame:
    """A decoder of one's own, with its own error text."""
    from sparkloom.sources import csv

    @dataclasses.dataclass
    class Price:
        p_partkey: int
        cents: int

    def cents(text):
        value = (F.regexp_extract(text, r"^\$ ([0-9.]+)$", 1).try_cast("double") * 100)
        return F.round(value).cast("bigint"), F.when(value.isNull(), F.concat(F.lit("no price in "), text))

    path = shared_path(spark, "io")
    csv.write(table(spark, root, "part").select("p_partkey", F.concat(F.lit("$ "), F.col("p_retailprice").cast("string")).alias("cents")), path)
    return csv.read(spark, Price).parser("cents", cents).file(path).select("p_partkey", "cents")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def excel_by_index(spark: SparkSession, root: str) -> DataFrame:
    from sparkloom.sources import excel

    @dataclasses.dataclass
    class Row:
        n_nationkey: int
        n_name: str
        n_regionkey: int

    book = io.BytesIO()
    excel.write_file(table(spark, root, "nation").select("n_nationkey", "n_name", "n_regionkey"), book, sheet="Nations")
    got = excel.read(spark, Row).option(sheet="Nations").bytes(book.getvalue())
    return got.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS region, n_name FROM nation")
def html_report(spark: SparkSession, root: str) -> DataFrame:
    """A styled report with nested lists as further rows, read from the document's cells again."""
    from sparkloom.sources import html

    q = select("nation").group_by(lambda n: n.n_regionkey).aggregate(lambda k, a: {"region": k, "nations": a.report(lambda n: n.n_nationkey, lambda i, b: {"name": b.max_of(lambda n: n.n_name)})})
    out = io.StringIO()
    style = html.Styling().for_all_headers({"font-weight": "bold"}).add_field("nations[].name", {"color": "red"})
    html.write_file(q.to_df(given(spark, root)), out, naming=naming.capitalize, styling=style)
    body = out.getvalue().split("</th></tr>")[1]
    cells = spark.createDataFrame([(body,)], "t string").select(F.posexplode(F.regexp_extract_all("t", F.lit("<tr><td>(.*?)</td><td[^>]*>(.*?)</td></tr>"), F.lit(0))).alias("i", "row"))
    read = cells.select("i", F.regexp_extract("row", "<td>(.*?)</td>", 1).alias("region"), F.regexp_extract("row", "red;\">(.*?)</td>", 1).alias("n_name"))
    filled = read.select("n_name", F.nullif("region", F.lit("")).alias("r"), "i").toPandas().sort_values("i").ffill()  # one small document
    return spark.createDataFrame([(r.r, r.n_name) for r in filled.itertuples() if r.n_name], "region string, n_name string")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def json_report(spark: SparkSession, root: str) -> DataFrame:
    """A JSON array written as one text, and read again."""
    from sparkloom.sources import json as source

    out = io.StringIO()
    source.write_file(select("orders").group_by(lambda o: o.o_orderstatus).aggregate(lambda s, a: {"status": s, "n": a.size()}).to_df(given(spark, root)), out, lines=False)
    return _made(spark, [(r["status"], r["n"]) for r in json.loads(out.getvalue())], "status string, n bigint")
