import datetime as dt
import math
import operator
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sparkloom.operators import explore, results
from sparkloom.operators.query import inputs, is_in, lag, of, rank, ranking, row_number, same, select, values
from sparkloom.operators.results import SideEffect

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def people(spark):
    rows = [("ann", 3, "a", [1, 2]), ("bob", None, "a", [2, 3]), ("cid", 5, "b", None), ("dan", 5, None, []), ("eve", 1, None, [1])]
    return inputs(people=spark.createDataFrame(rows, "name string, age int, team string, tags array<int>"))


def rows(query, given_inputs=None):
    return sorted((tuple(r) for r in query.to_df(given_inputs).collect()), key=repr)


# laws


@few
@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=10))
def test_laws(spark, xs):
    q = values(spark, [(x,) for x in xs], "x int")
    assert rows(q.map(lambda r: {"x": r.x})) == rows(q)
    assert rows(q.map(lambda r: {"y": r.x + 1}).map(lambda r: {"z": r.y * 2})) == rows(q.map(lambda r: {"z": (r.x + 1) * 2}))
    assert rows(q.where(lambda r: r.x > 0).where(lambda r: r.x < 9)) == rows(q.where(lambda r: (r.x > 0) & (r.x < 9)))
    assert sorted(rows(q.where(lambda r: r.x > 0)) + rows(q.where_not(lambda r: r.x > 0))) == sorted(rows(q))
    empty = q.where(lambda r: F.lit(False))
    assert rows(q + empty) == rows(q) == rows(empty + q)
    assert rows((q + q) + q) == rows(q + (q + q)) and len(rows(q + q)) == 2 * len(xs)
    assert rows(q.flat_map(lambda r: values(spark, [(1,)], "one int").map(lambda _: {"x": r.x}))) == rows(q)


# predicates and nulls


def test_two_valued_predicates(people):
    q = select("people").map(lambda p: {"name": p.name, "age": p.age})
    assert rows(q.where_not(lambda p: p.age > 2), people) == [("bob", None), ("eve", 1)]
    assert rows(q.where(lambda p: is_in(p.age, 1, None)), people) == [("bob", None), ("eve", 1)]


def test_null_safe_join_and_left_join(people):
    p = select("people").map(lambda p: {"name": p.name, "team": p.team})
    pairs = p.join(p).on(lambda a, b: same(a.team, b.team) & (a.name < b.name)).map(lambda a, b: {"a": a.name, "b": b.name})
    assert rows(pairs, people) == [("ann", "bob"), ("dan", "eve")]
    left = p.left_join(p.where(lambda r: r.name == "dan").map(lambda r: {"team": r.team})).on(lambda a, b: same(a.team, b.team))
    got = rows(left.map(lambda a, b: {"name": a.name, "hit": b.is_defined(), "b": b}), people)
    assert [(n, h) for n, h, _ in got] == [("ann", False), ("bob", False), ("cid", False), ("dan", True), ("eve", True)]
    assert got[0][2] is None and got[3][2] is not None  # a match of nothing but nulls is a match


def test_grouping_keeps_nulls(people):
    q = select("people").group_by(lambda p: p.team).aggregate(
        lambda t, a: {"team": t, "n": a.size(), "least": a.min_of(lambda p: p.age), "ages": a.to_list_by(lambda p: p.age, lambda p: p.name), "tags": a.flat_distinct_by(lambda p: p.tags)}
    )
    assert rows(q, people) == [("a", 2, None, [3, None], [1, 2, 3]), ("b", 1, 5, [5], []), (None, 2, 1, [5, 1], [1])]


def test_algebra(people):
    q = select("people").group_by(lambda p: F.lit(1)).aggregate(
        lambda _, a: {
            "pair": (a.size() & a.count(lambda p: p.age > 2)).map(lambda n, c: n * 10 + c),
            "up": a.max().contramap(lambda p: {"n": F.upper(p.name)}),
            "added": a.reduce_by(lambda p: p.age, operator.add), "folded": a.fold_left_by(lambda p: p.name, "", lambda s, x: F.concat(s, F.substring(x, 1, 1)), lambda p: p.name),
            "std": a.std_by(lambda p: p.age).map(lambda c: F.round(c, 4)),
        }
    )
    assert rows(q, people) == [(53, "EVE", 14, "abcde", 1.6583)]


def test_nested_reports(people):
    q = select("people").group_by(lambda p: F.lit("all")).aggregate(
        lambda k, a: {"k": k, "teams": a.report(lambda p: p.team, lambda t, b: {"t": t, "n": b.size(), "ages": b.report(lambda p: p.age, lambda g, c: {"g": g, "names": c.to_list_by(lambda p: p.name, lambda p: p.name)})})}
    )
    (_, teams), = rows(q, people)
    assert [(t.t, t.n, [(g.g, g.names) for g in t.ages]) for t in teams] == [
        (None, 2, [(1, ["eve"]), (5, ["dan"])]), ("a", 2, [(None, ["bob"]), (3, ["ann"])]), ("b", 1, [(5, ["cid"])])
    ]


def test_windows(people):
    w = select("people").window(lambda a: {"n": a.size(), "i": row_number(), "r": rank(), "before": lag(lambda p: p.name)}).partition_by(lambda p: p.team).order_by(lambda p: p.name)
    got = {r["name"]: (r.n, r.i, r.r, r.before) for r in w.over().to_df(people).collect()}
    assert got["bob"] == (2, 2, 2, "ann") and got["cid"] == (1, 1, 1, None)
    with pytest.raises(ValueError):
        select("people").window(lambda a: {"n": a.size()}).over()


def test_exists_follows_the_first_match_and_order(people):
    q = select("people")
    assert results.find(q, lambda p: p.age == 5, lambda p: p.name.desc()).run(people)["name"] == "dan"
    assert results.exists(q, lambda p: p.age > 9).run(people) is False
    assert results.find(q, lambda p: p.age > 9).run(people) is None


def test_results_compose(people):
    q = select("people").map(lambda p: {"name": p.name})
    n = results.to(q, len).flat_map(lambda n: results.to_list(q).map(lambda xs: (n, len(xs))))
    assert n.run(people) == (5, 5) and results.const(3).map(lambda x: x + 1).run() == 4
    assert len(results.distinct(q + q).run(people)) == 5
    by = results.to_map_by(select("people").map(lambda p: {"name": p.name, "team": p.team}), lambda r: r.team, lambda r: r.name).run(people)
    assert {k: v["name"] for k, v in by.items()} == {"a": "bob", "b": "cid", None: "eve"}


def test_inputs_are_merged_and_checked(spark, people):
    more = inputs(other=spark.range(1))
    assert set((people & more).tables) == {"people", "other"}
    with pytest.raises(ValueError):
        people & people
    with pytest.raises(KeyError):
        select("nobody").to_df(people)
    assert len(rows(select("them"), people.alias("people", "them"))) == 5


def test_and_then_and_dedupe(people):
    teams = select("people").where(lambda p: p.team.isNotNull()).deduplicate_by(lambda p: p.team, lambda p: p.name, descending=True)
    assert rows(teams.and_then(select("t").map(lambda t: {"name": t.name}), "t"), people) == [("bob",), ("cid",)]
    first = select("people").deduplicate_by(lambda p: p.team, lambda p: p.name)
    assert sorted(r["name"] for r in first.to_df(people).collect()) == ["ann", "cid", "dan"]


def test_explain_text():
    q = select("a").where(lambda r: r.x).map(lambda r: r)
    assert str(q) == "FROM(a) -> WHERE -> MAP" and "INNER JOIN" in str(q.join(q).on(lambda a, b: F.lit(True)))


def test_plans_push_down(spark, tmp_path):
    spark.range(1000).selectExpr("id AS k", "id % 7 AS g", "'x' AS unused").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    q = of(df).where(lambda r: r.k > 5).join(of(df)).on(lambda a, b: a.k == b.g).map(lambda a, b: {"k": a.k, "g": b.k})
    plan = q.to_df()._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and "PushedFilters: [IsNotNull(k), GreaterThan(k,5)" in plan and "NestedLoop" not in plan


# stateful


def test_stateful_in_order_and_per_key(spark):
    df = spark.createDataFrame([("a", 3, 30), ("a", 1, 10), ("b", 2, 20), ("a", 2, 20), (None, 1, 1)], "k string, t int, v int")
    q = of(df).stateful_map(lambda: 0, lambda s, r: (s + r["v"], {"k": r["k"], "t": r["t"], "s": s + r["v"]}), "k string, t int, s bigint", lambda r: r.t, lambda r: r.k)
    assert rows(q) == [("a", 1, 10), ("a", 2, 30), ("a", 3, 60), ("b", 2, 20), (None, 1, 1)]
    every = of(df).stateful_map_concat(lambda: [], lambda s, r: (s + [r["t"]], [{"n": len(s)}] * (r["t"] == 1)), "n bigint", lambda r: (r.t, r.v))
    assert rows(every) == [(0,), (1,)]


def test_accumulate(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "x int")
    q = of(df).accumulate(list, lambda s, r: [*s, r["x"]], lambda s: [{"x": x} for x in s[:2]], "x int", order=lambda r: r.x.desc())
    assert rows(q) == [(8,), (9,)]
    empty = of(df.where("false")).accumulate(lambda: 0, lambda s, r: s + 1, lambda s: [{"n": s}], "n int", merge=operator.add)
    assert rows(empty) == [(0,)]


# exploration


def test_describe_against_statistics(spark):
    rng = random.Random(3)
    rows = [(f"pump {i}", rng.randint(1, 9), rng.choice(["north", "east", "yard"]), round(rng.uniform(1, 400), 1), dt.date(2021, 1, 1) + dt.timedelta(days=rng.randint(0, 900))) for i in range(41)]
    df = spark.createDataFrame(rows, "name string, stage int, site string, pressure double, checked date")
    got = {r.field: r for r in explore.describe(df, unique=True).collect()}
    for field, k in (("stage", 1), ("pressure", 3)):
        values = sorted(float(r[k]) for r in rows)
        ranked = [values[math.ceil(len(values) * q / 100) - 1] for q in (25, 75, 90)]
        want = [statistics.fmean(values), statistics.pstdev(values), values[0], *ranked, values[-1]]
        assert got[field]["count"] == "41" and [float(x) for x in tuple(got[field])[2:9]] == pytest.approx(want, rel=1e-6)
    days = sorted(r[4] for r in rows)
    assert (got["checked"]["min"], got["checked"]["max"], got["checked"]["mean"]) == (str(days[0]), str(days[-1]), None)
    assert got["site"].unique == ["east", "north", "yard"]
    assert explore.describe(df.where("false")).count() == 0


def test_exact_percentiles(spark):
    rng = random.Random(9)
    inf, nan = math.inf, math.nan
    columns = {
        0: [7.0 if i % 3 == 0 else float(i * 7919 % 1009) for i in range(5000)],
        1: [None] * 5000,
        2: [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(5000)],
        3: [1 + rng.randint(0, 4000) * 2.0**-52 for _ in range(5000)],
        4: [rng.choice([-inf, inf, 0.0, -1.5]) for _ in range(5000)],
        5: [nan if i % 5 == 0 else float(i) for i in range(5000)],
        6: [5e-324 * rng.randint(0, 50) for _ in range(5000)],
        7: [None if i else -3.0 for i in range(5000)],
        8: [rng.choice([-1.7e308, 1.7e308]) * rng.random() for _ in range(5000)],
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"c{i} double" for i in columns))
    got = explore.exact_percentiles(df, {i: f"c{i}" for i in columns}, (1, 25, 50, 90, 100))
    for i, column in columns.items():
        values = sorted((v for v in column if v is not None), key=lambda v: (math.isnan(v), v))
        want = [values[max(1, math.ceil(len(values) * q / 100)) - 1] if values else None for q in (1, 25, 50, 90, 100)]
        assert repr(got[i]) == repr(want), i
    assert explore.exact_percentiles(df.where("false"), {0: "c0"}) == {0: [None] * 3}


def test_show(spark, people):
    df = spark.createDataFrame([("a" * 30, [1, None], {"k": 2}, ("x", None)), (None, [], {}, None)], "s string, l array<int>, m map<string,int>, r struct<p:string,q:int>")
    text = explore.table_text(df)
    assert "r.p" in text and "aaaaaaaaaaaaaaaaa..." in text and "[1, null]" in text and "{k: 2}" in text and "null" in text
    assert explore.table_text(df, rows=1, truncate=False).endswith("only showing top 1 row\n") and "a" * 30 in explore.table_text(df, truncate=False)
    out = []
    results.show(select("people"), 2, True, out.append).run(people)
    assert len(out) == 1


# side effects


def test_side_effect_contract(people):
    log = []
    sink = lambda: SideEffect(0, lambda: log.append("open"), lambda r, s: log.append(f"close {s}"), lambda r, s, row: s + 1).after_all(lambda r, s: log.append("after") or s * 10).on_exit(lambda: log.append("exit"))
    query = select("people").map(lambda p: {"name": p.name})
    action = results.foreach(query, sink)
    assert action.run(people) == 50 and log == ["open", "after", "close 50", "exit"]
    action.run(people)
    assert len(log) == 8

    def fail(r, s, row):
        raise RuntimeError("no")

    log.clear()
    bad = results.foreach(query, lambda: SideEffect(0, lambda: None, lambda r, s: log.append("close"), fail).after_all(lambda r, s: log.append("after") or s).on_exit(lambda: log.append("exit")))
    with pytest.raises(RuntimeError):
        bad.run(people)
    assert log == ["close", "exit"]
    seen = []
    results.foreach(query, lambda row: seen.append(row["name"])).run(people)
    assert sorted(seen) == ["ann", "bob", "cid", "dan", "eve"]


def test_own_rankings_and_windows_in_one_call(people):
    q = select("people").window(lambda a: {"d": ranking(F.dense_rank), "next": ranking(F.lead, lambda p: p.name), "half": ranking(lambda: F.ntile(2))})
    got = q.over(partition_by=lambda p: p.team, order_by=[lambda p: p.name]).map(lambda p: {"name": p.name, "d": p.d, "next": p["next"], "half": p.half})
    assert rows(got, people) == [("ann", 1, "bob", 1), ("bob", 2, None, 2), ("cid", 1, None, 1), ("dan", 1, "eve", 1), ("eve", 2, None, 2)]


def test_deduplicate_by_with_a_map(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 0}), (2, {})], "k int, m map<string,int>")
    assert rows(of(df).deduplicate_by(lambda r: r.k, lambda r: r.k)) == [(1, {"a": 0}), (2, {})]


def test_running_equals_stateful_map(spark):
    df = spark.createDataFrame([(i % 3, i * 7 % 10, float(i)) for i in range(30)], "k int, t int, v double")
    state = of(df).stateful_map(lambda: 0.0, lambda s, r: (s + r["v"], {"k": r["k"], "t": r["t"], "v": r["v"], "s": s + r["v"]}), "k int, t int, v double, s double", lambda r: (r.t, r.v), lambda r: r.k)
    assert rows(of(df).running(lambda a: {"s": a.sum_by(lambda r: r.v)}, [lambda r: r.t, lambda r: r.v], lambda r: r.k)) == rows(state)


def test_names_of_nested_fields(spark):
    df = spark.createDataFrame([((1, 2.0),)], "r struct<a:int,b:double>")
    assert [r.field for r in explore.describe(df, full_names=False).collect()] == ["a", "b"]


def test_report_carries_the_outer_aggregates(spark, people):
    q = select("people").group_by(lambda p: p.team)

    def both(team, a, more):
        listed = a.report(lambda p: p.age, lambda age, b: {"age": age, "n": b.size()})
        return {"team": team, "n": a.size(), "sum": a.sum_by(lambda p: p.age).map(lambda c: c * 2), "least": a.min_of(lambda p: p.age), "most": a.max_of(lambda p: p.name), "r": listed, **more}

    once = q.aggregate(lambda team, a: both(team, a, {})).to_df(people)
    joined = q.aggregate(lambda team, a: both(team, a, {"names": a.to_list_by(lambda p: p.name)})).to_df(people)
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, joined.drop("names").collect()), key=repr)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (once, joined)]
    assert "Join" not in plans[0] and "Join" in plans[1]
