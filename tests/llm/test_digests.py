import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkloom.llm import digests, queries

SCHEMA = "id string, g string, v double"


def digest(df, **more):
    return digests.group_digests(digests.placed(df, ["g"], "v", **more))


def build(spark, values, parts=4, **more):
    df = spark.createDataFrame(values, "g string, v double").repartition(parts)
    return df, digest(df, **more)


def sizes(d):
    return {r.g: (r.c, r.n) for r in d.select("g", F.size("digest").alias("c"), F.aggregate("digest", F.lit(0).cast("bigint"), lambda a, c: a + c["weight"]).alias("n")).collect()}


def ranks(values, x):
    return sum(v <= x for v in values), sum(v < x for v in values)


@pytest.mark.parametrize("make", [lambda r: r.random(), lambda r: float(r.randint(0, 3)), lambda r: math.exp(3 * r.gauss(0, 1)), lambda r: 5.0])
def test_bounds_hold_and_are_narrow(spark, make):
    rng = random.Random(2)
    values = [make(rng) for _ in range(20_000)]
    _, d = build(spark, [("a", v) for v in values])
    points = spark.createDataFrame([("a", x) for x in (*sorted(values)[::2500], -1.0, 1e9)], "g string, x double")
    for r in digests.rank_bounds(d, ["g"], points, "x").collect():
        le, lt = ranks(values, r.x)
        assert r.le_least <= le <= r.le_most and r.lt_least <= lt <= r.lt_most
        assert r.le_most - r.le_least <= 0.03 * len(values) + values.count(r.x)
    assert sizes(d)["a"][0] <= digests.DELTA


def test_percentiles_are_certified(spark):
    rng = random.Random(4)
    values = [rng.gauss(0, 1) for _ in range(30_000)]
    df, d = build(spark, [("a", v) for v in values])
    estimates = digests.percentiles(d, ["g"], (1, 25, 50, 75, 99))
    counts = digests.counted_ranks(df, ["g"], "v", estimates, "estimate")
    got = digests.certified(estimates, counts, ["g"]).collect()
    assert len(got) == 5
    for r in got:
        le, lt = ranks(values, r.estimate)
        rank = max(1, math.ceil(len(values) * r.percent / 100))
        assert r.rank_error == pytest.approx(max(0, rank - le, lt + 1 - rank) / len(values))
        assert r.rank_error <= r.error_bound <= 0.02


def test_small_groups_are_exact(spark):
    rng = random.Random(6)
    groups = {f"g{n}": [rng.random() for _ in range(n)] for n in range(1, 40)}
    _, d = build(spark, [(g, v) for g, vs in groups.items() for v in vs])
    for r in digests.percentiles(d, ["g"], (25, 50, 90)).collect():
        vs = sorted(groups[r.g])
        assert r.estimate == vs[max(1, math.ceil(len(vs) * r.percent / 100)) - 1] and r.error_bound == 0


def test_days_combine_into_months(spark):
    rng = random.Random(8)
    rows = [(f"d{i % 30}", rng.random()) for i in range(60_000)]
    _, daily = build(spark, rows)
    month = digests.merge_digests(daily.withColumn("g", F.lit("m")), ["g"])
    assert sizes(month)["m"][0] <= digests.DELTA
    values = [v for _, v in rows]
    for r in digests.percentiles(month, ["g"], (10, 50, 90)).collect():
        assert abs(ranks(values, r.estimate)[0] / len(values) - r.percent / 100) <= r.error_bound + 1e-9 <= 0.03


def test_large_groups_become_short():
    values = np.random.default_rng(1).random(50_000)
    group, made, _ = digests.clustered(np.zeros(50_000, dtype=np.int64), [values, np.ones(50_000, dtype=np.int64), values, values], 400)
    assert len(group) <= 201 and made[1].sum() == 50_000


@pytest.mark.parametrize(("heavy", "fan", "most"), [(1_000_000, 64, 1), (700, 64, 15), (100, 3, 100)])
def test_parts_and_buffers_do_not_change_the_counts(spark, heavy, fan, most):
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 500 AS STRING) END AS g", "CAST(id AS DOUBLE) AS v").coalesce(3)
    values = digests.placed(df, ["g"], "v", heavy=heavy)
    assert values.most == most
    d = digests.group_digests(values, buffer_rows=3_000, fan=fan)
    got = sizes(d)
    assert got["hot"][1] == 10_000 and got["hot"][0] <= 220 and sum(n for _, n in got.values()) == 30_000
    for r in digests.percentiles(d.where("g = 'hot'"), ["g"], (10, 50, 90)).collect():
        assert abs(r.estimate / 30_000 - r.percent / 100) <= r.error_bound + 1e-4 <= 0.06


def test_finer_groups(spark):
    df = spark.range(5_000).selectExpr("CAST(id % 2 AS STRING) AS g", "CAST(id % 31 AS STRING) AS d", "CAST(id AS DOUBLE) AS v")
    for heavy in (1_000_000, 300):
        rows = digests.group_digests(digests.placed(df, ["g"], "v", within="d", heavy=heavy)).select("g", "d", F.aggregate("digest", F.lit(0).cast("bigint"), lambda a, c: a + c["weight"]).alias("n")).collect()
        assert len(rows) == 2 * 31 + 2 and {r.n for r in rows if r.d is None} == {2_500} and sum(r.n for r in rows) == 10_000


def test_many_digests_merge_in_a_tree(spark):
    _, daily = build(spark, [(f"d{i}", float(i * 50 + j)) for i in range(300) for j in range(50)])
    month = digests.merge_digests(daily.withColumn("g", F.lit("m")), ["g"], most=300, fan=8)
    assert sizes(month)["m"][1] == 15_000
    (median,) = digests.percentiles(month, ["g"], (50,)).collect()
    assert abs(median.estimate / 15_000 - 0.5) <= median.error_bound <= 0.06


def test_defined_results(spark):
    rows = [("1", "a", 1.0), ("1", "a", 1.0), ("1", "a", 2.0), ("2", "a", None), ("3", "a", float("nan")), ("4", "a", float("inf")), ("5", None, 1.0), (None, "a", 3.0), (None, "a", 3.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sizes(digest(df, id_column="id")) == {"a": (4, 4)}  # 1 and 2 of id 1 and both of null id
    points = spark.createDataFrame([("a", 1.0), ("a", 2.5), ("a", None), ("b", 1.0)], "g string, x double")
    counts = digests.counted_ranks(df, ["g"], "v", points, "x", "id").collect()
    assert sorted((r.x, r.n, r.le, r.lt) for r in counts) == [(1.0, 4, 1, 0), (2.5, 4, 2, 2)]
    empty = spark.createDataFrame([], SCHEMA)
    assert digest(empty).count() == 0 and digests.percentiles(digest(empty), ["g"], (50,)).count() == 0
    more = spark.createDataFrame([("1", "a", 1.0, 7, 8, 9.0, "z")], SCHEMA + ", mean int, weight int, value double, part string")
    assert digest(more).count() == 1


def details(spark, root, prices):
    """An order_detail table: (product_id, day of March 2024, unit_price) per row."""
    rows = [(str(i), p, v, f"2024-03-{day:02d} 10:00:00") for i, (p, day, v) in enumerate(prices)]
    df = spark.createDataFrame(rows, "id string, product_id bigint, unit_price double, loaded_at string")
    df.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).write.parquet(f"{root}/order_detail.parquet")


def test_days_and_months_come_out(spark, tmp_path):
    rng = random.Random(10)
    prices = [(p, day, float(rng.randint(1, 500))) for p in (1, 2) for day in range(1, 9) for _ in range(rng.randint(1, 40))]
    details(spark, tmp_path, prices)
    groups: dict = {}
    for p, day, v in prices:
        for period in (f"2024-03-{day:02d}", "2024-03"):
            groups.setdefault((p, period), []).append(v)
    got = queries.p5_percentiles(spark, str(tmp_path)).collect()
    assert sorted((r.product_id, r.period, r.percent) for r in got) == sorted((*g, q) for g in groups for q in (25, 50, 75, 90))
    for r in got:
        vs = sorted(groups[r.product_id, r.period])
        le, lt = ranks(vs, r.estimate)
        rank = max(1, math.ceil(len(vs) * r.percent / 100))
        assert r.n == len(vs) and r.rank_error == pytest.approx(max(0, rank - le, lt + 1 - rank) / len(vs)) and r.rank_error <= r.error_bound
        if len(r.period) == 10:
            assert r.estimate == vs[rank - 1] and r.error_bound == 0


def test_infinite_prices_count_in_both_passes(spark, tmp_path):
    rng, inf = random.Random(12), float("inf")
    prices = [(1, 1 + i % 5, float(rng.randint(1, 500))) for i in range(3_000)] + [(1, 1 + i % 5, inf) for i in range(1_500)] + [(1, 1 + i % 5, -inf) for i in range(90)]
    prices += [(2, 1, v) for v in (1.0, 2.0, inf, inf)] + [(3, 1, -inf), (3, 1, inf)]
    details(spark, tmp_path, prices)
    groups: dict = {}
    for p, day, v in prices:
        for period in (f"2024-03-{day:02d}", "2024-03"):
            groups.setdefault((p, period), []).append(v)
    got = queries.p5_percentiles(spark, str(tmp_path)).collect()
    for r in got:
        vs = groups[r.product_id, r.period]
        le, lt = ranks(vs, r.estimate)
        rank = max(1, math.ceil(len(vs) * r.percent / 100))
        assert r.n == len(vs) and r.rank_error == pytest.approx(max(0, rank - le, lt + 1 - rank) / len(vs))
        assert r.rank_error <= r.error_bound <= 0.03 and math.isinf(r.estimate) == math.isinf(sorted(vs)[rank - 1])
    # the 25th percentile of the finite prices alone is too low a first quartile where infinite ones count
    finite = sorted(v for p, _, v in prices if p == 1 and not math.isinf(v))
    month, fine = sorted(groups[1, "2024-03"]), finite[len(finite) * 25 // 100]
    points = [(1, 1, "2024-03", fine), (2, 1, "2024-03", month[len(month) * 25 // 100]), (3, 2, "2024-03-01", 1.0), (4, 2, "2024-03", inf)]
    spark.createDataFrame([(i, p, period, "unitPrice", str(x)) for i, p, period, x in points], "profile_id bigint, product_id bigint, period string, field string, percentile25 string").write.parquet(f"{tmp_path}/row_description.parquet")
    want = set()
    for i, p, period, x in points:
        vs = groups[p, period]
        le, lt = ranks(vs, x)
        if le < math.ceil(len(vs) * 0.2) or lt >= math.ceil(len(vs) * 0.3):
            want.add(i)
    assert want == {1, 4} and {r.profile_id for r in queries.p5_found(spark, str(tmp_path)).collect()} == want
