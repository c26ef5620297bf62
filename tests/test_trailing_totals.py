import datetime as dt
import random
from collections import defaultdict

from sparkloom.operators.trailing_totals import current_orders, days_of, trailing_segments, trailing_totals

SCHEMA = "id bigint, customer_id string, order_date date, freight double, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
DAY, NOW = dt.date(2024, 3, 1), dt.datetime(2024, 6, 1)


def order(i, customer, day, freight, at=0, deleted=None):
    return (i, customer, None if day is None else DAY + dt.timedelta(day), freight, NOW + dt.timedelta(seconds=at), deleted)


def brute(amounts, windows):
    by = defaultdict(int)
    for e, d, a in amounts:
        by[e, d] += a
    out = {}
    for e in {e for e, _ in by}:
        days = [d for x, d in by if x == e]
        d = min(days)
        while d <= max(days) + dt.timedelta(max(windows) - 1):
            out[e, d] = tuple(sum(by.get((e, d - dt.timedelta(k)), 0) for k in range(w)) for w in windows)
            d += dt.timedelta(1)
    return out


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), DAY + dt.timedelta(rng.choice([0, 1, 2, 5, 40, 41, 90])), rng.randint(-5, 500)) for _ in range(300)]
    got = days_of(trailing_segments(spark.createDataFrame(rows, "entity string, day date, amount bigint"), (7, 30))).collect()
    assert {(r.entity, r.day): (r.total_7, r.total_30) for r in got} == brute(rows, (7, 30))
    assert len(got) == len({(r.entity, r.day) for r in got})


def test_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        order(1, " a ", 0, 1.005), order(1, "a", 0, 2.0, 5), order(1, "a", 0, 2.0, 5), order(2, "A", 0, 0.0), order(3, None, 0, 5.0), order(4, "a", None, 5.0),
        order(5, "a", 0, None), order(6, "a", 0, nan), order(7, "a", 0, inf), order(None, "a", 0, 9.0), order(8, "a", 0, 9.0, 0), order(8, "a", 0, 9.0, 9, NOW),
    ]
    got = [tuple(r) for r in current_orders(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == [("A", DAY, 0), ("A", DAY, 200)]


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trailing_totals(empty).count() == 0
    rows = [(*order(1, "a", 0, 7.0), "x", 1)]
    got = trailing_totals(spark.createDataFrame(rows, SCHEMA + ", entity string, day int")).orderBy("day").collect()
    assert len(got) == 30 and got[0].total_7 == 7.0 and got[0].avg_day_7 == 1.0 and got[7].total_7 == 0 and got[7].avg_order_7 is None and got[29].total_30 == 7.0


def test_hot_customer_is_bounded_by_its_days(spark):
    df = spark.range(50_000).selectExpr("'hot' AS entity", "date_add(DATE'2024-03-01', CAST(id % 3 AS INT)) AS day", "1L AS amount")
    segments = trailing_segments(df)
    assert segments.count() <= 9 and segments.agg({"total_7": "max"}).collect()[0][0] == 50_000
