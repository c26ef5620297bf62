import datetime as dt
import random

from pyspark.sql import functions as F
from sparkloom.operators.orphan_references import Keyed, Reference, every_span, first_to_last, orphan_cascade, orphan_report

PARENT = "id bigint, since timestamp_ntz, until timestamp_ntz"
CHILD = "id string, ref bigint, at timestamp_ntz"


def at(n):
    return None if n is None else dt.datetime(2024, 3, 1) + dt.timedelta(hours=n)


def cascade(spark, parents, children, single=False, child_schema=CHILD):
    p = spark.createDataFrame([(k, at(a), at(b)) for k, a, b in parents], PARENT)
    c = spark.createDataFrame([(i, k, at(t), *rest) for i, k, t, *rest in children], child_schema)
    spans = first_to_last(p, "id", "since", "until") if single else every_span(p, "id", "since", "until")
    return orphan_cascade([Keyed("p", p, "id", spans, single), Keyed("c", c, "id")], [Reference("c", "ref", "p", F.col("at"))])


def kinds(df):
    return {r.id: r.kind for r in df.collect()}


def test_spans(spark):
    parents = [(1, 0, 10), (1, 20, None), (2, 5, None), (3, None, 4)]
    children = [("a", 1, 5), ("b", 1, 10), ("c", 1, 20), ("d", 2, 4), ("e", 2, 5), ("f", 9, 5), ("g", None, 5), ("h", 3, 1), ("i", 3, 4), ("j", 2, None), ("k", 9, None), (None, 9, 1)]
    assert kinds(cascade(spark, parents, children)) == {"b": "deleted", "d": "later", "f": "missing", "i": "deleted", "k": "missing", None: "missing"}


def test_first_to_last(spark):
    parents = [(1, 5, None), (1, 9, 30)]
    assert kinds(cascade(spark, parents, [("a", 1, 4), ("b", 1, 5), ("c", 1, 29), ("d", 1, 30)], single=True)) == {"a": "later", "d": "deleted"}


def test_random_against_brute_force(spark):
    rng = random.Random(5)
    parents = [(rng.randint(0, 30), a := rng.randint(0, 50), rng.choice([None, a + rng.randint(1, 20)])) for _ in range(60)]
    children = [(str(i), rng.randint(0, 40), rng.randint(0, 70)) for i in range(500)]
    want = {}
    for i, k, t in children:
        own = [(a, b) for p, a, b in parents if p == k]
        if not any(a <= t and (b is None or t < b) for a, b in own):
            want[i] = "missing" if not own else "later" if t < min(a for a, _ in own) else "deleted"
    assert kinds(cascade(spark, parents, children)) == want


def test_repeated_rows_empty_tables_and_clashes(spark):
    assert cascade(spark, [], [("a", 1, 1), ("a", 1, 1)]).count() == 1
    assert cascade(spark, [(1, 0, None)], []).count() == 0
    got = cascade(spark, [(1, 0, None)], [("a", 2, 1, "x", "y", 3)], child_schema=CHILD + ", kind string, live_from string, key int")
    assert kinds(got) == {"a": "missing"}


def test_inherited_orphans_down_the_graph(spark):
    posts = spark.createDataFrame([(1, None), (2, 1), (3, 99), (4, 3), (5, 4), (6, 2), (7, 7)], "id bigint, parent bigint")
    votes = spark.createDataFrame([(10, 5), (11, 6), (12, None)], "id bigint, post bigint")
    out = orphan_cascade([Keyed("post", posts, "id"), Keyed("vote", votes, "id")], [Reference("post", "parent", "post"), Reference("vote", "post", "post")])
    got = {(r.table_name, r.id): (r.kind, r.inherited, r["round"]) for r in out.collect()}
    assert got == {("post", "3"): ("missing", False, 0), ("post", "4"): ("orphaned", True, 1), ("post", "5"): ("orphaned", True, 2), ("vote", "10"): ("orphaned", True, 3)}


def test_cycle_ends(spark):
    t = spark.createDataFrame([(1, 2), (2, 1), (3, 9), (4, 3), (3, 4)], "id bigint, up bigint")
    out = orphan_cascade([Keyed("t", t, "id")], [Reference("t", "up", "t")])
    assert {(r.id, r.key_value) for r in out.collect()} == {("3", "9"), ("4", "3"), ("3", "4")}


def test_report(spark):
    got = orphan_report(cascade(spark, [], [("a", 1, 1), ("a", 2, 1), ("b", 1, 24 * 40)])).collect()
    assert {(str(r.period), r.orphan_references, r.orphan_records) for r in got} == {("2024-03-01", 2, 1), ("2024-04-01", 1, 1)}
