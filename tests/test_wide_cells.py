import datetime as dt

import pytest
from pyspark.sql import functions as F
from sparkloom.operators.wide_cells import as_run, cells_of, compact, contradictions, deltas, iso_date, stored_runs, wide

ROW = "row_id bigint, year int, industry_code_anzsic string, rme_size_grp string, variable string, value string, loaded_at timestamp_ntz"
ATTRIBUTES = [("V1", "Staff cost", "decimal", "money", "KDOL"), ("V2", "Balance date", "date", None, None), ("V3", "Foreign owned", "boolean", None, None), ("V4", "Main process", "string", None, None)]


def at(n):
    return dt.datetime(2024, 3, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def attributes(spark):
    return spark.createDataFrame(ATTRIBUTES, "attr_code string, attr_name string, value_type string, quantity string, common_unit string")


def run(spark, attributes, rows, batch=None, schema=ROW):
    return compact(deltas(cells_of(spark.createDataFrame(rows, schema), attributes, batch)))


def row(i, variable, value, n=0, code="A1", size="ALL", year=2020):
    return (i, year, code, size, variable, value, at(n))


def test_equal_values_in_other_spellings(spark, attributes):
    rows = [
        row(1, "Staff cost", "4,667.8"), row(2, "STAFF-COST: ", "4.6678E3 k$", 40), row(3, "Staff cost - $000", "$4667.8k"), row(4, "Balance date", "28/09/2008"), row(5, "Balance. date.", "2008-09-28"),
        row(6, "Balance date", "28 Sep 2008"), row(7, "Foreign owned", "Y"), row(8, "Foreign_owned", "TRUE"), row(9, "Main process", " Line  work"), row(10, "Main process", "line work"),
    ]
    assert contradictions(run(spark, attributes, rows)).count() == 0


def test_contradictions(spark, attributes):
    rows = [row(1, "Staff cost", "1"), row(2, "Staff cost", "2", 70), row(3, "Foreign owned", "no"), row(4, "Foreign owned", "1"), row(5, "Balance date", "01/02/2020"), row(6, "Balance date", "2020-01-02")]
    got = contradictions(run(spark, attributes, rows)).collect()
    assert sorted(r.attr_code for r in got) == ["V1", "V2", "V3"]


def test_latest_version_and_missing_marks(spark, attributes):
    rows = [row(1, "Staff cost", "5", 1), row(2, "Staff cost", "..", 9), row(3, "Staff cost", None, 10), row(4, "Main process", "x", 2), row(5, "Main process", "y", 2), row(6, "Foreign owned", "C")]
    got = wide(run(spark, attributes, rows), attributes).collect()
    assert len(got) == 1 and got[0].V1 == 5.0 and got[0].V4 == "y" and got[0].V3 is None and got[0].contradicted == ["V4"]


def test_runs_merge_in_any_grouping(spark, attributes):
    rows = [row(i, "Staff cost", str(i % 4), i, code=f"A{i % 3}") for i in range(60)]
    whole = {tuple(r) for r in run(spark, attributes, rows).collect()}
    first = run(spark, attributes, rows[:20])
    later = deltas(cells_of(spark.createDataFrame(rows[20:], ROW), attributes))
    merged = compact(as_run(first, F.lit(0).cast("timestamp").cast("timestamp_ntz")).unionByName(later))
    assert {tuple(r) for r in merged.collect()} == whole


def test_null_keys_unknown_variables_empty_table_clashes(spark, attributes):
    rows = [row(1, "Staff cost", "1", code=None), row(2, "Staff cost", "1", size=" "), row(3, "Staff cost", "1", year=None), row(4, "Nothing known", "1"), row(5, None, "1"), row(6, "Staff cost", "1", code=" a1 ")]
    got = run(spark, attributes, rows).collect()
    assert [(r.industry_code_anzsic, r.attr_code) for r in got] == [("A1", "V1")]
    assert run(spark, attributes, []).count() == 0 and wide(run(spark, attributes, []), attributes).count() == 0
    more = [(*row(1, "Staff cost", "1"), "z", "q")]
    assert run(spark, attributes, more, schema=ROW + ", attr_code string, cells string").count() == 1


def test_long_text_and_repeated_rows(spark, attributes):
    rows = [row(1, "Main process", "x" * 200_000)] * 3
    assert contradictions(run(spark, attributes, rows)).count() == 0


def test_dates(spark):
    df = spark.createDataFrame([("1.10.2014",), ("2014-10-1",), ("1 October 2014",), ("01/10/2014",), ("1 Foo 2014",), ("soon",), (None,)], "v string")
    assert [r.d for r in df.select(iso_date(F.col("v")).alias("d")).collect()] == ["2014-10-01"] * 4 + [None] * 3


def test_stored_runs_are_compacted_without_a_shuffle(spark, attributes):
    rows = [row(i, "Staff cost", str(i % 4), i, code=f"A{i % 3}") for i in range(60)]
    stored = compact(stored_runs(cells_of(spark.createDataFrame(rows, ROW), attributes)))
    assert {tuple(r) for r in stored.collect()} == {tuple(r) for r in run(spark, attributes, rows).collect()}
    assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()
