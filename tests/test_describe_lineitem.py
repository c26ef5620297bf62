import __spark_entry__ as entry


def test_every_field_is_described(spark):
    root = "/root/testdata/sf0.001"
    got = {r.field: r for r in entry.queries()["describe_lineitem_fields"](spark, root).collect()}
    assert set(got) == set(spark.read.parquet(f"{root}/lineitem.parquet").columns)
    assert got["l_returnflag"].unique_values == "A,N,R" and got["l_returnflag"].mean is None and got["l_shipdate"].first < got["l_shipdate"].last
