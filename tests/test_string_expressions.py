from pathlib import Path

import __spark_entry__ as entry


def test_long_texts_keep_their_end(spark, tmp_path):
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        if p.stem != "sales_order":
            (tmp_path / p.name).symlink_to(p)
    orders = spark.read.parquet("/root/testdata/sf0.001/sales_order.parquet").limit(1).drop("ship_country")
    country = "x" + "y" * 3000 + "z"
    orders.selectExpr("*", f"'{country}' AS ship_country").write.parquet(f"{tmp_path}/sales_order.parquet")
    assert entry.queries()["string_expressions"](spark, str(tmp_path)).collect()[0].country == "X" + country[1:]
