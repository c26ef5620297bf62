"""Run queries beside their SQL twins: python tests/side_by_side.py SF [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path


def plain(v):
    """A value as both engines give it."""
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    return str(v) if hasattr(v, "isoformat") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark, con, query, sql, root):
    """(rows, rows only in Spark, rows only in SQL)."""
    df = query(spark, root)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns), (columns, df.columns)
    want = rows_of(columns, cur.fetchall())
    return sum(got.values()), got - want, want - got


def connect(root):
    import duckdb

    con = duckdb.connect()
    for p in Path(root).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parent.parent))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = sys.argv[1] if "/" in sys.argv[1] else f"/root/testdata/{sys.argv[1]}"
    con = connect(root)
    for name, query in entry.queries().items():
        if (len(sys.argv) > 2 and name not in sys.argv[2:]) or name not in entry.oracle_sql():
            continue
        began = time.time()
        try:
            n, more, less = difference(spark, con, query, entry.oracle_sql()[name], root)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: ERROR {str(e)[:600]}")
            continue
        print(f"{name}: {n} rows, {'same' if not more and not less else f'DIFF +{sum(more.values())} -{sum(less.values())} {list(more)[:3]} {list(less)[:3]}'} {time.time() - began:.1f}s", flush=True)
