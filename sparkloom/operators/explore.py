"""Data exploration: describe and show."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from decimal import ROUND_HALF_EVEN, Context, Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ORDERED = (T.DateType, T.TimestampType, T.TimestampNTZType)
#: Columns of a description, all strings but the last.
DESCRIPTION = ("field", "count", "mean", "std", "min", "percentile25", "percentile75", "percentile90", "max")


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Paths and types of the scalar fields, nested records opened."""
    out = []
    for f in schema.fields:
        path = f"{prefix}`{f.name}`"
        out += leaves(f.dataType, f"{path}.") if isinstance(f.dataType, T.StructType) else [(path, f.dataType)]
    return out


_PERCENTS = (25, 75, 90)
#: Parts of a range of values that is looked into, and of the first ranges one to the factor e.
FINE, COARSE = 1 << 16, 1 << 10


def exact_percentiles(df: DataFrame, paths: dict[int, str], percents: tuple[int, ...] = _PERCENTS) -> dict[int, list[float | None]]:
    """Nearest-rank percentiles of numeric columns of any size and spread, exact, without sorting or shuffling values.

    A pass counts the values of all columns in ranges: first by sign and logarithm, then the ranges that hold a wanted rank in
    ``FINE`` equal parts, until each of those holds one value only. As each pass narrows a range by some 2^16 and a double has 52
    bits behind its first, at most six passes are made; a task holds the counts of its ranges. NaN is the greatest value.
    """
    x, n = F.col("x"), F.col("n")

    def chosen(cells: list[Column], bucket: Column, ranks: Column) -> list:
        """Per wanted rank, with its range ``j`` and percent ``k``, the part that holds it."""
        opened = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where(x.isNotNull())
        counted = opened.groupBy("i", "j", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        by = Window.partitionBy("i", "j")
        placed = counted.withColumn("upto", F.sum("n").over(by.orderBy("b"))).withColumn("all", F.sum("n").over(by)).withColumn("w", F.explode(ranks))
        rank = F.when(F.col("w.rank") > 0, F.col("w.rank")).otherwise(F.greatest(F.lit(1).cast("bigint"), F.floor((F.col("all") * F.col("w.percent") + 99) / 100)))
        held = placed.withColumn("rank", rank).where((F.col("w.j") == F.col("j")) & (F.col("upto") >= F.col("rank")) & (F.col("upto") - n < F.col("rank")))
        return held.select("i", F.col("w.k").alias("k"), "lo", "hi", (F.col("rank") - F.col("upto") + n).alias("rank")).collect()  # one row per column and percent

    def wanted(j: int, k: int, rank: int) -> Column:
        return F.struct(F.lit(j).alias("j"), F.lit(k).alias("k"), F.lit(percents[k]).alias("percent"), F.lit(rank).cast("bigint").alias("rank"))

    value = {i: F.col(p).cast("double") for i, p in paths.items()}
    size = F.floor(F.log(F.abs(x)) * COARSE) + 1_000_000
    coarse = F.when(F.isnan(x), 3_000_000).when(F.abs(x) == float("inf"), F.signum(x) * 2_500_000).when(x == 0, 0).otherwise(F.signum(x) * size)
    cells = [F.struct(F.lit(i).alias("i"), F.lit(0).alias("j"), v.alias("x")) for i, v in value.items()]
    found = chosen(cells, coarse.cast("bigint"), F.array(*[wanted(0, k, 0) for k in range(len(percents))]))
    out: dict[int, list[float | None]] = {i: [None] * len(percents) for i in paths}
    while found:
        for r in found:
            out[r.i][r.k] = r.lo
        wide = [r for r in found if r.lo < r.hi]
        ranges = sorted({(r.i, r.lo, r.hi) for r in wide})
        if not ranges:
            break
        cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.when(value[i].between(lo, hi), value[i]).alias("x"), F.lit(lo).alias("from"), F.lit(hi).alias("to")) for j, (i, lo, hi) in enumerate(ranges)]
        width = F.col("to") / FINE - F.col("from") / FINE
        fine = F.when(width == 0, (x > F.col("from")).cast("bigint")).otherwise(F.floor((x - F.col("from")) / width).cast("bigint"))
        found = chosen(cells, fine, F.array(*[wanted(ranges.index((r.i, r.lo, r.hi)), r.k, r.rank) for r in wide]))
    return out


def measures(df: DataFrame, accuracy: int | None = None, unique: bool = False) -> DataFrame:
    """Unformatted measures, one row per field that has a value: field, count, mean, std, min, percentiles, max, unique.

    All fields are measured in one pass. Percentiles are nearest rank and exact, by a few more when this is called. With ``accuracy`` they are approximate, with
    rank error 1/accuracy, in the first pass. Nulls don't count and arrays are left out. An empty table gives no rows.
    """
    none = F.lit(None)
    fields = [(i, path, kind) for i, (path, kind) in enumerate(leaves(df.schema)) if not isinstance(kind, (T.ArrayType, T.MapType))]
    numeric = {i: path for i, path, kind in fields if isinstance(kind, T.NumericType)}
    percentiles: dict[int, list[Column]] = {}
    if accuracy:
        percentiles = {i: [F.percentile_approx(F.col(p).cast("double"), q / 100, accuracy) for q in _PERCENTS] for i, p in numeric.items()}
    elif numeric:
        percentiles = {i: [F.lit(v) for v in found] for i, found in exact_percentiles(df, numeric).items()}
    aggregates, records = [], []
    for i, path, kind in fields:
        ordered = i in numeric or isinstance(kind, _ORDERED)
        x = F.col(path).cast("double") if i in numeric else F.col(path)
        wanted = {
            "count": F.count(x),
            "mean": F.avg(x) if i in numeric else None,
            "std": F.stddev_pop(x) if i in numeric else None,
            "min": F.min(x).cast("string") if ordered else None,
            **{f"percentile{q}": percentiles[i][k].cast("string") if i in numeric else None for k, q in enumerate(_PERCENTS)},
            "max": F.max(x).cast("string") if ordered else None,
            "unique": F.sort_array(F.collect_set(x.cast("string"))) if unique and not ordered else None,
        }
        kinds = {"count": "bigint", "mean": "double", "std": "double", "unique": "array<string>"}
        aggregates += [c.alias(f"_{i}_{n}") for n, c in wanted.items() if c is not None]
        records.append(
            F.struct(
                F.lit(path.replace("`", "")).alias("field"),
                F.lit(i in numeric).alias("numeric"),
                *[(none.cast(kinds.get(n, "string")) if c is None else F.col(f"_{i}_{n}")).alias(n) for n, c in wanted.items()],
            )
        )
    measured = df.agg(*aggregates).select(F.explode(F.array(*records)).alias("m")).select("m.*")
    return measured.where(F.col("count") > 0)


def round_plain(value: float | str | None, digits: int = 7) -> str | None:
    """A number rounded half-even to so many digits, as text."""
    if value is None:
        return None
    rounded = Context(prec=digits, rounding=ROUND_HALF_EVEN).create_decimal(Decimal(repr(float(value))))
    return str(rounded)


def describe(df: DataFrame, digits: int = 7, unique: bool = False, accuracy: int | None = None, full_names: bool = True) -> DataFrame:
    """The description of a table: DESCRIPTION as strings and ``unique``, the distinct values of text fields.

    Fields of nested records go by their path, or without ``full_names`` by their own name.

    ``unique`` gathers a text field's distinct values in one row; leave it out for fields with very many.
    """
    plain = F.udf(lambda v: round_plain(v, digits), "string")
    m = measures(df, accuracy, unique)

    def shown(name: str) -> Column:
        return F.when(F.col("numeric"), plain(F.col(name).try_cast("double"))).otherwise(F.col(name).cast("string")).alias(name)

    values = F.coalesce("unique", F.array().cast("array<string>")).alias("unique")
    name = F.col("field") if full_names else F.substring_index("field", ".", -1).alias("field")
    return m.select(name, F.col("count").cast("string").alias("count"), *[shown(n) for n in DESCRIPTION[2:]], values)


_WIDE = {"W", "F"}


def width(text: str) -> int:
    """Columns that a text takes on a terminal."""
    return sum(2 if unicodedata.east_asian_width(c) in _WIDE else 1 for c in text)


def cell(value: Any) -> str:
    """A value as it is shown: lists in brackets, maps and records in braces, ``null`` for nothing."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return "{" + ", ".join(f"{cell(k)}: {cell(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple, set)):
        return "[" + ", ".join(cell(v) for v in value) + "]"
    return str(value)


def table_text(df: DataFrame, rows: int = 20, truncate: bool | int = True) -> str:
    """The first rows as a text table with dotted headers for nested records."""
    paths = [p for p, _ in leaves(df.schema)]
    limit = 20 if truncate is True else int(truncate)
    flat = df.select(*[F.col(p).alias(f"c{i}") for i, p in enumerate(paths)])
    got = flat.limit(rows + 1).collect()
    headers = [p.replace("`", "") for p in paths]

    def cut(text: str) -> str:
        text = re.sub(r"[\n\r\t]", " ", text)
        if not limit or len(text) <= limit:
            return text
        return text[: limit - 3] + "..." if limit > 3 else text[:limit]

    cells = [[cut(cell(v)) for v in r] for r in got[:rows]]
    widths = [max(3, width(h), *(width(r[i]) for r in cells)) if cells else max(3, width(h)) for i, h in enumerate(headers)]
    pad = (lambda t, w: " " * (w - width(t)) + t) if limit else (lambda t, w: t + " " * (w - width(t)))
    rule = "+" + "+".join("-" * w for w in widths) + "+\n"
    lines = ["|" + "|".join(pad(t, w) for t, w in zip(r, widths, strict=True)) + "|\n" for r in [headers, *cells]]
    text = rule + lines[0] + rule + "".join(lines[1:]) + rule
    return text + (f"only showing top {rows} row{'s' * (rows != 1)}\n" if len(got) > rows else "")


def show(df: DataFrame, rows: int = 20, truncate: bool | int = True, out: Callable[[str], Any] = print) -> None:
    out(table_text(df, rows, truncate))
