"""Percentiles of very large numeric columns by merging centroid digests, with certified rank error.

A digest of a group is a short list of centroids: clusters of neighbouring values with mean, weight, least and
greatest value. The scale function ``k(q) = delta / (2 pi) * asin(2q - 1)`` sets how much of the ranks a cluster
may cover: little at the ends, at most about ``pi / delta`` in the middle. Sorted values (or centroids sorted
by mean) are cut where ``floor(k)`` changes. Digests merge by clustering the union of their centroids again, so
those of parts of a group, days or months combine in any order.

As each centroid keeps its least and greatest value, a digest bounds the rank of any point for certain: all of
a centroid lies below the point if its greatest value does, none if its least value doesn't. A second pass that
counts the values around an estimate gives its exact rank and so certifies the error.

Scale: values are put together by group once, sorted by Spark, and digested as they stream by, so each group leaves as one list of
at most about ``delta / 2`` centroids, with those of finer groups (``within``, the days of a month) made on the way. A
group of more than ``HEAVY`` values, as counted before, is parted by id; the digests of its parts are merged in a tree of ``FAN`` at a
time, so no task gets a group's values or all its digests. The counting pass sorts each value among the points of
its group and counts places, combined before the shuffle: no value meets each point in a row of its own. Points are held as one list per group.

Defined results: null and NaN values and rows with a null group are left out, and so are infinite values unless
``infinite`` is set, in the digests and in the counting pass alike; then they are the extremes and share no centroid
with finite ones; of rows alike in id, group and value one counts; rows with a null id each count; ties share clusters and are
exact in the rank bounds; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import cut

#: Twice the number of centroids a digest has at most; rank error in the middle is about pi / DELTA.
DELTA = 400
#: Rows that are digested at a time; a group that goes on behind them is held until it ends.
BUFFER_ROWS = 250_000
#: Values of a group beyond which it is parted.
HEAVY = 1_000_000
#: Digests that are merged in one task.
FAN = 64

CENTROID = ("mean", "weight", "least", "greatest")
DIGEST = "array<struct<mean:double,weight:bigint,least:double,greatest:double>>"
_STRUCT = pa.struct([("mean", pa.float64()), ("weight", pa.int64()), ("least", pa.float64()), ("greatest", pa.float64())])


def cluster_of(q: np.ndarray, delta: int) -> np.ndarray:
    """The cluster that the scale function assigns to a rank share."""
    return np.floor(delta / (2 * math.pi) * np.arcsin(np.clip(2 * q - 1, -1, 1))).astype(np.int64)


def clustered(group: np.ndarray, centroids: Sequence[np.ndarray], delta: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Digests of all groups at once from centroids (mean, weight, least, greatest), in order of group and mean.

    Gives the group of each new centroid, the centroids, and for each the index of a row it comes from. Raw values are centroids of weight 1.
    """
    order = np.lexsort((centroids[0], group))
    group, mean, weight, least, greatest = group[order], *(c[order] for c in centroids)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    upto = np.cumsum(weight)
    n = np.repeat(np.add.reduceat(weight, first), size)
    middle = upto - np.repeat(upto[first] - weight[first], size) - weight / 2
    cluster = cluster_of(middle / n, delta)
    end = np.where(np.isinf(mean), np.sign(mean), 0)
    at = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (cluster[1:] != cluster[:-1]) | (end[1:] != end[:-1])])
    total = np.add.reduceat(weight, at)
    made = [np.add.reduceat(mean * weight, at) / total, total, np.minimum.reduceat(least, at), np.maximum.reduceat(greatest, at)]
    return group[at], made, order[at]


def _lists(group: np.ndarray, centroids: list[np.ndarray]) -> tuple[np.ndarray, pa.ListArray]:
    """Where each group's centroids begin, and the centroids as a list per group."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    offsets = pa.array(np.r_[first, len(group)], pa.int32())
    return first, pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in centroids], fields=list(_STRUCT)))


def _opened(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each centroid, and the centroids."""
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), [flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)]


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _proper(values: DataFrame, value: str, infinite: bool) -> DataFrame:
    """The rows whose value counts."""
    x = F.col(value)
    kept = values.where(x.isNotNull() & ~F.isnan(x))
    return kept if infinite else kept.where(F.abs(x) != float("inf"))


def counting_values(values: DataFrame, columns: Sequence[str], value: str, id_column: str | None = None, infinite: bool = False) -> DataFrame:
    """``columns``, ``value`` as double, and _id, _own, which tell apart the rows that count each."""
    number = F.monotonically_increasing_id()
    own = number if id_column is None else F.when(F.col(id_column).isNull(), number)
    name = F.lit(None).cast("string") if id_column is None else F.col(id_column)
    chosen = _proper(values.select(*dict.fromkeys(columns), F.col(value).cast("double").alias("value"), name.alias("_id"), own.alias("_own")), "value", infinite)
    for c in columns:
        chosen = chosen.where(F.col(c).isNotNull())
    return chosen


class Placed(NamedTuple):
    """Values put together by group and part: rows of keys, within, part, parts, value, and the most parts that a group has."""

    rows: DataFrame
    keys: list[str]
    within: str | None
    most: int


def placed(
    values: DataFrame, keys: Sequence[str], value: str, within: str | None = None, id_column: str | None = None, heavy: int = HEAVY, infinite: bool = False
) -> Placed:
    """The values that count, each once.

    Groups of more than ``heavy`` values are counted out when this is called.
    """
    columns = [*keys, *([within] if within else [])]
    kept = counting_values(values, columns, value, id_column, infinite)
    hot = cut(kept.groupBy(*keys).count().where(F.col("count") > heavy).select(*keys, F.ceil(F.col("count") / heavy).cast("int").alias("parts")))
    parted = kept.join(hot, list(keys), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parted = parted.withColumn("part", F.pmod(F.xxhash64("_id", "_own"), F.col("parts")).cast("int")).repartition(*keys, "part")
    rows = (parted.distinct() if id_column else parted).select(*columns, "part", "parts", "value")
    return Placed(rows, list(keys), within, hot.agg(F.max("parts")).first()[0] or 1)


def part_digests(values: Placed, delta: int = DELTA, buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """Digests of the parts of each group: keys, within, part, parts, digest; with ``within`` both those of the finer groups
    and, with a null ``within``, those of the whole, merged from them."""
    rows, keys, within = values.rows, values.keys, values.within
    outer = [*keys, "part"]
    names = [*keys, *([within] if within else []), "part", "parts"]
    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names) + f", digest {DIGEST}"

    def digests_of(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = {n: _one(table.column(n)) for n in table.column_names}
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(table)]))
        value = columns["value"].to_numpy()
        fine, finer = group, 1
        if within:
            codes = columns[within].dictionary_encode()
            finer = len(codes.dictionary)
            fine = group * finer + codes.indices.to_numpy()
        fine, centroids, row = clustered(fine, [value, np.ones(len(value), dtype=np.int64), value, value], delta)

        def batch(ids: np.ndarray, made: list[np.ndarray], rows: np.ndarray, whole: bool) -> pa.RecordBatch:
            first, lists = _lists(ids, made)
            at = pa.array(rows[first])
            taken = [pa.nulls(len(first), columns[n].type) if whole and n == within else columns[n].take(at) for n in names]
            return pa.RecordBatch.from_arrays([*taken, lists], [*names, "digest"])

        yield batch(fine, centroids, row, False)
        if within:
            whole, merged, index = clustered(fine // finer, centroids, delta)
            yield batch(whole, merged, row[index], True)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                count += len(batch)
            if count < buffer_rows:
                continue
            table = pa.Table.from_batches(held)
            starts = _starts(table, outer)
            if starts[-1]:
                yield from digests_of(table.slice(0, starts[-1]), starts[:-1])
            held = table.slice(starts[-1]).combine_chunks().to_batches()
            count = len(table) - starts[-1]
        if count:
            table = pa.Table.from_batches(held)
            yield from digests_of(table, _starts(table, outer))

    return values.rows.select(*names, "value").sortWithinPartitions(*outer).mapInArrow(digest, schema)


def _starts(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Where the runs of equal rows begin."""
    new = np.zeros(len(table), dtype=bool)
    new[0] = True
    for n in names:
        c = _one(table.column(n))
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _mapped(digests: DataFrame, keep: Sequence[str], more: str, make: Callable[[pa.Array, list[pa.Array]], pa.RecordBatch]) -> DataFrame:
    """``make`` over the digests and the columns to keep."""
    schema = ", ".join([*(f"`{k}` {digests.schema[k].dataType.simpleString()}" for k in keep), more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield make(batch.column(len(keep)), batch.columns[: len(keep)])

    return digests.select(*keep, "digest").mapInArrow(run, schema)


def merge_digests(digests: DataFrame, keys: Sequence[str], delta: int = DELTA, most: int = FAN, fan: int = FAN) -> DataFrame:
    """One digest per group: keys, digest. ``most`` says how many of them a group has; more than ``fan`` are merged in a tree."""
    parts = math.ceil(most / fan)
    lots = digests.withColumn("_lot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))) if parts > 1 else digests
    while parts > 1:
        lots = _merged(lots, [*keys, "_lot"], delta)
        parts = math.ceil(parts / fan)
        lots = lots.withColumn("_lot", F.pmod("_lot", F.lit(parts)))
    return _merged(lots, list(keys), delta)


def _merged(digests: DataFrame, keys: list[str], delta: int) -> DataFrame:
    def make(column: pa.Array, kept: list[pa.Array]) -> pa.RecordBatch:
        row, centroids = _opened(column)
        group, made, _ = clustered(row, centroids, delta)
        return pa.RecordBatch.from_arrays([*kept, _lists(group, made)[1]], [*keys, "digest"])

    union = digests.groupBy(*keys).agg(F.flatten(F.collect_list("digest")).alias("digest"))
    return _mapped(union, keys, f"digest {DIGEST}", make)


def group_digests(values: Placed, delta: int = DELTA, buffer_rows: int = BUFFER_ROWS, fan: int = FAN) -> DataFrame:
    """One digest per group: keys, within, digest (with a null ``within`` for the whole group)."""
    by = [*values.keys, *([values.within] if values.within else [])]
    digests = part_digests(values, delta, buffer_rows)
    if values.most == 1:
        return digests.select(*by, "digest")
    digests = cut(digests)
    hot = merge_digests(digests.where(F.col("parts") > 1), by, delta, values.most, fan)
    return digests.where(F.col("parts") == 1).select(*by, "digest").unionByName(hot)


def nearest_rank(n: Column, percent: int) -> Column:
    """The rank, from 1, that the nearest-rank percentile takes among n values."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor((n * percent + 99) / 100))


def percentiles(digests: DataFrame, keys: Sequence[str], percents: Sequence[int]) -> DataFrame:
    """Estimates per group and percent: keys, percent, n, estimate, error_bound (greatest possible rank error, as a share)."""

    def make(column: pa.Array, kept: list[pa.Array]) -> pa.RecordBatch:
        row, (mean, weight, least, greatest) = _opened(column)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        upto = np.cumsum(weight)
        below, n = upto[first] - weight[first], np.add.reduceat(weight, first)
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for p in percents:
            rank = np.maximum(1, (n * p + 99) // 100)
            x = mean[np.searchsorted(upto, below + rank)]
            at = np.repeat(x, np.diff(np.r_[first, len(row)]))
            le, lt = (np.add.reduceat(np.where(m, weight, 0), first) for m in (greatest <= at, least < at))
            error = np.maximum(0, np.maximum(rank - le, lt + 1 - rank)) / n
            for c, v in zip(columns, (np.full(len(n), p, dtype=np.int32), n, x, error), strict=True):
                c.append(v)
        index = pa.array(np.tile(np.arange(len(column)), len(percents)))
        return pa.RecordBatch.from_arrays([*(k.take(index) for k in kept), *(pa.array(np.concatenate(c)) for c in columns)], [*keys, "percent", "n", "estimate", "error_bound"])

    return _mapped(digests, list(keys), "percent int, n long, estimate double, error_bound double", make)


def rank_bounds(digests: DataFrame, keys: Sequence[str], points: DataFrame, point: str) -> DataFrame:
    """Certain bounds of how many values lie at or below, and below, each point of its group.

    ``points`` has keys, point and other columns, which are kept; equal rows count once, points of groups without
    values give no row.
    """
    x = F.col(point)

    def weight_of(counts: Callable[[Column], Column]) -> Column:
        return F.aggregate("digest", F.lit(0).cast("bigint"), lambda acc, c: acc + F.when(counts(c), c["weight"]).otherwise(F.lit(0).cast("bigint")))

    joined = points.join(digests.select(*keys, "digest"), list(keys))
    bounds = joined.select(
        *points.columns,
        weight_of(lambda c: F.lit(True)).alias("n"),
        weight_of(lambda c: c["greatest"] <= x).alias("le_least"),
        weight_of(lambda c: c["least"] <= x).alias("le_most"),
        weight_of(lambda c: c["greatest"] < x).alias("lt_least"),
        weight_of(lambda c: c["least"] < x).alias("lt_most"),
    )
    return bounds.distinct()  # of the results, so that points whose size is known are broadcast


def counted_ranks(
    values: DataFrame, keys: Sequence[str], value: str, points: DataFrame, point: str, id_column: str | None = None, infinite: bool = False
) -> DataFrame:
    """The second pass: keys, point, and the exact numbers n of values, at or below (le), below (lt) each point of its group.

    The points of a group are held as a list; ``values`` are as for ``placed``. Groups without values give no row.
    """
    keys = list(keys)
    lists = cut(points.where(F.col(point).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_set(F.col(point).cast("double"))).alias("_points")))
    v = F.col("value")
    met = counting_values(values, keys, value, id_column, infinite).join(lists, keys)
    met = met.withColumns({"_under": F.size(F.filter("_points", lambda p: p < v)), "_upto": F.size(F.filter("_points", lambda p: p <= v))})
    once = met.select("_id", "_own", *keys, "value", "_under", "_upto").distinct() if id_column else met
    places = once.groupBy(*keys, "_under", "_upto").agg(F.count(F.lit(1)).alias("_count"))  # at most two places a point
    counts = places.groupBy(*keys).agg(F.collect_list(F.struct("_under", "_upto", "_count")).alias("_places"))
    at = counts.join(lists, keys).select(*keys, "_places", F.posexplode("_points").alias("_k", point))

    def total(counts_if: Callable[[Column], Column]) -> Column:
        return F.aggregate("_places", F.lit(0).cast("bigint"), lambda acc, c: acc + F.when(counts_if(c), c["_count"]).otherwise(F.lit(0).cast("bigint")))

    k = F.col("_k")  # a value is at or below point k if no more than k points are under it
    return at.select(*keys, point, total(lambda c: F.lit(True)).alias("n"), total(lambda c: c["_under"] <= k).alias("le"), total(lambda c: c["_upto"] <= k).alias("lt"))


def certified(estimates: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Estimates with ``rank_error``, the exact distance of the estimate's rank from the wanted one as a share.

    ``counts`` are the ``counted_ranks`` of the estimates.
    """
    counted = counts.select(*keys, "estimate", "le", "lt")
    rank = nearest_rank(F.col("n"), F.col("percent"))
    error = F.greatest(F.lit(0), rank - F.col("le"), F.col("lt") + 1 - rank) / F.col("n")
    return estimates.join(counted, [*keys, "estimate"]).select(*keys, "percent", "n", "estimate", "error_bound", error.alias("rank_error"))
