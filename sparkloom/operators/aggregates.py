"""The aggregation algebra: expressions over the rows of a group that combine, map and nest.

An aggregation builds Columns from a row. The same one serves in a group (partial and final hash aggregation) and
over a window, where it always takes the whole partition. ``a & b`` runs both over the group, ``a.map(f)``
projects the result, ``a.contramap(f)`` the input. Reports nest: a report is grouped once more by its own key
and gathered as a list of records, level by level, never by collecting a group's rows.

Missing values: lists and sets keep nulls; ``min_of``/``max_of`` treat null as the least value; sums and averages
skip nulls; ``std`` is the population's. Lists, folds and reductions with unknown functions gather the group's
values into one list and so need groups that fit a task; give ``order`` where the order matters.
"""

from __future__ import annotations

import builtins
import operator
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.rows import Given, Relation, Row, call, columns_of, fresh, named, project

Wrap = Callable[[Column], Column]


class Aggregation:
    """``build(row, wrap)`` gives the value; ``wrap`` places each aggregate in its window, if any.

    ``parts`` are the sums, counts, least and greatest values it is made of, if it is: then it can be had from those of
    finer groups, as ``finish`` of them.
    """

    def __init__(self, build: Callable[[Row, Wrap], Any], parts: tuple[tuple[str, Callable], ...] = (), finish: Callable = lambda *c: c[0]):
        self._build, self.parts, self.finish = build, parts, finish

    def __call__(self, row: Row, wrap: Wrap = lambda c: c) -> Any:
        return self._build(row, wrap)

    def map(self, f: Callable) -> Aggregation:
        return Aggregation(lambda row, wrap: f(*_flat(self(row, wrap))), self.parts, lambda *c: f(*_flat(self.finish(*c))))

    def contramap(self, f: Callable[[Row], Row]) -> Aggregation:
        inner = tuple((kind, lambda row, part=part: part(_as_row(call(f, row)))) for kind, part in self.parts)
        return Aggregation(lambda row, wrap: self(_as_row(call(f, row)), wrap), inner, self.finish)

    def __and__(self, other: Aggregation) -> Aggregation:
        return Aggregation(lambda row, wrap: (*_flat(self(row, wrap)), *_flat(other(row, wrap))))


def _as_row(value: Any) -> Row:
    return value if isinstance(value, Row) else Given(named(value))


def _flat(value: Any) -> tuple:
    return value if isinstance(value, tuple) else (value,)


def _one(value: Any) -> Column:
    """A value as one Column: records as structs, a record of one field as that field."""
    if isinstance(value, Row):
        only = list(value)
        return _one(only[0]) if len(only) == 1 else value.struct()
    if isinstance(value, (dict, tuple)):
        return F.struct(*[_one(v).alias(n) for n, v in named(value).items()])
    return value if isinstance(value, Column) else F.lit(value)


class Report:
    """A sub-grouping inside a group, to become a list of records."""

    def __init__(self, keys: tuple[Callable, ...], f: Callable, combiner: Callable | None = None):
        self.keys, self.f, self.combiner = keys, f, combiner

    def combine(self, f: Callable) -> Report:
        """With keys g1, g2: ``f(key1, builder)`` aggregates the records of g2 within g1."""
        return Report(self.keys, self.f, f)


class Builder:
    """The aggregation functions; ``f`` is a lambda over the row."""

    def const(self, value: Any) -> Aggregation:
        return Aggregation(lambda row, wrap: wrap(F.first(value if isinstance(value, Column) else F.lit(value))))

    def size(self) -> Aggregation:
        return Aggregation(lambda row, wrap: wrap(F.count(F.lit(1))), (("count", lambda row: F.lit(1)),))

    def count(self, p: Callable) -> Aggregation:
        return Aggregation(lambda row, wrap: wrap(F.count_if(F.coalesce(call(p, row), F.lit(False)))))

    def _by(self, make: Wrap) -> Callable[[Callable], Aggregation]:
        return lambda f: Aggregation(lambda row, wrap: make_wrapped(make, _one(call(f, row)), wrap))

    def sum_by(self, f: Callable) -> Aggregation:
        return Aggregation(self._by(F.sum)(f), (("sum", lambda row: _one(call(f, row))),))

    def sum(self) -> Aggregation:
        return self.sum_by(lambda r: r)

    def avg_by(self, f: Callable) -> Aggregation:
        return self._by(F.avg)(f)

    def avg(self) -> Aggregation:
        return self.avg_by(lambda r: r)

    def std_by(self, f: Callable) -> Aggregation:
        return self._by(F.stddev_pop)(f)

    def std(self) -> Aggregation:
        return self.std_by(lambda r: r)

    def product_by(self, f: Callable) -> Aggregation:
        return self._by(F.product)(f)

    def product(self) -> Aggregation:
        return self.product_by(lambda r: r)

    def min_of(self, f: Callable) -> Aggregation:
        boxed = lambda row: F.struct(_one(call(f, row)).alias("v"))
        return Aggregation(lambda row, wrap: wrap(F.min(boxed(row)))["v"], (("min", boxed),), lambda c: c["v"])

    def max_of(self, f: Callable) -> Aggregation:
        boxed = lambda row: F.struct(_one(call(f, row)).alias("v"))
        return Aggregation(lambda row, wrap: wrap(F.max(boxed(row)))["v"], (("max", boxed),), lambda c: c["v"])

    def min(self) -> Aggregation:
        return self.min_of(lambda r: r)

    def max(self) -> Aggregation:
        return self.max_of(lambda r: r)

    def to_list_by(self, f: Callable, order: Callable | None = None) -> Aggregation:
        def build(row: Row, wrap: Wrap) -> Column:
            value = _one(call(f, row)).alias("v")
            if order is None:
                return F.transform(wrap(F.collect_list(F.struct(value))), lambda z: z["v"])
            keys = [k.alias(f"o{i}") for i, k in enumerate(columns_of(call(order, row)))]
            return F.transform(F.sort_array(wrap(F.collect_list(F.struct(*keys, value)))), lambda z: z["v"])

        return Aggregation(build)

    def to_list(self, order: Callable | None = None) -> Aggregation:
        return self.to_list_by(lambda r: r, order)

    def distinct_by(self, f: Callable) -> Aggregation:
        """The set of values, sorted, nulls first."""
        return Aggregation(lambda row, wrap: F.transform(F.sort_array(wrap(F.collect_set(F.struct(_one(call(f, row)).alias("v"))))), lambda z: z["v"]))

    def distinct(self) -> Aggregation:
        return self.distinct_by(lambda r: r)

    def flat_distinct_by(self, f: Callable) -> Aggregation:
        """The set of the elements of arrays, sorted. Each array is reduced to its set before it is gathered."""
        return Aggregation(
            lambda row, wrap: F.sort_array(F.array_distinct(F.flatten(wrap(F.collect_set(F.array_distinct(F.coalesce(_one(call(f, row)), F.array())))))))
        )

    #: Functions that need no list.
    KNOWN = {operator.add: F.sum, operator.mul: F.product, builtins.min: F.min, builtins.max: F.max}

    def reduce_by(self, f: Callable, combine: Callable, order: Callable | None = None) -> Aggregation:
        """Binary reduction; ``operator.add``, ``operator.mul``, ``min`` and ``max`` become aggregates."""
        if combine in self.KNOWN:
            return self._by(self.KNOWN[combine])(f)
        listed = self.to_list_by(f, order)

        def build(row: Row, wrap: Wrap) -> Column:
            values = listed(row, wrap)
            return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), combine)

        return Aggregation(build)

    def reduce(self, combine: Callable, order: Callable | None = None) -> Aggregation:
        return self.reduce_by(lambda r: r, combine, order)

    def fold_left_by(self, f: Callable, zero: Any, step: Callable, order: Callable | None = None) -> Aggregation:
        listed = self.to_list_by(f, order)
        return Aggregation(lambda row, wrap: F.aggregate(listed(row, wrap), zero if isinstance(zero, Column) else F.lit(zero), step))

    def fold_left(self, zero: Any, step: Callable, order: Callable | None = None) -> Aggregation:
        return self.fold_left_by(lambda r: r, zero, step, order)

    def custom(self, f: Callable[[Column], Column], by: Callable) -> Aggregation:
        """Any aggregate function of Spark, or a grouped-aggregate pandas UDF, over a projection."""
        return self._by(f)(by)

    def report(self, *args: Callable) -> Report:
        """``report(g1, ..., f)``: ``f(keys..., builder)`` aggregates each sub-group; the result is a list of records."""
        *keys, f = args
        return Report(tuple(keys), f)


def make_wrapped(make: Wrap, value: Column, wrap: Wrap) -> Column:
    return wrap(make(value))


def aggregate(source: Relation, keys: list[Callable], f: Callable) -> Relation:
    """Group by ``keys`` and aggregate by ``f(key..., builder)``. Keys compare null-safely. No rows, no groups.

    In a dependent query the columns of the enclosing row are keys as well.
    """
    row = source.row
    values = [call(k, row) for k in keys]
    keyed = project(source.df, {"keys": tuple(values) if values else (F.lit(0),), "row": row}, source.hidden)
    key_shape, row_shape = keyed.shape.fields["keys"], keyed.shape.fields["row"]
    key_row = Row(key_shape)
    out = named(_materialised(f(*(list(key_row) if keys else []), Builder())))
    df, shape_values = _grouped(keyed.df, [*source.hidden, *key_shape.columns()], Row(row_shape), out)
    made = project(df, shape_values, source.hidden)
    return Relation(made.df, made.shape, source.hidden)


def _materialised(value: Any) -> Any:
    return {"value": value} if isinstance(value, (Aggregation, Report)) else value


#: How parts of aggregations are made from rows, and from those of finer groups.
_FIRST = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_AGAIN = {**_FIRST, "count": F.sum}


def _grouped(df: DataFrame, key_columns: list[str], row: Row, out: dict[str, Any], carried: dict[str, str] | None = None, make: dict[str, Callable] = _AGAIN) -> tuple[DataFrame, dict[str, Any]]:
    """The grouped DataFrame and what each output name is in it.

    Columns in ``carried`` (their kind by name) are grouped along by ``make``. If all aggregates are made of parts, the first report carries
    them, so that the rows are read and shuffled once for both.
    """
    aggregates, result, reports = [make[kind](F.col(n)).alias(n) for n, kind in (carried or {}).items()], {}, {}
    reports = {name: v for name, v in out.items() if isinstance(v, Report)}
    own = {name: v for name, v in out.items() if isinstance(v, Aggregation)}
    by_parts = bool(reports) and not carried and all(v.parts for v in own.values())
    parts: dict[str, tuple[str, Column]] = {}
    for name, v in out.items():
        if name in reports:
            continue
        if name not in own:
            result[name] = v  # an expression of the keys
            continue
        leaves = []
        if by_parts:
            names = [fresh() for _ in v.parts]
            parts |= {n: (kind, part(row)) for n, (kind, part) in zip(names, v.parts, strict=True)}
            leaves = [_one(c) for c in _flat(v.finish(*[F.col(n) for n in names]))]
        else:
            for c in _flat(v(row)):
                n = fresh()
                aggregates.append(_one(c).alias(n))
                leaves.append(F.col(n))
        result[name] = leaves[0] if len(leaves) == 1 else tuple(leaves)
    grouped = None
    if aggregates or not reports:
        grouped = df.groupBy(*key_columns).agg(*aggregates) if aggregates else df.select(*key_columns).distinct()
    for name, r in reports.items():
        listed, column = _reported(df, key_columns, row, r, parts)
        parts = {}
        if grouped is None:
            grouped = listed
        else:
            renamed = {k: fresh() for k in key_columns}
            right = listed.withColumnsRenamed(renamed)
            same = [F.col(k).eqNullSafe(F.col(n)) for k, n in renamed.items()]
            condition = same[0]
            for s in same[1:]:
                condition = condition & s
            grouped = grouped.join(right, condition).drop(*renamed.values())
        result[name] = F.col(column)
    return grouped, {n: result[n] for n in out}


def _reported(df: DataFrame, key_columns: list[str], row: Row, report: Report, parts: dict[str, tuple[str, Column]]) -> tuple[DataFrame, str]:
    """One report: grouped by its own keys below the outer ones, then listed per outer group, in order of its keys.

    ``parts`` of the outer group's aggregates (kind and column by name) are made on the way.
    """
    kinds = {n: kind for n, (kind, _) in parts.items()}
    own = project(df.withColumns({n: c for n, (_, c) in parts.items()}) if parts else df, {"sub": tuple(call(k, row) for k in report.keys), "row": row}, keep=(*key_columns, *kinds))
    sub, inner = Row(own.shape.fields["sub"]), Row(own.shape.fields["row"])
    subs = [list(columns_of_names(v)) for v in own.shape.fields["sub"].fields.values()]
    flat = [c for s in subs for c in s]
    out = named(_materialised(report.f(*sub, Builder())))
    grouped, values = _grouped(own.df, [*key_columns, *flat], inner, out, kinds, _FIRST)
    if report.combiner is not None:
        level = project(grouped, {"k": sub, "row": Given(values)}, keep=(*key_columns, *kinds))
        first = Row(level.shape.fields["k"])
        names = [n for n in columns_of_names(list(level.shape.fields["k"].fields.values())[0])]
        out = named(_materialised(report.combiner(list(first)[0], Builder())))
        grouped, values = _grouped(level.df, [*key_columns, *names], Row(level.shape.fields["row"]), out, kinds)
        flat = names
    target = fresh()
    record = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(flat)], F.struct(*[_one(v).alias(n) for n, v in values.items()]).alias("v"))
    listed = grouped.select(*key_columns, *kinds, record.alias(target)).groupBy(*key_columns)
    return listed.agg(F.transform(F.sort_array(F.collect_list(target)), lambda z: z["v"]).alias(target), *[_AGAIN[kind](n).alias(n) for n, kind in kinds.items()]), target


def columns_of_names(f: Any) -> list[str]:
    return list(f.columns()) if hasattr(f, "columns") else [f]
