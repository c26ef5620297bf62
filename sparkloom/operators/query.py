"""The fluent query surface: immutable descriptions that compile to DataFrames when they are run.

``select("orders").where(...).map(...)`` describes; ``.run(inputs)`` or ``.to_df(inputs)`` compiles against named
inputs. Lambdas get rows of Columns, so Catalyst sees every expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators import aggregates, stateful
from sparkloom.operators.aggregates import Aggregation, Builder
from sparkloom.operators.rows import Relation, Row, Shape, call, columns_of, fresh, relation


class Inputs:
    """Named inputs; ``&`` merges and refuses a name given twice."""

    def __init__(self, tables: dict[str, DataFrame], around: Relation | None = None):
        self.tables, self.around = dict(tables), around

    def __and__(self, other: Inputs) -> Inputs:
        twice = self.tables.keys() & other.tables.keys()
        if twice:
            raise ValueError(f"inputs given twice: {sorted(twice)}")
        return Inputs({**self.tables, **other.tables})

    and_ = __and__

    def alias(self, old: str, new: str) -> Inputs:
        """The same input under another name."""
        return Inputs({(new if n == old else n): df for n, df in self.tables.items()})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no input {name!r}; there are {sorted(self.tables)}")
        return self.tables[name]


def inputs(**tables: DataFrame) -> Inputs:
    return Inputs(tables)


Build = Callable[[Inputs], Relation]


def is_in(c: Column, a: Any, b: Any, *rest: Any) -> Column:
    """Null-safe membership among at least two values."""
    return is_in_collection(c, (a, b, *rest))


def is_in_collection(c: Column, values: Iterable[Any]) -> Column:
    """Null-safe membership in a local collection."""
    values = list(values)
    known = [v for v in values if v is not None]
    found = F.coalesce(c.isin(known), F.lit(False)) if known else F.lit(False)
    return found | c.isNull() if None in values else found


def same(a: Column, b: Column) -> Column:
    """Null-safe equality: missing equals missing."""
    return a.eqNullSafe(b)


class Query:
    """A query over named inputs. ``chain`` says that it only filters, projects, flattens and groups one scan."""

    def __init__(self, build: Build, text: str, chain: bool = False, grouped: bool = False):
        self._build, self._text, self.chain, self.grouped = build, text, chain, grouped

    # --- running

    def relation(self, given: Inputs | None = None) -> Relation:
        return self._build(given or Inputs({}))

    def to_df(self, given: Inputs | None = None) -> DataFrame:
        return self.relation(given).to_df()

    def explain(self) -> str:
        """The description as text, nodes joined by arrows."""
        return self._text

    __str__ = explain

    def _then(self, f: Callable[[Relation, Inputs], Relation], text: str, chain: bool = False) -> Query:
        return Query(lambda given: f(self._build(given), given), f"{self._text} -> {text}", chain and self.chain, self.grouped or text.startswith("GROUP"))

    # --- projections and filters

    def map(self, f: Callable) -> Query:
        return self._then(lambda r, _: r.project(call(f, r.row)), "MAP", chain=True)

    def where(self, p: Callable) -> Query:
        return self._then(lambda r, _: r.over(r.df.filter(call(p, r.row))), "WHERE", chain=True)

    filter = where

    def where_not(self, p: Callable) -> Query:
        """Rows for which the predicate is not true; an undefined predicate counts as false."""
        return self._then(lambda r, _: r.over(r.df.filter(~F.coalesce(call(p, r.row), F.lit(False)))), "WHERE_NOT", chain=True)

    def collect(self, p: Callable, f: Callable) -> Query:
        """Filter and project in one step, as a partial function does."""
        return self._then(lambda r, _: r.project(call(f, r.row), r.df.filter(call(p, r.row))), "COLLECT", chain=True)

    def map_concat(self, f: Callable) -> Query:
        """A row per element of the array; with a name per element if it is a struct."""

        def build(r: Relation, _: Inputs) -> Relation:
            name = fresh()
            df = r.df.select("*", F.explode(call(f, r.row)).alias(name))
            kind = df.schema[name].dataType
            value = {n: F.col(name)[n] for n in kind.names} if isinstance(kind, T.StructType) else F.col(name)
            return r.project(value, df)

        return self._then(build, "MAP_CONCAT", chain=True)

    def flat_map(self, f: Callable[[Row], Query]) -> Query:
        """For each row the rows of a query that may refer to it.

        A dependent query that filters, projects, flattens and groups one scan is built on the product with that scan, so
        its conditions become join conditions; any other is a lateral join.
        """

        def build(r: Relation, given: Inputs) -> Relation:
            inner = call(f, r.row)
            if inner.chain:
                hidden, df = (*dict.fromkeys([*r.hidden, *r.shape.columns()]),), r.df
                if inner.grouped:  # equal rows are still rows of their own
                    own = fresh()
                    hidden, df = (*hidden, own), df.withColumn(own, F.monotonically_increasing_id())
                around = Relation(df, r.shape, hidden)
                made = inner.relation(Inputs(given.tables, around))
                return Relation(made.df, made.shape, r.hidden)
            dependent = call(f, Row(r.shape, outer=True)).relation(Inputs(given.tables))
            return Relation(r.df.lateralJoin(dependent.df), dependent.shape, r.hidden)

        return self._then(build, "FLATMAP", chain=True)

    def where_exists(self, f: Callable[[Row], Query]) -> Query:
        """Rows for which the dependent query has a row (a semi-join)."""
        return self._then(lambda r, given: Relation(r.df.where(call(f, Row(r.shape, True)).relation(Inputs(given.tables)).df.exists()), r.shape, r.hidden), "WHERE SUBQUERY")

    def where_not_exists(self, f: Callable[[Row], Query]) -> Query:
        """Rows for which the dependent query has no row (an anti-join)."""
        return self._then(lambda r, given: Relation(r.df.where(~call(f, Row(r.shape, True)).relation(Inputs(given.tables)).df.exists()), r.shape, r.hidden), "WHERE NOT SUBQUERY")

    # --- joins

    def _join(self, that: Query, how: str, text: str) -> Joining:
        return Joining(self, that, how, text)

    def join(self, that: Query) -> Joining:
        return self._join(that, "inner", "INNER JOIN")

    def cross_join(self, that: Query) -> Joining:
        return self._join(that, "inner", "CROSS JOIN")

    def left_join(self, that: Query) -> Joining:
        return self._join(that, "left", "LEFT JOIN")

    def join_containing(self, that: Query, array: Callable, element: Callable) -> Query:
        """Pairs where the left row's array contains the right row's value, as an equi-join on its distinct elements."""

        def build(given: Inputs) -> Relation:
            left, right = self.relation(given), that.relation(given)
            e = fresh()
            opened = left.df.select("*", F.explode(F.array_distinct(call(array, left.row))).alias(e))
            return Relation(opened.join(right.df, F.col(e) == call(element, right.row)).drop(e), Shape({"left": left.shape, "right": right.shape}))

        return Query(build, f"({self._text}) INNER JOIN ({that._text})")

    # --- grouping, windows, order

    def group_by(self, *keys: Callable) -> Grouping:
        return Grouping(self, keys)

    def window(self, f: Callable[[Builder], dict[str, Any]]) -> Windowing:
        """Append the results of ``f(builder)``, a dict of aggregations and rankings, to each row."""
        return Windowing(self, f)

    def order_by(self, *keys: Callable) -> Query:
        """Sort by keys, each a lambda giving Columns, ``.asc()`` or ``.desc()``; nulls are least."""
        return self._then(lambda r, _: Relation(r.df.orderBy(*[c for k in keys for c in columns_of(call(k, r.row))]), r.shape), "ORDER BY")

    def ordered(self) -> Query:
        """Sort by all columns."""
        return self._then(lambda r, _: Relation(r.df.orderBy(*r.shape.columns()), r.shape), "ORDER BY")

    # --- sets and composition

    def union(self, that: Query) -> Query:
        """All rows of both, by field name."""

        def build(given: Inputs) -> Relation:
            return relation(self.to_df(given).unionByName(that.to_df(given)))

        return Query(build, f"({self._text}) UNION ({that._text})")

    __add__ = union

    def deduplicate(self) -> Query:
        return self._then(lambda r, _: Relation(r.df.dropDuplicates(), r.shape), "DEDUPLICATE")

    def deduplicate_by(self, f: Callable, first: Callable, descending: bool = False) -> Query:
        """The first row per key in the order of ``first``, or the last; it is chosen by an aggregate, so hot keys combine early."""

        def build(r: Relation, _: Inputs) -> Relation:
            columns, keys = list(r.shape.columns()), [c.alias(fresh()) for c in columns_of(call(f, r.row))]
            # ties fall to the least row; maps have no order, their text has
            order = F.struct(*columns_of(call(first, r.row)), *[F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in r.df.select(*columns).schema.fields])
            got = r.df.groupBy(*keys).agg((F.max_by if descending else F.min_by)(F.struct(*columns), order).alias("_first"))
            return Relation(got.select("_first.*"), r.shape)

        return self._then(build, "DEDUPLICATE BY")

    def and_then(self, that: Query, name: str) -> Query:
        """Feed this query's rows to ``that`` as its input ``name``; the other inputs stay visible."""

        def build(given: Inputs) -> Relation:
            return that.relation(Inputs({**given.tables, name: self.to_df(given)}))

        return Query(build, f"{self._text} AND THEN {that._text}")

    __rshift__ = and_then

    # --- stateful

    def running(self, f: Callable[[Builder], dict[str, Any]], order: Callable | Iterable[Callable], *keys: Callable) -> Query:
        """``stateful_map`` for states that are aggregates: each row with the aggregates of all rows of its key up to it, without Python.

        Rows that are equal in ``order`` come one after the other, in any order. Without a key all rows go through one task.
        """

        def build(r: Relation, _: Inputs) -> Relation:
            row = r.row
            by = [c for o in ((order,) if callable(order) else order) for c in columns_of(call(o, row))]
            upto = Window.partitionBy(*[c for k in keys for c in columns_of(call(k, row))]).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            added = {name: a(row, lambda c: c.over(upto)) for name, a in f(Builder()).items()}
            return r.project({**dict(zip(r.shape.fields, row, strict=True)), **added})

        return self._then(build, "RUNNING")

    def stateful_map(self, zero: Callable[[], Any], step: Callable, schema: str, order: Callable, key: Callable | None = None) -> Query:
        """Running state, one row out per row: ``step(state, row) -> (state, row out)``; rows are dicts."""
        return self.stateful_map_concat(zero, lambda s, r: (lambda t: (t[0], [t[1]]))(step(s, r)), schema, order, key, "STATEFUL_MAP")

    def stateful_map_concat(
        self, zero: Callable[[], Any], step: Callable, schema: str, order: Callable, key: Callable | None = None, text: str = "STATEFUL MAP CONCAT"
    ) -> Query:
        """Running state, any number of rows out per row. With a key each key has its own state."""

        def build(r: Relation, _: Inputs) -> Relation:
            keys = columns_of(call(key, r.row)) if key else []
            return relation(stateful.run_ordered(r.to_df(), r, keys, columns_of(call(order, r.row)), zero, step, schema))

        return self._then(build, text)

    def accumulate(self, zero: Callable[[], Any], step: Callable, results: Callable, schema: str, merge: Callable | None = None, order: Callable | None = None) -> Query:
        """Fold all rows, then emit rows. With ``merge`` partitions fold on their own and their states are merged;
        without, one task folds all rows in ``order``."""

        def build(r: Relation, _: Inputs) -> Relation:
            by = columns_of(call(order, r.row)) if order else []
            return relation(stateful.fold_all(r.to_df(), r, by, zero, step, results, schema, merge))

        return self._then(build, "ACCUMULATE")


class Joining:
    def __init__(self, left: Query, right: Query, how: str, text: str):
        self._left, self._right, self._how, self._text = left, right, how, text

    def on(self, p: Callable[[Row, Row], Column]) -> Query:
        """Rows of two fields ``left`` and ``right``; after a left join ``right.is_defined()`` says if there is a match."""

        def build(given: Inputs) -> Relation:
            left, right = self._left.relation(given), self._right.relation(given)
            right_df, right_shape = right.df, right.shape
            if self._how == "left":
                marker = fresh()
                right_df, right_shape = right_df.withColumn(marker, F.lit(True)), Shape(right_shape.fields, marker)
            df = left.df.join(right_df, p(left.row, Row(right.shape)), self._how)
            return Relation(df, Shape({"left": left.shape, "right": right_shape}))

        return Query(build, f"({self._left}) {self._text} ({self._right})")


class Grouping:
    def __init__(self, query: Query, keys: Sequence[Callable]):
        self._query, self._keys = query, list(keys)

    def aggregate(self, f: Callable) -> Query:
        """``f(key..., builder)`` gives a dict of key expressions, aggregations and reports."""
        return self._query._then(lambda r, _: aggregates.aggregate(r, self._keys, f), "GROUP BY AGGREGATE", chain=True)


class Ranking(Aggregation):
    """Functions of a row's place in its partition."""

    @staticmethod
    def row_number() -> Aggregation:
        return Ranking(lambda row, wrap: wrap(F.row_number()))

    @staticmethod
    def rank() -> Aggregation:
        return Ranking(lambda row, wrap: wrap(F.rank()))

    @staticmethod
    def lag(f: Callable) -> Aggregation:
        return Ranking(lambda row, wrap: wrap(F.lag(call(f, row), 1)))

    @staticmethod
    def of(function: Callable[..., Column], *by: Callable) -> Aggregation:
        """A ranking of one's own: any window function of Spark that needs an order (``F.dense_rank``, ``F.ntile`` bound to a
        number, ``F.lead``), applied to projections of the row."""
        return Ranking(lambda row, wrap: wrap(function(*[call(f, row) for f in by])))

    def map(self, f: Callable) -> Aggregation:
        return Ranking(lambda row, wrap: f(self(row, wrap)))


row_number, rank, lag, ranking = Ranking.row_number, Ranking.rank, Ranking.lag, Ranking.of


class Windowing:
    def __init__(self, query: Query, f: Callable[[Builder], dict[str, Any]], partition: tuple[Callable, ...] = (), order: tuple[Callable, ...] = ()):
        self._query, self._f, self._partition, self._order = query, f, partition, order

    def partition_by(self, *keys: Callable) -> Windowing:
        return Windowing(self._query, self._f, keys, self._order)

    def order_by(self, *keys: Callable) -> Windowing:
        return Windowing(self._query, self._f, self._partition, (*self._order, *keys))

    def over(self, partition_by: Callable | Iterable[Callable] = (), order_by: Callable | Iterable[Callable] = ()) -> Query:
        """Aggregates take the whole partition, with or without an order; unordered rankings take all rows as ties.

        Partition and order may be given here as well as by ``partition_by`` and ``order_by``.
        """
        if partition_by or order_by:
            given = [(x,) if callable(x) else tuple(x) for x in (partition_by, order_by)]
            return Windowing(self._query, self._f, given[0] or self._partition, given[1] or self._order).over()
        if not self._partition:
            raise ValueError("a window needs a partition")

        def build(r: Relation, _: Inputs) -> Relation:
            row = r.row
            whole = Window.partitionBy(*[c for k in self._partition for c in columns_of(call(k, row))])
            keys = [c for k in self._order for c in columns_of(call(k, row))]
            ordered = whole.orderBy(*(keys or [F.lit(0)]))
            added = {}
            for name, a in self._f(Builder()).items():
                value = a(row, (lambda c: c.over(ordered)) if isinstance(a, Ranking) else (lambda c: c.over(whole)))
                added[name] = value
            return r.project({**dict(zip(r.shape.fields, row, strict=True)), **added})

        return self._query._then(build, "WINDOW(PARTITION BY ORDER BY)")


def _scan(given: Inputs, df: DataFrame) -> Relation:
    own = relation(df)
    if given.around is None:
        return own
    return Relation(given.around.df.crossJoin(own.df), own.shape, given.around.hidden)


def select(name: str) -> Query:
    """Scan of a named input."""
    return Query(lambda given: _scan(given, given[name]), f"FROM({name})", chain=True)


def values(spark: SparkSession, rows: Any, schema: Any = None) -> Query:
    """Scan of local rows; needs no input."""
    return Query(lambda given: _scan(given, spark.createDataFrame(rows, schema)), "CONST", chain=True)


def of(df: DataFrame) -> Query:
    """Scan of a DataFrame; needs no input."""
    return Query(lambda given: _scan(given, df), "FROM", chain=True)
