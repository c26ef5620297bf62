"""Results: what a query is run for. They compose with ``map`` and ``flat_map`` before anything runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, Generic, TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import explore
from sparkloom.operators.query import Inputs, Query
from sparkloom.operators.rows import Relation, Row, call, columns_of

A, B, S, R = TypeVar("A"), TypeVar("B"), TypeVar("S"), TypeVar("R")


class Result(Generic[A]):
    """A description of an action; ``run`` executes it."""

    def __init__(self, action: Callable[[Inputs], A]):
        self._action = action

    def run(self, given: Inputs | None = None) -> A:
        return self._action(given or Inputs({}))

    def map(self, f: Callable[[A], B]) -> Result[B]:
        return Result(lambda given: f(self._action(given)))

    def flat_map(self, f: Callable[[A], Result[B]]) -> Result[B]:
        return Result(lambda given: f(self._action(given)).run(given))


def const(value: A) -> Result[A]:
    return Result(lambda _: value)


def to(query: Query, collection: Callable[[Iterable[Any]], A]) -> Result[A]:
    """All rows in a collection of the caller's choice."""
    return Result(lambda given: collection(query.to_df(given).collect()))


def to_list(query: Query) -> Result[list]:
    return to(query, list)


def distinct(query: Query) -> Result[list]:
    """Distinct rows."""
    return Result(lambda given: query.to_df(given).distinct().collect())


def to_map(query: Query, order: Callable | None = None) -> Result[dict]:
    """Rows of two fields as a dict; of equal keys the last in ``order`` wins, decided before anything is collected."""

    def action(given: Inputs) -> dict:
        r = query.relation(given)
        key, value = r.row
        by = columns_of(call(order, r.row)) if order else [F.lit(0)]
        k, v = columns_of(key)[0], (value.struct() if isinstance(value, Row) else value)
        got = r.df.groupBy(k.alias("k")).agg(F.max_by(F.struct(v.alias("v")), F.struct(*by)).alias("v"))
        return {row.k: row.v.v for row in got.collect()}

    return Result(action)


def to_map_by(query: Query, key: Callable, order: Callable | None = None) -> Result[dict]:
    """Rows by a key; of equal keys the last in ``order`` wins."""
    return to_map(query.map(lambda r: {"k": call(key, r), "v": r}), (lambda p: call(order, p.v)) if order else None)


def find(query: Query, p: Callable, order: Callable | None = None) -> Result[Any]:
    """The first row, in ``order``, for which ``p`` holds; None if there is none."""

    def action(given: Inputs) -> Any:
        r = query.relation(given)
        hit = Relation(r.df.filter(call(p, r.row)), r.shape)
        df = hit.df.orderBy(*columns_of(call(order, r.row))) if order else hit.df
        got = Relation(df.limit(1), r.shape).to_df().collect()
        return got[0] if got else None

    return Result(action)


def exists(query: Query, p: Callable = lambda r: F.lit(True)) -> Result[bool]:
    """Whether any row satisfies ``p``."""

    def action(given: Inputs) -> bool:
        r = query.relation(given)
        return not r.df.filter(call(p, r.row)).isEmpty()

    return Result(action)


def show(query: Query, rows: int = 20, truncate: bool | int = True, out: Callable[[str], Any] = print) -> Result[None]:
    return Result(lambda given: explore.show(query.to_df(given), rows, truncate, out))


class SideEffect(Generic[R, S]):
    """A sink with a resource and a state: ``acquire`` before the first row, ``use(resource, state, row) -> state``
    per row, ``release`` at the end.

    ``after_all`` hooks run after the last row unless a row failed; ``release`` and ``on_exit`` always run. Rows
    come to the driver one partition at a time, so a sink never holds more than that.
    """

    def __init__(self, zero: S, acquire: Callable[[], R], release: Callable[[R, S], Any], use: Callable[[R, S, Any], S]):
        self._zero, self._acquire, self._release, self._use = zero, acquire, release, use
        self._before: list[Callable[[R, S], S]] = []
        self._after: list[Callable[[R, S], S]] = []
        self._exit: list[Callable[[], Any]] = []

    @staticmethod
    def resourceless(zero: S, use: Callable[[S, Any], S]) -> SideEffect[None, S]:
        return SideEffect(zero, lambda: None, lambda r, s: None, lambda r, s, row: use(s, row))

    @staticmethod
    def stateless(acquire: Callable[[], R], release: Callable[[R], Any], use: Callable[[R, Any], Any]) -> SideEffect[R, None]:
        return SideEffect(None, acquire, lambda r, s: release(r), lambda r, s, row: use(r, row) and None)

    def before_all(self, f: Callable[[R, S], S]) -> SideEffect[R, S]:
        self._before.append(f)
        return self

    def after_all(self, f: Callable[[R, S], S]) -> SideEffect[R, S]:
        self._after.append(f)
        return self

    def on_exit(self, f: Callable[[], Any]) -> SideEffect[R, S]:
        self._exit.append(f)
        return self

    def feed(self, rows: Iterator[Any]) -> S:
        resource = self._acquire()
        state = self._zero
        try:
            for f in self._before:
                state = f(resource, state)
            for row in rows:
                state = self._use(resource, state, row)
            for f in self._after:
                state = f(resource, state)
            return state
        finally:
            try:
                self._release(resource, state)
            finally:
                for f in self._exit:
                    f()


def foreach(query: Query, sink: Callable[[], SideEffect] | Callable[[Any], Any]) -> Result[Any]:
    """Feed all rows to a sink made anew for each run, or call a plain function per row."""

    def action(given: Inputs) -> Any:
        rows = query.to_df(given).toLocalIterator(prefetchPartitions=True)
        made = sink() if getattr(sink, "__code__", None) is None or sink.__code__.co_argcount == 0 else None
        if isinstance(made, SideEffect):
            return made.feed(rows)
        for row in rows:
            sink(row)
        return None

    return Result(action)


def save(query: Query, write: Callable[[DataFrame], Any]) -> Result[Any]:
    """Hand the result to a distributed writer, such as ``sources.csv.write``."""
    return Result(lambda given: write(query.to_df(given)))
