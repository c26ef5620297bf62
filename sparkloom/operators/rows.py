"""Rows as lambdas see them, and the relations behind them.

A relation is a DataFrame of flat columns with made-up names and a shape that says how they form records. A
join keeps both sides' columns flat, so Catalyst sees plain attributes (equi keys, pruning, push-down) while
lambdas see a pair of records. Structs are only built when a result is handed out.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_fresh = itertools.count()


def fresh() -> str:
    return f"_v{next(_fresh)}"


@dataclass(frozen=True)
class Shape:
    """A record: names to column names or to records. ``marker`` is a column that is null where there is no record."""

    fields: dict[str, str | Shape]
    marker: str | None = None

    def columns(self) -> Iterator[str]:
        for f in self.fields.values():
            if isinstance(f, Shape):
                yield from f.columns()
            else:
                yield f
        if self.marker:
            yield self.marker


class Row:
    """A record of Columns; ``row.name`` or ``row["name"]``. As ``outer`` it is seen from inside a correlated query."""

    def __init__(self, shape: Shape, outer: bool = False):
        self._shape, self._outer = shape, outer

    def _column(self, name: str) -> Column:
        c = F.col(name)
        return c.outer() if self._outer else c

    def __getitem__(self, name: str) -> Any:
        try:
            f = self._shape.fields[name]
        except KeyError:
            raise AttributeError(f"no field {name!r}; there are {list(self._shape.fields)}") from None
        return Row(f, self._outer) if isinstance(f, Shape) else self._column(f)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__") or name in ("_shape", "_outer", "_values"):
            raise AttributeError(name)
        return self[name]

    def __iter__(self) -> Iterator[Any]:
        return (self[n] for n in self._shape.fields)

    def _items(self) -> dict[str, Any]:
        return dict(zip(self._shape.fields, self, strict=True))

    def _marker(self) -> Column | None:
        return self._column(self._shape.marker) if self._shape.marker else None

    def is_defined(self) -> Column:
        """Whether there is a record (the right side of a left join)."""
        marker = self._marker()
        return F.lit(True) if marker is None else marker.isNotNull()

    def struct(self) -> Column:
        """The record as one struct column; null where there is none."""
        made = F.struct(*[(v.struct() if isinstance(v, Row) else v).alias(n) for n, v in self._items().items()])
        return made if self._marker() is None else F.when(self.is_defined(), made)


class Given(Row):
    """A record of ready Columns."""

    def __init__(self, values: dict[str, Any]):
        self._values = values

    def __getitem__(self, name: str) -> Any:
        if name not in self._values:
            raise AttributeError(f"no field {name!r}; there are {list(self._values)}")
        return self._values[name]

    def __iter__(self) -> Iterator[Any]:
        return iter(self._values.values())

    def _items(self) -> dict[str, Any]:
        return self._values

    def _marker(self) -> Column | None:
        return None


@dataclass(frozen=True)
class Relation:
    """``hidden`` are columns of an enclosing row that go along while a dependent query is built on it."""

    df: DataFrame
    shape: Shape
    hidden: tuple[str, ...] = ()

    def over(self, df: DataFrame) -> Relation:
        """The same records in another DataFrame."""
        return Relation(df, self.shape, self.hidden)

    def project(self, value: Any, df: DataFrame | None = None) -> Relation:
        """What a lambda gives back, as records."""
        made = project(self.df if df is None else df, value, self.hidden)
        return Relation(made.df, made.shape, self.hidden)

    @property
    def row(self) -> Row:
        return Row(self.shape)

    def to_df(self) -> DataFrame:
        """The relation with its own names, records as structs."""
        return self.df.select(*[(v.struct() if isinstance(v, Row) else v).alias(n) for n, v in zip(self.shape.fields, self.row, strict=True)])


def relation(df: DataFrame) -> Relation:
    """A DataFrame as relation; each use has columns of its own, so self-joins are never ambiguous."""
    names = {c: fresh() for c in df.columns}
    if len(names) < len(df.columns):
        raise ValueError("column names must be unique")
    return Relation(df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), Shape(names))


def call(f: Callable, row: Row) -> Any:
    """Apply a lambda to a row; one with several parameters gets the record's fields (a pair's sides)."""
    n = f.__code__.co_argcount - len(f.__defaults__ or ()) if hasattr(f, "__code__") else 1
    return f(row) if n <= 1 else f(*row)


def named(value: Any) -> dict[str, Any]:
    """What a lambda gives back as names to Columns or Rows: a dict, a Row, a tuple, or one Column (``value``)."""
    if isinstance(value, dict):
        return value
    if isinstance(value, Row):
        return value._items()
    if isinstance(value, (tuple, list)):
        return {f"_{i + 1}": v for i, v in enumerate(value)}
    return {"value": value}


def project(df: DataFrame, value: Any, keep: tuple[str, ...] = ()) -> Relation:
    """A new relation of what a lambda gives back; ``keep`` are columns that go along unseen."""
    columns: list[Column] = [F.col(c) for c in keep]

    def shaped(v: Any) -> str | Shape:
        if isinstance(v, Row):
            marker = None
            if v._marker() is not None:
                marker = fresh()
                columns.append(v._marker().alias(marker))
            return Shape({n: shaped(x) for n, x in v._items().items()}, marker)
        if isinstance(v, (dict, tuple)):
            return Shape({n: shaped(x) for n, x in named(v).items()})
        name = fresh()
        columns.append((v if isinstance(v, Column) else F.lit(v)).alias(name))
        return name

    shape = Shape({n: shaped(v) for n, v in named(value).items()})
    return Relation(df.select(*columns), shape)


def columns_of(value: Any) -> list[Column]:
    """All leaf Columns of what a lambda gives back."""
    if isinstance(value, Row):
        return [c for v in value for c in columns_of(v)] + ([] if value._marker() is None else [value.is_defined()])
    if isinstance(value, dict):
        return [c for v in value.values() for c in columns_of(v)]
    if isinstance(value, (tuple, list)):
        return [c for v in value for c in columns_of(v)]
    return [value if isinstance(value, Column) else F.lit(value)]
