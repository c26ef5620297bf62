"""Record schemas from dataclasses, and strict decoding of text cells into them.

Every column is read as text and cast field by field. All errors of a record are gathered in one array; strict
reading raises them with the record's paths, lenient reading keeps them in a column beside the loaded rows.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
import enum
import types
import typing
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.naming import Naming, literal

# Python types and the Spark types that hold them.
SCALARS: dict[Any, T.DataType] = {
    str: T.StringType(),
    bool: T.BooleanType(),
    int: T.LongType(),
    float: T.DoubleType(),
    decimal.Decimal: T.DecimalType(38, 18),
    uuid.UUID: T.StringType(),
    dt.date: T.DateType(),
    dt.datetime: T.TimestampNTZType(),
}
_UUID = r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"

#: A parser for one type or field: the text Column and the path give the value and an error text (null if none).
Parser = Callable[[Column], Column]


@dataclasses.dataclass(frozen=True)
class Leaf:
    name: str
    path: str
    kind: Any
    optional: bool
    spark: T.DataType


@dataclasses.dataclass(frozen=True)
class Record:
    name: str
    path: str
    optional: bool
    fields: tuple[Leaf | Record, ...]

    def leaves(self) -> list[Leaf]:
        return [x for f in self.fields for x in ([f] if isinstance(f, Leaf) else f.leaves())]


def record(cls: Any, name: str = "", path: str = "", optional: bool = False) -> Record:
    """The schema of a dataclass; Optional fields are nullable, nested dataclasses are structs, Enums are checked strings."""
    hints = typing.get_type_hints(cls)
    fields: list[Leaf | Record] = []
    for f in dataclasses.fields(cls):
        kind, missing = hints[f.name], False
        if typing.get_origin(kind) in (typing.Union, types.UnionType):
            inner = [a for a in typing.get_args(kind) if a is not type(None)]
            kind, missing = inner[0], len(inner) < len(typing.get_args(kind))
        at = f"{path}.{f.name}" if path else f.name
        if dataclasses.is_dataclass(kind):
            fields.append(record(kind, f.name, at, missing))
        else:
            spark = T.StringType() if isinstance(kind, type) and issubclass(kind, enum.Enum) else SCALARS.get(kind)
            if spark is None:
                raise TypeError(f"{at}: no column type for {kind}")
            fields.append(Leaf(f.name, at, kind, missing, spark))
    return Record(name, path, optional, tuple(fields))


def spark_schema(cls: Any) -> T.StructType:
    """The Spark schema of a dataclass, lists included (for JSON)."""

    def kind(k: Any) -> T.DataType:
        origin, args = typing.get_origin(k), typing.get_args(k)
        if origin in (typing.Union, types.UnionType):
            return kind(next(a for a in args if a is not type(None)))
        if origin in (list, tuple, set):
            return T.ArrayType(kind(args[0]))
        if origin is dict:
            return T.MapType(kind(args[0]), kind(args[1]))
        if dataclasses.is_dataclass(k):
            return spark_schema(k)
        return T.StringType() if isinstance(k, type) and issubclass(k, enum.Enum) else SCALARS[k]

    hints = typing.get_type_hints(cls)
    return T.StructType([T.StructField(f.name, kind(hints[f.name])) for f in dataclasses.fields(cls)])


def _parsed(text: Column, leaf: Leaf, parsers: dict[Any, Parser]) -> tuple[Column, Column, bool]:
    """(value, whether it can't be read, False), or (value, why it can't be read as text, True)."""
    if leaf.path in parsers or leaf.kind in parsers:
        value = (parsers.get(leaf.path) or parsers[leaf.kind])(text)
        return (*value, True) if isinstance(value, tuple) else (value, value.isNull(), False)
    if leaf.kind is uuid.UUID:
        return F.lower(text), ~text.rlike(_UUID), False
    if isinstance(leaf.kind, type) and issubclass(leaf.kind, enum.Enum):
        return text, ~text.isin(*leaf.kind.__members__), False
    if leaf.kind is str:
        return text, F.lit(False), False
    value = F.trim(text).try_cast(leaf.spark)
    return value, value.isNull(), False


def decode(rows: DataFrame, schema: Record, cell: Callable[[Leaf], Column | None], parsers: dict[Any, Parser] | None = None, strict: bool = True, errors: str = "errors") -> DataFrame:
    """Rows of text cells as typed records.

    ``cell`` gives a field's text, or None where there is no such column. An empty cell is an empty string for a
    string field and missing for any other; a missing optional field, or an optional record whose fields are all
    missing, is null; anything else missing or unreadable is an error.
    """
    problems: list[Column] = []

    def value_of(node: Leaf | Record, excused: Column) -> tuple[Column, Column]:
        """(value, whether it is missing); errors are noted unless the enclosing optional record is missing."""
        if isinstance(node, Record):
            missing = F.lit(True)
            for leaf in node.leaves():
                missing = missing & _absent(leaf)
            own = excused | missing if node.optional else excused
            made = F.struct(*[value_of(f, own)[0].alias(f.name) for f in node.fields])
            return (F.when(~missing, made) if node.optional else made), missing
        text = cell(node)
        absent = _absent(node)
        if text is None:
            problems.append(F.when(~excused & ~F.lit(node.optional), F.lit(f"{node.path}: field not found")))
            return F.lit(None).cast(node.spark), F.lit(True)
        raw = F.coalesce(text, F.lit("")) if node.kind is str and not node.optional else text
        value, bad, told = _parsed(raw, node, parsers or {})
        if node.kind is not str and not node.optional:
            problems.append(F.when(~excused & absent, F.lit(f"{node.path}: field not found")))
        why = bad if told else F.when(bad, F.concat(F.lit("can't read "), F.coalesce(raw, F.lit(""))))
        problems.append(F.when(~excused & ~absent & why.isNotNull(), F.concat(F.lit(f"{node.path}: "), why)))
        return (value if node.kind is str and not node.optional else F.when(~absent, value)), absent

    def _absent(leaf: Leaf) -> Column:
        text = cell(leaf)
        return F.lit(True) if text is None else text.isNull() | (F.trim(text) == "")

    columns = [value_of(f, F.lit(False))[0].alias(f.name) for f in schema.fields]
    noted = F.filter(F.array(*problems), lambda e: e.isNotNull()) if problems else F.array().cast("array<string>")
    out = rows.select(*columns, noted.alias(errors))
    if not strict:
        return out
    failed = F.raise_error(F.concat(F.lit("record can't be decoded: "), F.array_join(errors, "; "))).cast("boolean")
    return out.where(F.when(F.size(errors) > 0, failed).otherwise(F.lit(True))).drop(errors)


def flat_columns(df: DataFrame, naming: Naming = literal) -> list[Column]:
    """Scalar columns of a table, nested records opened to their leaf names; equal names are refused."""
    out: list[tuple[str, Column]] = []

    def walk(kind: T.StructType, prefix: str) -> None:
        for f in kind.fields:
            path = f"{prefix}`{f.name}`"
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, f"{path}.")
            else:
                out.append((naming(f.name), F.col(path)))

    walk(df.schema, "")
    names = [n for n, _ in out]
    if len(set(names)) < len(names):
        raise ValueError(f"equal leaf names: {sorted({n for n in names if names.count(n) > 1})}")
    return [c.alias(n) for n, c in out]
