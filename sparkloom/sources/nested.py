"""Nested records as rows of a table: a list starts a new row for each of its elements."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import types as T


def headers(schema: T.StructType) -> list[str]:
    """Leaf names in order, records and lists of records opened; equal names are refused."""
    out: list[str] = []

    def walk(kind: T.StructType) -> None:
        for f in kind.fields:
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if isinstance(inner, T.StructType):
                walk(inner)
            else:
                out.append(f.name)

    walk(schema)
    if len(set(out)) < len(out):
        raise ValueError(f"equal leaf names: {sorted({n for n in out if out.count(n) > 1})}")
    return out


def table_rows(value: Any, schema: T.StructType) -> Iterator[dict[str, Any]]:
    """The rows of one record: its scalars on one row, each element of a list on rows of its own below."""
    rows: list[dict[str, Any]] = [{}]

    def walk(record: Any, kind: T.StructType) -> None:
        for f in kind.fields:
            v = None if record is None else record[f.name]
            if isinstance(f.dataType, T.StructType):
                walk(v, f.dataType)
            elif isinstance(f.dataType, T.ArrayType):
                for element in v or []:
                    rows.append({})
                    if isinstance(f.dataType.elementType, T.StructType):
                        walk(element, f.dataType.elementType)
                    else:
                        rows[-1][f.name] = element
            else:
                rows[-1][f.name] = v

    walk(value, schema)
    yield from rows
