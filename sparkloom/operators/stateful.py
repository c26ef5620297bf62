"""Folds with Python state over ordered rows.

Rows of a key are brought together and sorted by Spark, then stream through the state function batch by batch:
the state lives on between batches, the group is never held in memory. Without a key all rows stream through
one task; a fold that can merge states runs in all partitions first.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from sparkloom.operators.rows import Relation, Row


def _records(frame: pd.DataFrame) -> list[dict[str, Any]]:
    return frame.astype(object).where(frame.notna(), None).to_dict("records") if len(frame) else []


def _frame(rows: list[dict[str, Any]], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


def _named(r: Relation) -> list[Column]:
    return [(v.struct() if isinstance(v, Row) else v).alias(n) for n, v in zip(r.shape.fields, r.row, strict=True)]


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # noqa: SLF001


def run_ordered(_: DataFrame, r: Relation, keys: list[Column], order: list[Column], zero: Callable, step: Callable, schema: str) -> DataFrame:
    """Stream rows in order through ``step``; each key has its own state."""
    names = list(r.shape.fields)
    k = [f"_k{i}" for i in range(len(keys))]
    df = r.df.withColumns(dict(zip(k, keys, strict=True)))
    df = (df.repartition(*k) if k else df.repartition(1)).sortWithinPartitions(*k, *order).select(*k, *_named(r))
    out_names = _schema(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for batch in batches:
            out: list[dict[str, Any]] = []
            for row in _records(batch):
                key = tuple(row.pop(c) for c in k)
                if key != current:
                    current, state = key, zero()
                state, made = step(state, {n: row[n] for n in names})
                out += made
            yield _frame(out, out_names)

    return df.mapInPandas(run, schema)


def fold_all(_: DataFrame, r: Relation, order: list[Column], zero: Callable, step: Callable, results: Callable, schema: str, merge: Callable | None) -> DataFrame:
    """Fold all rows into one state and emit ``results(state)``; an empty input emits the results of ``zero()``."""
    df = r.df
    if merge is None:
        df = df.repartition(1).sortWithinPartitions(*order) if order else df.repartition(1)
    df = df.select(*_named(r))
    names, out_names = list(r.shape.fields), _schema(schema).names

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = zero()
        for batch in batches:
            for row in _records(batch):
                state = step(state, {n: row[n] for n in names})
        yield pd.DataFrame({"state": [pickle.dumps(state)]})

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, first = None, True
        for batch in batches:
            for blob in batch["state"]:
                other = pickle.loads(blob)
                state, first = (other if first else merge(state, other)), False
        yield _frame(list(results(zero() if first else state)), out_names)

    return df.mapInPandas(fold, "state binary").repartition(1).mapInPandas(finish, schema)
