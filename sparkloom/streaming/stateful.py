"""Stateful maps on streams: the same step functions as on tables, with the state kept between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stateful_map_concat(stream: DataFrame, key: str, order: str, zero: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, list[dict]]], schema: str) -> DataFrame:
    """Per key a running state: ``step(state, row) -> (state, rows out)``. Rows of a micro-batch are taken in order of
    ``order``; rows that arrive in a later batch come later, whatever their order."""
    names = [part.split()[0].strip("`") for part in schema.split(",")]

    def run(_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = pickle.loads(held.get[0]) if held.exists else zero()
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        out: list[dict] = []
        for row in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            state, made = step(state, row)
            out += made
        held.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)
