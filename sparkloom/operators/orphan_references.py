"""References to records that do not exist, found by a cascade down the foreign-key graph.

Every table says when its records are live (spans of a key), every foreign key which column of a child points
at which table, and at what moment the child was loaded. A reference is a direct orphan if no record of its
key is live at that moment: ``missing`` if the key occurs nowhere, ``later`` if it first appears after that
moment, else ``deleted``. Records with a direct orphan are orphaned, and so are records that refer to orphaned
ones. All come out of one fixpoint: the direct orphans are round 0, and each round after it goes by semi-joins one step down the
graph from the records orphaned last, until a round finds nothing new.

Scale: everything is equi-joins on keys; spans are aggregated or made distinct before they are shuffled, and
where a key has several spans the check is an anti-join, so nothing multiplies. The few orphans that leave a join are put
in another partitioning at once, so that adaptive execution may split hot keys on the child's side; it also broadcasts
parents that turn out small. A round reads, of the children of tables that got new orphans, the id, key and moment only. Each round's new
orphans are written to the shared folder when the query is built, which cuts the lineage; the number of rounds is the depth of the graph.

Defined results: a null key refers to nothing and is no orphan; a child without a moment can't be judged by
time and is an orphan only if its key is ``missing``; a span without a start is live from ever, without an end
for ever; a child without an id of its own is reported once per null id, field and kind; repeated rows count
once; empty parents make every reference ``missing``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import cut


class Keyed(NamedTuple):
    """A table of records: its name, rows, id column and spans.

    ``spans`` has key, live_from, live_to. ``single`` says that there is one span per key.
    """

    name: str
    rows: DataFrame
    id: str
    spans: DataFrame | None = None
    single: bool = False


class Reference(NamedTuple):
    """``child.field`` refers to the id of ``parent`` at the moment ``at`` (an expression over the child's columns)."""

    child: str
    field: str
    parent: str
    at: Column | None = None


def first_to_last(rows: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """One span per key, from the earliest ``since`` of its rows to the ``until`` of its latest row."""
    latest = F.max(F.struct(F.col(since), F.col(until))).getField(until)
    return (
        rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(since).alias("live_from"), latest.alias("live_to"))
    )


def every_span(rows: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """A span per row, equal ones once."""
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(since).alias("live_from"), F.col(until).alias("live_to")).distinct()


def _live(at: Column) -> Column:
    started = F.col("live_from").isNull() | (F.col("live_from") <= at)
    return started & (F.col("live_to").isNull() | (at < F.col("live_to")))


def direct_orphans(graph: dict[str, Keyed], ref: Reference) -> DataFrame:
    """Orphan references of one foreign key: id, at, kind; equal ones once."""
    child, parent = graph[ref.child], graph[ref.parent]
    moment = F.lit(None).cast("timestamp_ntz") if ref.at is None else ref.at.cast("timestamp_ntz")
    uses = child.rows.select(F.col(child.id).alias("id"), F.col(ref.field).alias("_key"), moment.alias("at")).where(F.col("_key").isNotNull())
    spans = (parent.spans if parent.spans is not None else _always(parent)).select(
        "key", F.col("live_from").cast("timestamp_ntz").alias("live_from"), F.col("live_to").cast("timestamp_ntz").alias("live_to"), F.lit(True).alias("_there")
    )
    at = F.col("at")
    unjudged = at.isNull() & F.col("_there").isNotNull()
    kind = F.when(F.col("_there").isNull(), "missing").when(at < F.col("live_from"), "later").otherwise("deleted")
    if parent.single or parent.spans is None:
        joined = uses.join(spans, F.col("_key") == F.col("key"), "left").where(~unjudged & (F.col("_there").isNull() | ~_live(at)))
    else:
        dead = _apart(uses.join(spans, (F.col("_key") == F.col("key")) & _live(at), "left_anti"), "id", "_key", "at")
        first = spans.groupBy("key").agg(F.min(F.coalesce("live_from", F.lit("0001-01-01").cast("timestamp_ntz"))).alias("live_from"), F.first("_there").alias("_there"))
        joined = dead.join(first, F.col("_key") == F.col("key"), "left").where(~unjudged)
    return _apart(joined.select("id", F.col("_key").cast("string").alias("key_value"), "at", kind.alias("kind")), "id", "key_value", "at").distinct()


def _apart(orphans: DataFrame, *by: str) -> DataFrame:
    """In a partitioning of their own, so that the join they come from needn't keep one and can be split where a key is hot."""
    return orphans.repartition(*by)


def _always(parent: Keyed) -> DataFrame:
    none = F.lit(None).cast("timestamp_ntz")
    return parent.rows.where(F.col(parent.id).isNotNull()).select(F.col(parent.id).alias("key"), none.alias("live_from"), none.alias("live_to")).distinct()


_ORPHAN = ("table_name", "id", "field_name", "key_value", "at", "kind", "inherited", "round")
_REFERENCE = ("table_name", "id", "field_name", "key_value")


def _labelled(ref: Reference, rows: DataFrame, inherited: bool, k: int) -> DataFrame:
    """id, key_value, at, kind of a foreign key's orphans as rows of the cascade."""
    return rows.withColumns(
        {"table_name": F.lit(ref.child), "id": F.col("id").cast("string"), "field_name": F.lit(ref.field), "inherited": F.lit(inherited), "round": F.lit(k)}
    ).select(*_ORPHAN)


def inherited_orphans(graph: dict[str, Keyed], ref: Reference, orphaned: DataFrame) -> DataFrame:
    """References of one foreign key to records in ``orphaned`` (table_name, id): id, key_value, at, kind; equal ones once."""
    child = graph[ref.child]
    moment = F.lit(None).cast("timestamp_ntz") if ref.at is None else ref.at.cast("timestamp_ntz")
    uses = child.rows.select(F.col(child.id).alias("id"), F.col(ref.field).cast("string").alias("key_value"), moment.alias("at"), F.lit("orphaned").alias("kind"))
    gone = orphaned.where(F.col("table_name") == ref.parent).select(F.col("id").alias("_gone")).distinct()
    return _apart(uses.join(gone, F.col("key_value") == F.col("_gone"), "left_semi"), "id", "key_value", "at").distinct()


def orphan_cascade(tables: Sequence[Keyed], references: Sequence[Reference]) -> DataFrame:
    """All orphan references: table_name, id (as string), field_name, key_value, at, kind, inherited, round.

    ``inherited`` rows refer to a record that exists but is itself orphaned, found in ``round`` 1 and on; a
    reference that is a direct orphan (round 0) is not reported again as inherited.
    """
    graph = {t.name: t for t in tables}
    if not references:
        raise ValueError("no reference is given")
    found = frontier = cut(_union(_labelled(ref, direct_orphans(graph, ref), False, 0) for ref in references))
    k = 0
    while True:
        k += 1
        touched = {r.table_name for r in frontier.select("table_name").distinct().collect()}  # at most the names of the graph
        below = [ref for ref in references if ref.parent in touched]
        if not below:
            return found
        new = _union(_labelled(ref, inherited_orphans(graph, ref, frontier), True, k) for ref in below)
        known = found.select(*[F.col(c).alias(f"_{c}") for c in _REFERENCE])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _REFERENCE]
        frontier = cut(new.join(known, same[0] & same[1] & same[2] & same[3], "left_anti"))
        found = found.unionByName(frontier)


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def orphan_report(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Counts of orphan references and of the records that hold them per table, period, field, kind and inheritance."""
    return orphans.groupBy(
        "table_name", F.date_trunc(period, F.col("at")).cast("date").alias("period"), "field_name", "kind", "inherited"
    ).agg(F.count(F.lit(1)).alias("orphan_references"), F.countDistinct("id").alias("orphan_records"))
