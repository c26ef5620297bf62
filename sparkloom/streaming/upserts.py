"""Wide cells from a stream: every micro-batch becomes a sorted run of sparse deltas, runs are compacted now and then.

A run is written under its batch number, so a batch that is repeated after a failure replaces its own run; and as
merging is idempotent, one that is repeated after it was compacted changes nothing. ``compact_runs`` writes all runs as a new
base, then switches to it by renaming one small file, the manifest, into place, and only then deletes what was
merged. Whatever moment it dies at, readers see each run either by itself or in the base, and the next
compaction clears the remains away. Compaction must not run while another compaction does; new batches may
arrive meanwhile. A reader whose plan was made before a switch may have to be made again after it.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.wide_cells import as_run, cells_of, compact, deltas, sorted_run
from sparkloom.runtime import passing_cuts


def write_deltas(stream: DataFrame, attributes: DataFrame, path: str, checkpoint: str, **trigger: Any):
    """Start the query that turns a stream of attribute-value rows into runs below ``path``."""

    def batch(rows: DataFrame, number: int) -> None:
        at = F.lit(number).cast("bigint")
        with passing_cuts(rows.sparkSession):
            sorted_run(deltas(cells_of(rows, attributes, at))).write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class _Store:
    """The folder of a table: runs ``run=N``, bases ``base=K`` and manifests ``_manifest-K``, which name the runs in the base."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark._jvm  # noqa: SLF001
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(""))) if self.fs.exists(self.at("")) else []

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Appears at once with its whole content."""
        fresh = f"_fresh-{name.lstrip('_')}"
        stream = self.fs.create(self.at(fresh), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.rename(self.at(fresh), self.at(name)):
            raise OSError(f"{self.path}/{name} can't be put in place")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def state(self) -> tuple[int, list[str], list[str]]:
        """The number of the current base (0: none), the folders that count, and what is left over."""
        names = self.names()
        bases = sorted(int(n.removeprefix("_manifest-")) for n in names if n.startswith("_manifest-"))
        current = bases[-1] if bases else 0
        merged = set(json.loads(self.read_text(f"_manifest-{current}"))) if current else set()
        live = [n for n in names if n == f"base={current}" or (n.startswith("run=") and n not in merged)]
        old = [n for n in names if n not in live and n != f"_manifest-{current}" and n.startswith(("run=", "base=", "_manifest-", "_fresh-"))]
        return current, live, old

    def read(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/{n}" for n in folders]) if folders else None


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The deltas of all runs below ``path``, those in the base included."""
    store = _Store(spark, path)
    runs = store.read(store.state()[1])
    if runs is None:
        raise FileNotFoundError(f"no runs below {path}")
    return runs


def read_compacted(spark: SparkSession, path: str) -> DataFrame:
    """The current cells."""
    return compact(read_runs(spark, path))


def compact_runs(spark: SparkSession, path: str) -> None:
    """Merge all runs that are there now into a new base and drop them."""
    store = _Store(spark, path)
    current, live, old = store.state()
    for name in old:
        store.delete(name)
    runs = store.read(live)
    if runs is None:
        return
    fresh = current + 1
    merged = as_run(compact(runs), F.lit(-fresh).cast("bigint"))
    sorted_run(merged).write.mode("overwrite").parquet(f"{store.path}/base={fresh}")
    store.write_text(f"_manifest-{fresh}", json.dumps(live))
    for name in store.state()[2]:
        store.delete(name)
