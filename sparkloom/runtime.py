"""Session helpers: tables, durable cuts of lineage."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table of the data directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the executors live in this process (a local test session) a folder of this
    process is made and used; on a cluster without the setting this is an error.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        if re.fullmatch(r"local(\[[^\]]*\])?", sc.master) is None:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="sparkloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def shared_path(spark: SparkSession, kind: str, table: str | None = None) -> str:
    """A new path in the shared folder, deleted by ``drop_cuts`` together with the table that is kept there."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    getattr(_within, "kept", _written).append((path, table))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and go on from those files.

    The written files survive the loss of executors and hold their row counts, so later joins are
    planned on true sizes.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files a plan reads; sources whose size Spark doesn't know count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()  # noqa: SLF001
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


_written: list[tuple[str, str | None]] = []
_within = threading.local()


def drop_cuts(spark: SparkSession) -> None:
    """Delete what this process has written to the shared folder, once no DataFrame built on it is needed any more."""
    _drop(spark, _written)


@contextmanager
def passing_cuts(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what this thread has written to the shared folder meanwhile, as a micro-batch of an endless stream must."""
    outer, _within.kept = getattr(_within, "kept", None), []
    try:
        yield
    finally:
        _drop(spark, _within.kept)
        if outer is None:
            del _within.kept
        else:
            _within.kept = outer


def _drop(spark: SparkSession, kept: list[tuple[str, str | None]]) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
    while kept:
        path, name = kept.pop()
        if name:
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        at = hadoop(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001
