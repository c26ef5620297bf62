"""JSON: one document per line, or one array; reading against a dataclass, distributed and single-file writing."""

from __future__ import annotations

import json as text_json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources import files
from sparkloom.sources.csv import _to
from sparkloom.sources.records import spark_schema


def read(spark: SparkSession, cls: Any, paths: str | Sequence[str], lines: bool = True, strict: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Files of one document per line (``lines``) or of one array each. Strict reading fails on a document that
    doesn't fit; otherwise its row is null."""
    reader = spark.read.schema(spark_schema(cls)).option("multiLine", not lines).option("encoding", encoding)
    return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").json(files.as_list(paths))


def read_directory(spark: SparkSession, cls: Any, root: str, pattern: str = "*", lines: bool = True, max_depth: int = 20) -> DataFrame:
    return read(spark, cls, files.directory(spark, root, pattern, max_depth), lines)


def read_url(spark: SparkSession, cls: Any, url: str, lines: bool = True) -> DataFrame:
    return read(spark, cls, files.fetched(spark, url), lines)


def read_string(spark: SparkSession, cls: Any, content: str, lines: bool = True) -> DataFrame:
    return read(spark, cls, files.written(spark, content), lines)


def write(df: DataFrame, path: str, terminator: str = "\r\n", mode: str = "error") -> None:
    """A directory of files with a compact document per line, missing values as null."""
    df.write.mode(mode).option("lineSep", terminator).option("ignoreNullFields", False).json(path)


def write_file(df: DataFrame, target: Any, lines: bool = True, terminator: str = "\r\n", encoding: str = "UTF-8") -> None:
    """One file (or an open text stream): a document per line, or one indented array."""
    documents = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("d"))

    def feed(out: Any) -> None:
        first = True
        if not lines:
            out.write("[")
        for row in documents.toLocalIterator(prefetchPartitions=True):
            if lines:
                out.write(row.d + terminator)
                continue
            pretty = text_json.dumps(text_json.loads(row.d), indent=3, separators=(",", " : "), ensure_ascii=False)
            out.write(("" if first else ",") + terminator + pretty)
            first = False
        if not lines:
            out.write(("" if first else terminator) + "]")

    _to(target, feed, encoding)
