"""CSV: header-named strict reading, distributed and single-file writing."""

from __future__ import annotations

import csv as text_csv
import dataclasses
import io
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.naming import Naming, literal
from sparkloom.sources import files
from sparkloom.sources.records import Leaf, Parser, decode, flat_columns, record

QUOTE_ALL, QUOTE_MINIMAL, QUOTE_NONE, QUOTE_NON_NUMERIC = "all", "minimal", "none", "non_numeric"


@dataclasses.dataclass(frozen=True)
class Options:
    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'
    terminator: str = "\r\n"
    quoting: str = QUOTE_MINIMAL
    naming: Naming = literal
    case_sensitive: bool = False
    header: bool = True
    encoding: str = "UTF-8"


DEFAULT = Options()
TSV = Options(delimiter="\t", escape="\\", quoting=QUOTE_NONE)


@dataclasses.dataclass(frozen=True)
class Reader:
    """An immutable reader of a dataclass; ``option`` gives changed copies, the last call reads lazily.

    Columns are found by the header's names, trimmed and, unless ``case_sensitive``, in lower case; nested fields by
    their own name. Empty lines are skipped. Files with other column orders may be read together.
    """

    spark: SparkSession
    cls: Any
    options: Options = DEFAULT
    parsers: dict[Any, Parser] = dataclasses.field(default_factory=dict)
    strict: bool = True

    def option(self, **changed: Any) -> Reader:
        return dataclasses.replace(self, options=dataclasses.replace(self.options, **changed))

    def parser(self, field_or_type: Any, parse: Parser) -> Reader:
        """A decoder of one's own for a field (by path) or a type: a text Column to a value Column, null if unreadable,
        or to a pair of the value and the text of its error, null if there is none."""
        return dataclasses.replace(self, parsers={**self.parsers, field_or_type: parse})

    def lenient(self) -> Reader:
        """Keep the errors of each record in a column ``errors`` instead of failing."""
        return dataclasses.replace(self, strict=False)

    def _one(self, path: str | list[str]) -> DataFrame:
        """One scan of files with the same header."""
        o = self.options
        raw = (
            self.spark.read.option("header", True)
            .option("sep", o.delimiter)
            .option("quote", "" if o.quoting == QUOTE_NONE else o.quote)
            .option("escape", o.escape)
            .option("encoding", o.encoding)
            .option("multiLine", o.quoting != QUOTE_NONE)
            .option("mode", "PERMISSIVE")
            .csv(path)
        )
        tidy = (lambda s: s.strip()) if o.case_sensitive else (lambda s: s.strip().lower())
        known = {tidy(c): c for c in raw.columns}

        def cell(leaf: Leaf) -> Column | None:
            found = known.get(tidy(o.naming(leaf.name)))
            return None if found is None else F.col(f"`{found}`")

        return decode(raw, record(self.cls), cell, self.parsers, self.strict)

    def file(self, path: str) -> DataFrame:
        return self._one(path)

    def files(self, paths: Sequence[str]) -> DataFrame:
        """Files with the same header are one scan, so the plan grows with the kinds of headers only."""
        kinds: dict[str, list[str]] = {}
        for p in paths:
            kinds.setdefault(files.first_line(self.spark, p), []).append(p)
        scans = [self._one(group) for group in kinds.values()]
        out = scans[0]
        for s in scans[1:]:
            out = out.unionByName(s)
        return out

    def directory(self, root: str, pattern: str = "*", max_depth: int = 20) -> DataFrame:
        return self.files(files.directory(self.spark, root, pattern, max_depth))

    def url(self, url: str) -> DataFrame:
        return self._one(files.fetched(self.spark, url))

    def string(self, content: str) -> DataFrame:
        return self._one(files.written(self.spark, content))


def read(spark: SparkSession, cls: Any, options: Options = DEFAULT) -> Reader:
    return Reader(spark, cls, options)


def write(df: DataFrame, path: str, options: Options = DEFAULT, mode: str = "error") -> None:
    """A directory of CSV files, one per partition, written by the executors."""
    flat = df.select(*flat_columns(df, options.naming))
    if options.quoting == QUOTE_NON_NUMERIC:
        lines = flat.select(line(flat, options).alias("value"))
        lines.write.mode(mode).option("lineSep", options.terminator).text(path)
        return
    (
        flat.write.mode(mode)
        .option("header", options.header)
        .option("sep", options.delimiter)
        .option("quote", "" if options.quoting == QUOTE_NONE else options.quote)
        .option("escape", options.escape)
        .option("quoteAll", options.quoting == QUOTE_ALL)
        .option("lineSep", options.terminator)
        .option("emptyValue", "")
        .option("encoding", options.encoding)
        .csv(path)
    )


def line(flat: DataFrame, options: Options) -> Column:
    """A row as a line in which all but numbers are quoted."""

    def cell(f: T.StructField) -> Column:
        text = F.col(f"`{f.name}`").cast("string")
        if isinstance(f.dataType, T.NumericType):
            return F.coalesce(text, F.lit(""))
        q = options.quote
        doubled = F.replace(text, F.lit(q), F.lit(options.escape + q))
        return F.coalesce(F.concat(F.lit(q), doubled, F.lit(q)), F.lit(""))

    return F.concat_ws(options.delimiter, *[cell(f) for f in flat.schema.fields])


def write_file(df: DataFrame, target: str | io.TextIOBase, options: Options = DEFAULT, append: bool = False) -> None:
    """One file (or an open text stream), streamed through the driver partition by partition."""
    flat = df.select(*flat_columns(df, options.naming))
    numeric = {f.name for f in flat.schema.fields if isinstance(f.dataType, T.NumericType)}
    quoting = {QUOTE_ALL: text_csv.QUOTE_ALL, QUOTE_NONE: text_csv.QUOTE_NONE, QUOTE_NON_NUMERIC: text_csv.QUOTE_NONNUMERIC}.get(options.quoting, text_csv.QUOTE_MINIMAL)
    texts = flat.select(*[F.col(f"`{c}`") if c in numeric and options.quoting == QUOTE_NON_NUMERIC else F.col(f"`{c}`").cast("string") for c in flat.columns])
    doubled = options.escape == options.quote

    def feed(out: Any) -> None:
        writer = text_csv.writer(
            out, delimiter=options.delimiter, quotechar=options.quote, doublequote=doubled, escapechar=None if doubled else options.escape,
            lineterminator=options.terminator, quoting=quoting,
        )
        if options.header and not append:
            writer.writerow(flat.columns)
        for row in texts.toLocalIterator(prefetchPartitions=True):
            writer.writerow(["" if v is None else v for v in row])

    _to(target, feed, options.encoding, append)


def _to(target: Any, feed: Callable[[Any], None], encoding: str, append: bool = False) -> None:
    if hasattr(target, "write"):
        feed(target)
        return
    with Path(target).open("a" if append else "w", encoding=encoding, newline="") as out:
        feed(out)
