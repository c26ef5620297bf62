"""XLSX workbooks, read and written as the ZIP of XML parts that they are.

Files are read by the executors, one task per file. Cells are found by the header row's names or, in order, by
position; formula cells give their cached value if ``evaluate_formulas`` is set and are errors otherwise.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from typing import Any
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.naming import Naming, literal
from sparkloom.sources import files
from sparkloom.sources.html import Styling
from sparkloom.sources.nested import headers, table_rows
from sparkloom.sources.records import Leaf, Parser, decode, record

# Names of the parts and namespaces of the format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_EPOCH = dt.datetime(1899, 12, 30)


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA1."""
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def parse(content: bytes, sheet: int | str | Callable[[list[str]], str] = 0, evaluate_formulas: bool = False) -> list[list[str | None]]:
    """The cells of a sheet as texts; blank rows are left out. A formula not evaluated reads ``=formula``.

    The sheet is given by its place, its name, or a function that chooses one of the names.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(f"{_REL}id")]) for s in book.iter(f"{_MAIN}sheet")]
        chosen = sheet([n for n, _ in sheets]) if callable(sheet) else sheet
        name, target = sheets[chosen] if isinstance(chosen, int) else next(s for s in sheets if s[0] == chosen)
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        rows = []
        for row in ET.fromstring(z.read(path)).iter(f"{_MAIN}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{_MAIN}c"):
                at = column_number(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                formula, v, inline = c.find(f"{_MAIN}f"), c.find(f"{_MAIN}v"), c.find(f"{_MAIN}is")
                text = v.text if v is not None else None
                if formula is not None and not evaluate_formulas:
                    text = f"={formula.text or ''}"
                elif c.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                elif c.get("t") == "b" and text is not None:
                    text = "true" if text == "1" else "false"
                elif inline is not None:
                    text = "".join(t.text or "" for t in inline.iter(f"{_MAIN}t"))
                cells.append(text)
            if any(x not in (None, "") for x in cells):
                rows.append(cells)
        return rows


@dataclasses.dataclass(frozen=True)
class Reader:
    """An immutable reader of a dataclass. ``by_name`` takes the first row as headers, otherwise cells count in order."""

    spark: SparkSession
    cls: Any
    by_name: bool = False
    naming: Naming = literal
    sheet: int | str | Callable[[list[str]], str] = 0
    evaluate_formulas: bool = False
    parsers: dict[Any, Parser] = dataclasses.field(default_factory=dict)
    strict: bool = True

    def option(self, **changed: Any) -> Reader:
        return dataclasses.replace(self, **changed)

    def file(self, path: str) -> DataFrame:
        return self.files([path])

    def directory(self, root: str, pattern: str = "*.xlsx", max_depth: int = 20) -> DataFrame:
        return self.files(files.directory(self.spark, root, pattern, max_depth))

    def url(self, url: str) -> DataFrame:
        return self.file(files.fetched(self.spark, url))

    def bytes(self, content: bytes) -> DataFrame:
        """A workbook at hand."""
        return self.file(files.written(self.spark, content))

    def files(self, paths: Sequence[str]) -> DataFrame:
        sheet, formulas, by_name = self.sheet, self.evaluate_formulas, self.by_name
        schema = record(self.cls)
        leaves = schema.leaves()
        wanted = [self.naming(x.name) for x in leaves]

        def open_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for content in batch["content"]:
                    rows = parse(content, sheet, formulas)
                    places = list(range(len(wanted)))
                    if by_name:
                        head = [h.strip() if h else h for h in rows[0]] if rows else []
                        places, rows = [head.index(w) if w in head else -1 for w in wanted], rows[1:]
                    cells = [[r[p] if 0 <= p < len(r) else None for p in places] for r in rows]
                    yield pd.DataFrame({"cells": cells})

        rows = self.spark.read.format("binaryFile").load(list(paths)).select("content").mapInPandas(open_files, "cells array<string>")
        place = {x.path: i for i, x in enumerate(leaves)}

        def cell(x: Leaf) -> Column:
            return F.get(F.col("cells"), F.lit(place[x.path]))

        return decode(rows, schema, cell, {**_typed_parsers(), **self.parsers}, self.strict)


def _typed_parsers() -> dict[Any, Parser]:
    """Dates are serial numbers or ISO texts; whole numbers may be written with a fraction, which is cut off."""
    serial = r"^[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"

    def day(text: Column) -> Column:
        return F.when(text.rlike(serial), F.date_add(F.lit(_EPOCH.date()), F.floor(text.try_cast("double")).cast("int"))).otherwise(text.try_cast("date"))

    def moment(text: Column) -> Column:
        seconds = F.round(text.try_cast("double") * 86400).cast("long")
        at = F.timestamp_add("SECOND", seconds, F.lit(_EPOCH).cast("timestamp_ntz"))
        return F.when(text.rlike(serial), at).otherwise(text.try_cast("timestamp_ntz"))

    def whole(text: Column) -> Column:
        return text.try_cast("double").try_cast("bigint")

    return {dt.date: day, dt.datetime: moment, int: whole}


def read(spark: SparkSession, cls: Any) -> Reader:
    return Reader(spark, cls)


def _font(style: dict[str, str]) -> str:
    bold = "<b/>" if style.get("font-weight") == "bold" else ""
    italic = "<i/>" if style.get("font-style") == "italic" else ""
    color = f'<color rgb="FF{style["color"].lstrip("#").upper()}"/>' if style.get("color") else ""
    return f'<font>{bold}{italic}<sz val="11"/>{color}<name val="Calibri"/></font>'


def _fill(style: dict[str, str]) -> str:
    color = style.get("background-color")
    if not color:
        return '<fill><patternFill patternType="none"/></fill>'
    return f'<fill><patternFill patternType="solid"><fgColor rgb="FF{color.lstrip("#").upper()}"/></patternFill></fill>'


def write_file(df: DataFrame, path: str | io.BytesIO, sheet: str = "Default", header: bool = False, naming: Naming = literal, styling: Styling | None = None) -> None:
    """One workbook, streamed through the driver; nested lists become further rows, missing cells stay blank.

    Styles know ``font-weight``, ``font-style``, ``color`` and ``background-color`` (six hex digits).
    """
    names, style = headers(df.schema), styling or Styling()
    styles: list[tuple] = [((), "")]

    def style_id(s: dict[str, str], number_format: str = "") -> int:
        key = (tuple(sorted(s.items())), number_format)
        if key not in styles:
            styles.append(key)
        return styles.index(key)

    def cell(column: int, row: int, value: Any, s: dict[str, str]) -> str:
        at = f"{column_letters(column)}{row}"
        if value is None:
            return f'<c r="{at}" s="{style_id(s)}"/>' if s else ""
        if isinstance(value, bool):
            return f'<c r="{at}" s="{style_id(s)}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, dt.datetime):
            return f'<c r="{at}" s="{style_id(s, "moment")}"><v>{(value - _EPOCH).total_seconds() / 86400!r}</v></c>'
        if isinstance(value, dt.date):
            return f'<c r="{at}" s="{style_id(s, "day")}"><v>{(value - _EPOCH.date()).days}</v></c>'
        if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
            return f'<c r="{at}" s="{style_id(s)}"><v>{value}</v></c>'
        return f'<c r="{at}" s="{style_id(s)}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main, rel = _MAIN.strip("{}"), _REL.strip("{}")
    package, content = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
            out.write(f'{xml}<worksheet xmlns="{main}"><sheetData>'.encode())
            n = 0
            if header:
                n = 1
                out.write(f'<row r="1">{"".join(cell(i, 1, naming(h), style.of_header(h)) for i, h in enumerate(names))}</row>'.encode())
            for value in df.toLocalIterator(prefetchPartitions=True):
                for row in table_rows(value, df.schema):
                    n += 1
                    out.write(f'<row r="{n}">{"".join(cell(i, n, row.get(h), style.of_field(h)) for i, h in enumerate(names))}</row>'.encode())
            out.write(b"</sheetData></worksheet>")
        formats = {"": 0, "day": 14, "moment": 22}
        looks = [dict(s) for s, _ in styles]
        fonts, fills = "".join(map(_font, looks)), "".join(map(_fill, looks))
        xfs = "".join(f'<xf numFmtId="{formats[f]}" fontId="{i}" fillId="{i + 2}" borderId="0" xfId="0" applyNumberFormat="1" applyFont="1" applyFill="1"/>' for i, (_, f) in enumerate(styles))
        none, gray = '<fill><patternFill patternType="none"/></fill>', '<fill><patternFill patternType="gray125"/></fill>'
        z.writestr("xl/styles.xml", f'{xml}<styleSheet xmlns="{main}"><fonts count="{len(styles)}">{fonts}</fonts><fills count="{len(styles) + 2}">{none}{gray}{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(styles)}">{xfs}</cellXfs></styleSheet>')
        z.writestr("xl/workbook.xml", f'{xml}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{xml}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("_rels/.rels", f'{xml}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'{xml}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{content}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{content}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{content}.styles+xml"/></Types>')
