"""HTML reports: a table with styles per header and field, nested lists as further rows."""

from __future__ import annotations

import dataclasses
import datetime as dt
import html
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from sparkloom.functions.naming import Naming, literal
from sparkloom.sources.csv import _to
from sparkloom.sources.nested import headers, table_rows

Style = dict[str, str]


@dataclasses.dataclass(frozen=True)
class Tag:
    """An element: name, CSS style, other attributes, and content put before the report's own."""

    name: str
    style: Style = dataclasses.field(default_factory=dict)
    attributes: dict[str, str] = dataclasses.field(default_factory=dict)
    content: str = ""

    def open(self, style: Style | None = None) -> str:
        css = {**self.style, **(style or {})}
        attributes = dict(self.attributes)
        if css:
            attributes["style"] = " ".join(f"{k}: {v};" for k, v in css.items())
        return f"<{self.name}" + "".join(f' {k}="{html.escape(v)}"' for k, v in attributes.items()) + ">" + self.content

    def close(self) -> str:
        return f"</{self.name}>"


@dataclasses.dataclass(frozen=True)
class Styling:
    """Styles by leaf field; each slot falls back to its default."""

    header: dict[str, Style] = dataclasses.field(default_factory=dict)
    field: dict[str, Style] = dataclasses.field(default_factory=dict)
    default_header: Style = dataclasses.field(default_factory=dict)
    default_field: Style = dataclasses.field(default_factory=dict)

    def for_header(self, path: str, style: Style) -> Styling:
        return dataclasses.replace(self, header={**self.header, leaf(path): style})

    def for_field(self, path: str, style: Style) -> Styling:
        return dataclasses.replace(self, field={**self.field, leaf(path): style})

    def for_all_headers(self, style: Style) -> Styling:
        return dataclasses.replace(self, header={}, default_header=style)

    def for_all_fields(self, style: Style) -> Styling:
        return dataclasses.replace(self, field={}, default_field=style)

    def add_header(self, path: str, style: Style) -> Styling:
        """Adds to what the header has by now, the default included."""
        return self.for_header(path, {**self.of_header(leaf(path)), **style})

    def add_field(self, path: str, style: Style) -> Styling:
        return self.for_field(path, {**self.of_field(leaf(path)), **style})

    def of_header(self, name: str) -> Style:
        return self.header.get(name, self.default_header)

    def of_field(self, name: str) -> Style:
        return self.field.get(name, self.default_field)


def leaf(path: str) -> str:
    """The field a path such as ``stats[].records[].id`` ends in."""
    return path.replace("[]", "").rpartition(".")[2]


def text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, dt.datetime):
        plain = value.strftime("%Y-%m-%dT%H:%M")
        return plain + (f":{value.second:02d}" if value.second or value.microsecond else "") + (f".{value.microsecond:06d}".rstrip("0") if value.microsecond else "")
    return str(value)


def write_file(
    df: DataFrame, target: Any, naming: Naming = literal, styling: Styling | None = None, html_tag: Tag = Tag("html"), head_tag: Tag = Tag("head"),
    body_tag: Tag = Tag("body"), table_tag: Tag = Tag("table"), tr_tag: Tag = Tag("tr"), th_tag: Tag = Tag("th"), td_tag: Tag = Tag("td"), encoding: str = "UTF-8",
    encoders: dict[str, Callable[[Any], str]] | None = None,
) -> None:
    """One document (or an open text stream), streamed through the driver; columns missing in a row get an empty cell.

    ``encoders`` give the text of a field's values in place of ``text``.
    """
    shown = encoders or {}
    names, style = headers(df.schema), styling or Styling()

    def feed(out: Any) -> None:
        out.write(html_tag.open() + head_tag.open() + head_tag.close() + body_tag.open() + table_tag.open())
        out.write(tr_tag.open() + "".join(th_tag.open(style.of_header(n)) + html.escape(naming(n)) + th_tag.close() for n in names) + tr_tag.close())
        for record in df.toLocalIterator(prefetchPartitions=True):
            for row in table_rows(record, df.schema):
                cells = (td_tag.open(style.of_field(n)) + html.escape(shown.get(n, text)(row.get(n)), quote=False) + td_tag.close() for n in names)
                out.write(tr_tag.open() + "".join(cells) + tr_tag.close())
        out.write(table_tag.close() + body_tag.close() + html_tag.close())

    _to(target, feed, encoding)
