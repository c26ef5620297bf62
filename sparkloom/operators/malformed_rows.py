"""Rows that fail to parse: split the records of delimited files into loaded and refused ones.

From the schema one anchored expression per whole row is generated. A row that matches it is loaded.
Every other row goes through prefix patterns that grow by one field, and the first one that decides names
the reason and the first broken field. The prefixes run in two tiers, as the reasons are ranked. The first only splits fields:

* ``quotes``: the prefix up to a field doesn't match, or what follows the last field of the schema isn't fields,
* ``columns``: the row ends with a prefix that is shorter than the schema, or goes on with fields behind it.

The second tests what the fields hold: the reason is that of the typed field (``year``, ``value``) whose prefix fails first.

All of it is JVM-side regular expressions with possessive quantifiers, so very long fields neither
backtrack nor overflow the stack; there is no shuffle.

Defined results: null records and blank ones are neither loaded nor refused; a header (``line_no`` 1) is
neither; a null ``line_no`` is an ordinary record; repeated records are each judged; an empty table gives
empty results; other columns of the input, whatever their names, are ignored unless listed in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import BLANK, NUMBER, UNGROUPED_NUMBER, trimmed

#: A field as written: quoted if its first character is a quote mark (marks inside are doubled), else free of marks.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
PLAIN = r'[^",]*+'
FIELD = rf"(?:{QUOTED}|{PLAIN})"


class Field(NamedTuple):
    """A field of a record; ``content`` is what its trimmed content must match, None for any text.

    ``bare`` is the same for a field without quotes, needed where ``content`` may hold a comma.
    """

    name: str
    content: str | None = None
    reason: str = ""
    type: str = "string"
    bare: str | None = None

    @property
    def written(self) -> str:
        if self.content is None:
            return FIELD
        quoted, bare = (rf"{BLANK}*+(?:{c}){BLANK}*+" for c in (self.content, self.bare or self.content))
        return rf'(?:"{quoted}"|{bare})'


# Years from 1900 to 2100; a value is empty, marked or a number.
YEAR = r"19[0-9]{2}|20[0-9]{2}|2100"
VALUE = rf"(?:[CS]|{NUMBER})?"
BARE_VALUE = rf"(?:[CS]|{UNGROUPED_NUMBER})?"

ENTERPRISE_SURVEY = (
    Field("year", YEAR, "year", "int"),
    Field("industry_code_anzsic"),
    Field("industry_name_anzsic"),
    Field("rme_size_grp"),
    Field("variable"),
    Field("value", VALUE, "value", bare=BARE_VALUE),
    Field("unit"),
)


@dataclass(frozen=True)
class RowGrammar:
    """The expressions generated from a schema."""

    fields: tuple[Field, ...]

    @property
    def row(self) -> str:
        """The whole row, typed."""
        return rf"\A{','.join(f.written for f in self.fields)}\z"

    def prefix(self, k: int, typed: bool = False, end: str = r"(?:,|\z)") -> str:
        """The first k + 1 fields, up to a comma or the end of the row."""
        return rf"\A{','.join(f.written if typed else FIELD for f in self.fields[: k + 1])}{end}"

    @property
    def longer(self) -> str:
        """More fields than the schema has."""
        return rf"{self.prefix(len(self.fields) - 1, end='')}(?:,{FIELD})++\z"

    def verdict(self, raw: Column) -> Column:
        """reason and broken_field of a row that doesn't match ``row``; the first prefix that decides ends the search."""
        n = len(self.fields)
        names = [*(f.name for f in self.fields), "beyond the last field"]

        def of(reason: str, k: int) -> Column:
            return F.struct(F.lit(reason).alias("reason"), F.lit(names[k]).alias("broken_field"))

        steps = []
        for k in range(n):
            steps.append((~raw.rlike(self.prefix(k)), of("quotes", k)))
            if k < n - 1:
                steps.append((raw.rlike(self.prefix(k, end=r"\z")), of("columns", k + 1)))
        steps.append((raw.rlike(self.longer), of("columns", n)))
        steps.append((~raw.rlike(self.prefix(n - 1, end=r"\z")), of("quotes", n)))
        steps += [(~raw.rlike(self.prefix(k, typed=True)), of(f.reason, k)) for k, f in enumerate(self.fields) if f.content is not None]
        found = F.when(*steps[0])
        for step in steps[1:]:
            found = found.when(*step)
        return found


def parse_records(
    records: DataFrame,
    fields: tuple[Field, ...] = ENTERPRISE_SURVEY,
    raw: str = "raw_line",
    line_no: str | None = "line_no",
    keep: tuple[str, ...] = ("line_id",),
) -> DataFrame:
    """Every record that is neither header nor blank, with ``reason`` and ``broken_field`` (null if it loads)
    and ``cells``, the unquoted field contents of a row that loads."""
    grammar = RowGrammar(tuple(fields))
    text = F.col("_raw")
    rows = records.select(*keep, F.col(raw).alias("_raw"), *([F.col(line_no).alias("_line_no")] if line_no else []))
    if line_no:
        rows = rows.where(F.coalesce(F.col("_line_no") != 1, F.lit(True)))
    rows = rows.where(text.rlike(r"[^\s\p{Z}]"))
    verdict = F.when(~text.rlike(grammar.row), grammar.verdict(text))
    written = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(rf",({FIELD})"), F.lit(1))
    unquoted = F.transform(
        written,
        lambda w: F.when(w.startswith('"'), F.replace(F.substr(w, F.lit(2), F.length(w) - 2), F.lit('""'), F.lit('"'))).otherwise(w),
    )
    judged = rows.withColumn("_verdict", verdict)
    return judged.select(
        *keep,
        text.alias("raw"),
        F.col("_verdict.reason").alias("reason"),
        F.col("_verdict.broken_field").alias("broken_field"),
        F.when(F.col("_verdict").isNull(), unquoted).alias("cells"),
    )


def refused(parsed: DataFrame, keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """The refused records with the reason and the first broken field."""
    return parsed.where(F.col("reason").isNotNull()).select(*keep, "reason", "broken_field", "raw")


def loaded(parsed: DataFrame, fields: tuple[Field, ...] = ENTERPRISE_SURVEY, keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """The rows that parse, one typed column per field of the schema."""
    cells = F.col("cells")
    return parsed.where(F.col("reason").isNull()).select(
        *keep,
        *[(trimmed(cells[k]).try_cast(f.type) if f.type != "string" else cells[k]).alias(f.name) for k, f in enumerate(fields)],
    )
