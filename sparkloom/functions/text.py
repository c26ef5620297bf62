"""Text expressions: trimming, keys of letters, missing marks, numbers inside text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One blank of any kind, as a regular expression (Java and RE2 alike).
BLANK = r"[\s\p{Z}]"

#: The same characters one by one: line ends and tabs, and all Unicode separators.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: A number: sign, digits plain or in comma groups of three, point with digits, exponent.
NUMBER = r"[+-]?(?:(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"

#: The same without comma groups.
UNGROUPED_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"

# Marks that stand for a missing value, in upper case.
MISSING_MARKS = ("", "C", "S", "..", "N/A")


def trimmed(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.btrim(c, F.lit(BLANKS))


def code_key(c: Column) -> Column:
    """A code trimmed and in upper case; blank codes are null."""
    return F.nullif(F.upper(trimmed(c)), F.lit(""))


def letters_key(c: Column) -> Column:
    """The letters alone, in lower case: case, blanks and marks don't count."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}]+", "")


def squeezed(c: Column) -> Column:
    """Lower case, trimmed, runs of blanks as one blank."""
    plain = F.translate(F.lower(trimmed(c)), BLANKS, " " * len(BLANKS))
    return F.when(plain.contains("  "), F.regexp_replace(plain, " +", " ")).otherwise(plain)


def is_missing(c: Column) -> Column:
    """Null or a missing mark."""
    return c.isNull() | F.upper(trimmed(c)).isin(*MISSING_MARKS)


def number_parts(c: Column) -> Column:
    """What stands before the first number of a text, the number, and what stands behind it, by one match; without a number the text is all before it.

    Nearly all plain numbers are told by their characters alone.
    """
    marked = F.split(F.regexp_replace(F.translate(c, "\u0001", " "), rf"(?s)\A(.*?)({NUMBER})(.*)\z", "$1\u0001$2\u0001$3"), "\u0001", 3)
    marks = F.translate(c, "0123456789", "")
    ends = c.endswith(".") | c.endswith("-") | (c == "")
    plain = (marks.isin("", ".") | (marks.isin("-", "-.") & c.startswith("-"))) & ~ends
    none = F.lit("")
    return F.when(plain, F.array(none, c, none)).otherwise(marked)


def number_of(parts: Column) -> Column:
    """The number of ``number_parts`` as double; null if there is none.

    A sign may stand before a currency mark (``-$5``) or behind it (``$-5``).
    """
    sign = F.when(F.ltrim(F.get(parts, F.lit(0))).startswith("-"), -1.0).otherwise(1.0)
    return F.replace(F.get(parts, F.lit(1)), F.lit(","), F.lit("")).try_cast("double") * sign


def number_in(c: Column) -> Column:
    """The first number of a text as double; null if there is none."""
    return number_of(number_parts(c))
