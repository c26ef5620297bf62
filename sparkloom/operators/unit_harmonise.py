"""Quantities recorded in different units: every value in the common unit of its attribute, in plain SQL.

The number and the unit text are extracted by a regular expression, unit texts are brought to one spelling and
joined to an alias table, and the unit is the first that is known of: the unit field, the text around the
number, the note behind the variable's name, the source's default (the common unit). The value is then
``number * factor + offset``. Spellings are composed: every name of a unit also stands with words of scale on
either side (``k$``, ``persons (thousands)``, ``Dollars x 1,000``), which name the unit whose factor is that many times greater.

Scale: the names of attributes and their notes are read from the distinct texts of the variable column alone, which
are written to the shared folder when the query is built (a stream reads them row by row). Only joins with these and the reference tables
are involved; Spark broadcasts them by their size, and as long as it does there is no shuffle of the rows.

Defined results: a variable that names no attribute, or one that is not decimal, gives no row; null and marked
values give a null ``common_value`` with ``unit_status`` ``missing``; a unit text that no alias knows, or whose
quantity is another than the attribute's, gives ``unknown`` and a null ``common_value``; of attributes whose names
have the same letters the one with the least code counts; repeated rows come out as often as they go in; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import BLANK, BLANKS, is_missing, letters_key, number_of, number_parts
from sparkloom.runtime import cut

# Names of units by unit code, in singular or plural where both end alike but for an s.
UNIT_NAMES = {
    "DOL": ["dollar", "dollars", "$", "whole dollars", "dollars (units)"],
    "KDOL": ["$ thou.", "k$", "$k"],
    "MDOL": ["$ mil.", "mil. $", "m$", "$m", "mn $", "$mn"],
    "BDOL": ["$ bil.", "bil. $", "b$", "$b", "bn $", "$bn"],
    "T": ["tonne", "tonnes", "t", "metric ton", "metric tons"],
    "KT": ["kilotonne", "kilotonnes", "kt"],
    "KG": ["kilogram", "kilograms", "kg", "kgs", "kilo", "kilos"],
    "LB": ["pound", "pounds", "lb", "lbs"],
    "HA": ["hectare", "hectares", "ha"],
    "ACRE": ["acre", "acres", "ac"],
    "SQKM": ["square kilometre", "square kilometres", "km2", "km²", "sq km"],
    "SQM": ["square metre", "square metres", "m2", "m²", "sq m"],
    "KWH": ["kilowatt hour", "kilowatt hours", "kWh"],
    "MWH": ["megawatt hour", "megawatt hours", "MWh"],
    "GWH": ["gigawatt hour", "gigawatt hours", "GWh"],
    "GJ": ["gigajoule", "gigajoules", "GJ"],
    "TJ": ["terajoule", "terajoules", "TJ"],
    "KM": ["kilometre", "kilometres", "km"],
    "MI": ["mile", "miles", "mi"],
    "CUM": ["cubic metre", "cubic metres", "m3", "m³", "cu m"],
    "LTR": ["litre", "litres", "ltr", "L"],
    "MLT": ["megalitre", "megalitres", "ML"],
    "PERS": ["person", "persons", "people", "number", "headcount", "count"],
    "PCT": ["percent", "per cent", "percentage", "pct", "%"],
    "FRAC": ["fraction", "proportion", "share of 1", "of 1", "ratio (0-1)", "ratio"],
    "PML": ["per mille", "per thousand", "‰"],
    "BP": ["basis point", "basis points", "bp", "bps"],
    "HR": ["hour", "hours", "hr", "hrs", "h"],
    "MIN": ["minute", "minutes", "min", "mins"],
    "DAYS": ["day", "days", "d"],
}

# Words of scale.
SCALES = {
    1e3: ["thousand", "thousands", "thousands of", "thou", "000", "'000", "x 1,000"],
    1e6: ["million", "millions", "millions of", "mil", "mn", "000,000", "x 1,000,000"],
    1e9: ["billion", "billions", "billions of", "bil", "bn", "000,000,000", "x 1,000,000,000"],
}

# Texts of a unit field that name no unit.
NO_UNIT = ("", "-", "..", "see value", "n/a", "none")

#: Where a note begins behind a variable's name.
NOTE = rf"{BLANK}*[;\[(]{BLANK}*|,{BLANK}*in{BLANK}+|{BLANK}+-{BLANK}*|-{BLANK}+"


def unit_spelling(c: Column) -> Column:
    """One spelling of a unit text: case, blanks, brackets, points, commas, hyphens, quote marks and raised digits don't count."""
    return F.translate(F.lower(c), "²³_-()[].,+'" + BLANKS, "23")  # the other marks map to nothing


def alias_table(units: DataFrame, names: dict[str, list[str]] | None = None, scales: dict[float, list[str]] | None = None) -> DataFrame:
    """alias, unit_quantity, unit_code, factor, offset: names of units, also with words of scale, and the names and codes of the reference itself.

    A name as such goes before one with a word of scale. An optional column ``offset_to_common`` of ``units`` serves
    scales with another zero.
    """
    spark = units.sparkSession
    given = spark.createDataFrame([(code, t) for code, texts in (UNIT_NAMES if names is None else names).items() for t in texts], "unit_code string, text string")
    composed = [
        (code, scale, text)
        for code, texts in (UNIT_NAMES if names is None else names).items()
        for scale, words in (SCALES if scales is None else scales).items()
        for t in texts
        for w in words
        for text in (w + t, t + w)
    ]
    offset = F.col("offset_to_common") if "offset_to_common" in units.columns else F.lit(0.0)
    facts = units.select("unit_code", F.col("quantity").alias("unit_quantity"), F.col("factor_to_common").alias("factor"), offset.alias("offset"))
    own = units.select("unit_code", F.explode(F.array("unit_code", "unit_name")).alias("text"))
    plain = given.unionByName(own).join(facts, "unit_code").select("text", F.lit(0).alias("scaled"), "unit_code", "unit_quantity", "factor", "offset")
    larger = facts.withColumnsRenamed({"unit_code": "_code", "unit_quantity": "_quantity", "factor": "_factor", "offset": "_offset"})
    times = F.col("_factor") / F.col("factor") / F.col("scale")
    scaled = (
        spark.createDataFrame(composed, "unit_code string, scale double, text string")
        .join(facts, "unit_code")
        .join(larger, (F.col("unit_quantity") == F.col("_quantity")) & (F.col("offset") == 0) & (F.col("_offset") == 0) & times.between(1 - 1e-9, 1 + 1e-9))
        .select("text", F.lit(1).alias("scaled"), F.col("_code").alias("unit_code"), "unit_quantity", F.col("_factor").alias("factor"), "offset")
    )
    return (
        plain.unionByName(scaled)
        .select(unit_spelling(F.col("text")).alias("alias"), "scaled", "unit_code", "unit_quantity", "factor", "offset")
        .where(F.col("alias").isNotNull())
        .groupBy("alias", "unit_quantity")
        .agg(F.min(F.struct("scaled", "unit_code", "factor", "offset")).alias("u"))
        .select("alias", "unit_quantity", "u.unit_code", "u.factor", "u.offset")
    )


def with_attribute(rows: DataFrame, attributes: DataFrame, variable: str = "variable") -> DataFrame:
    """``rows`` that name an attribute, with attr_code, value_type, quantity, common_unit and _note, the note behind the name.

    The attribute is the one with the same letters; if none has, the one with the same letters after a note
    behind the name is cut off. A note of marks alone (``($)``) leaves the letters as they are and is read all the same.
    """
    if rows.isStreaming:
        return _named(rows, attributes, variable)
    texts = cut(_named(rows.select(F.col(variable).alias("_variable")).where(F.col(variable).isNotNull()).distinct(), attributes, "_variable"))
    return rows.join(texts, F.col(variable) == F.col("_variable")).drop("_variable")


def _named(rows: DataFrame, attributes: DataFrame, variable: str) -> DataFrame:
    named = (
        attributes.groupBy(letters_key(F.col("attr_name")).alias("_key"))
        .agg(F.min(F.struct("attr_code", "value_type", "quantity", "common_unit")).alias("_attribute"))
        .where(F.col("_key") != "")
    )
    start = F.regexp_extract(F.col(variable), rf"^(.*?)(?:{NOTE})", 1)
    note = F.regexp_extract(F.col(variable), rf"^.*?(?:{NOTE})(.*)$", 1)
    marks = F.regexp_extract(F.col(variable), rf"^.*?(?:{NOTE})([^\p{{L}}]*)$", 1)
    whole, cut_off = named.withColumnsRenamed({"_key": "_k1", "_attribute": "_a1"}), named.withColumnsRenamed({"_key": "_k2", "_attribute": "_a2"})
    keep = [F.col(c) for c in rows.columns]
    return (
        rows.withColumn("_whole", letters_key(F.col(variable)))
        .join(whole, F.col("_whole") == F.col("_k1"), "left")
        .withColumn("_cut", F.when(F.col("_a1").isNull(), letters_key(start)))
        .join(cut_off, F.col("_cut") == F.col("_k2"), "left")
        .withColumn("_attribute", F.coalesce("_a1", "_a2"))
        .where(F.col("_attribute").isNotNull())
        .select(*keep, F.col("_attribute.*"), F.trim(F.when(F.col("_a1").isNull(), note).otherwise(marks)).alias("_note"))
    )


def harmonise(
    rows: DataFrame, attributes: DataFrame, units: DataFrame, names: dict[str, list[str]] | None = None, keep: tuple[str, ...] = ("row_id",)
) -> DataFrame:
    """Per row of a decimal attribute: the number, the unit it was recorded in and the value in the common unit.

    Columns: ``keep``, attr_code, number, unit_code, unit_from (field, value, note, default, null), unit_status
    (ok, missing, unknown), common_value, common_unit.
    """
    chosen = [F.col(k) for k in dict.fromkeys([*keep, "variable", "value", "unit"])]
    decimals = with_attribute(rows.select(*chosen), attributes).where(F.col("value_type") == "decimal")
    texts = decimals.select(
        *keep, "attr_code", "quantity", "common_unit", "value",
        is_missing(F.col("value")).alias("_missing"),
        number_parts(F.col("value")).alias("_parts"),
        F.col("unit").alias("_field"),
        "_note",
    )
    texts = texts.withColumn("number", number_of(F.col("_parts")))
    alias = cut(alias_table(units, names))
    parts = F.when(F.size("_parts") == 3, F.concat(F.get("_parts", F.lit(0)), F.get("_parts", F.lit(2))))  # ``$5.2k`` gives ``$k``
    sources = {"field": F.col("_field"), "value": parts, "note": F.col("_note")}
    common = units.select(F.col("unit_code").alias("_default"), F.col("quantity").alias("_q_default"), F.col("factor_to_common").alias("_f"),
                          (F.col("offset_to_common") if "offset_to_common" in units.columns else F.lit(0.0)).alias("_o")).dropDuplicates(["_default", "_q_default"])
    found = F.lit(False)
    for s, text in sources.items():  # a source is only read where none before it is known
        known = alias.select(F.col("alias").alias(f"_a_{s}"), F.col("unit_quantity").alias(f"_q_{s}"), F.struct("unit_code", "factor", "offset").alias(f"_u_{s}"))
        texts = texts.withColumn(f"_t_{s}", F.when(~found, unit_spelling(text)))
        texts = texts.join(known, (F.col(f"_t_{s}") == F.col(f"_a_{s}")) & (F.col("quantity") == F.col(f"_q_{s}")), "left")
        found = found | F.col(f"_u_{s}").isNotNull()
    texts = texts.join(common, (F.col("common_unit") == F.col("_default")) & (F.col("quantity") == F.col("_q_default")), "left")
    no_unit = unit_spellings_of_none()
    foreign = F.lit(False)
    for s in sources:
        foreign = foreign | (F.col(f"_u_{s}").isNull() & ~F.coalesce(F.col(f"_t_{s}"), F.lit("")).isin(*no_unit))
    fallback = F.when(~foreign, F.struct(F.col("common_unit").alias("unit_code"), F.coalesce("_f", F.lit(1.0)).alias("factor"), F.coalesce("_o", F.lit(0.0)).alias("offset")))
    unit = F.coalesce(*[F.col(f"_u_{s}") for s in sources], fallback)
    source = F.coalesce(*[F.when(F.col(f"_u_{s}").isNotNull(), s) for s in sources], F.when(~foreign, "default"))
    out = texts.withColumn("_unit", unit).withColumn("unit_from", source)
    status = F.when(F.col("_missing"), "missing").when(F.col("_unit").isNull() | F.col("number").isNull(), "unknown").otherwise("ok")
    return out.withColumn("unit_status", status).select(
        *keep, "attr_code", "number", F.col("_unit.unit_code").alias("unit_code"), "unit_from", "unit_status",
        F.when(F.col("unit_status") == "ok", F.col("number") * F.col("_unit.factor") + F.col("_unit.offset")).alias("common_value"),
        "common_unit",
    )


def unit_spellings_of_none() -> list[str]:
    """``NO_UNIT`` as ``unit_spelling`` leaves them."""
    return sorted({"", *(t.translate(str.maketrans("", "", "-. ")) for t in NO_UNIT)})


def in_other_unit(harmonised: DataFrame, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Rows whose value was recorded in another unit than the common one."""
    return harmonised.where((F.col("unit_status") != "missing") & F.col("unit_code").isNotNull() & (F.col("unit_code") != F.col("common_unit"))).select(*keep)
