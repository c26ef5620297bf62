import pytest
from pyspark.sql import functions as F
from sparkloom.operators.unit_harmonise import alias_table, harmonise, in_other_unit, unit_spelling

ROW = "row_id bigint, variable string, value string, unit string"


@pytest.fixture(scope="module")
def attributes(spark):
    rows = [("V1", "Staff cost", "decimal", "money", "KDOL"), ("V2", "Waste dumped", "decimal", "mass", "T"), ("V3", "Water warmth", "decimal", "warmth", "C"), ("V4", "Foreign owned", "boolean", None, None)]
    return spark.createDataFrame(rows, "attr_code string, attr_name string, value_type string, quantity string, common_unit string")


@pytest.fixture(scope="module")
def units(spark):
    rows = [
        ("KDOL", "thousand dollars", "money", 1.0, "KDOL", 0.0), ("DOL", "dollars", "money", 0.001, "KDOL", 0.0), ("T", "tonnes", "mass", 1.0, "T", 0.0), ("KG", "kilograms", "mass", 0.001, "T", 0.0),
        ("C", "celsius", "warmth", 1.0, "C", 0.0), ("F", "fahrenheit", "warmth", 5 / 9, "C", -160 / 9),
    ]
    return spark.createDataFrame(rows, "unit_code string, unit_name string, quantity string, factor_to_common double, common_unit string, offset_to_common double")


CASES = [
    ("Staff cost", "5", "$", ("DOL", "field", "ok", 0.005)), ("Staff cost", "$1,234.5k", "see value", ("KDOL", "value", "ok", 1234.5)), ("Staff cost", "$-2000", "-", ("DOL", "value", "ok", -2.0)),
    ("Staff cost, in $", "3000", None, ("DOL", "note", "ok", 3.0)), ("STAFF-COST [Dollars (thousands)]", "3", "", ("KDOL", "note", "ok", 3.0)), ("Staff cost", "7", None, ("KDOL", "default", "ok", 7.0)),
    ("Waste dumped", "4E3kg", None, ("KG", "value", "ok", 4.0)), ("Waste dumped; kg", "1", "", ("KG", "note", "ok", 0.001)), ("Waste dumped", "..", "kg", ("KG", "field", "missing", None)),
    ("Waste dumped", None, None, ("T", "default", "missing", None)), ("Waste dumped", "5", "furlongs", (None, None, "unknown", None)), ("Waste dumped", "5", "$", (None, None, "unknown", None)),
    ("Waste dumped", "∞", "kg", ("KG", "field", "unknown", None)), ("Water warmth", "212", "fahrenheit", ("F", "field", "ok", 100.0)), ("Waste dumped", "-$5", None, (None, None, "unknown", None)),
]


def test_cases(spark, attributes, units):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], ROW)
    got = {r.row_id: (r.unit_code, r.unit_from, r.unit_status, r.common_value if r.common_value is None else round(r.common_value, 9)) for r in harmonise(df, attributes, units).collect()}
    assert got == {i: c[3] for i, c in enumerate(CASES)}


def test_other_unit(spark, attributes, units):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], ROW)
    assert {r.row_id for r in in_other_unit(harmonise(df, attributes, units)).collect()} == {i for i, c in enumerate(CASES) if c[3][2] != "missing" and c[3][0] in ("DOL", "KG", "F")}


def test_unknown_empty_repeated_long_and_clashing(spark, attributes, units):
    rows = [(1, None, "1", "kg"), (2, "Foreign owned", "1", None), (3, "Something", "1", None), (4, "Waste dumped", "1" + "x" * 100_000, None), (5, "Waste dumped", "1", "kg"), (5, "Waste dumped", "1", "kg"), (None, "Waste dumped", "2", "t")]
    got = harmonise(spark.createDataFrame(rows, ROW), attributes, units).collect()
    assert sorted((r.row_id or 0) for r in got) == [0, 4, 5, 5]
    assert harmonise(spark.createDataFrame([], ROW), attributes, units).count() == 0
    more = spark.createDataFrame([(1, "Waste dumped", "1", "kg", "a", "b", "c")], ROW + ", quantity string, alias string, unit_code string")
    assert harmonise(more, attributes, units).collect()[0].common_value == 0.001


MARKS_ALONE = [
    ("Staff cost ($)", "3000", None, ("DOL", "note", "ok", 3.0)), ("Staff cost [$]", "3000", "", ("DOL", "note", "ok", 3.0)), ("STAFF-COST; $", "3000", None, ("DOL", "note", "ok", 3.0)),
    ("Staff cost - $", "3000", "see value", ("DOL", "note", "ok", 3.0)), ("Staff cost: [$]", "-3,000", None, ("DOL", "note", "ok", -3.0)), ("Staff cost ($000)", "3", None, ("KDOL", "note", "ok", 3.0)),
    ("Staff cost ($)", "3", "thousand dollars", ("KDOL", "field", "ok", 3.0)), ("Staff cost ($)", "3k$", None, ("KDOL", "value", "ok", 3.0)), ("Staff cost ($)", "..", None, ("DOL", "note", "missing", None)),
    ("Idle share (‰)", "85", None, ("PML", "note", "ok", 8.5)), ("Idle share [‰]", "85", None, ("PML", "note", "ok", 8.5)), ("Idle share; ‰", "85", None, ("PML", "note", "ok", 8.5)),
    ("Idle share - ‰", "85", None, ("PML", "note", "ok", 8.5)), ("Idle share - %", "85", None, ("PCT", "note", "ok", 85.0)), ("Staff cost ()", "3", None, ("KDOL", "default", "ok", 3.0)),
    ("Staff-cost", "3", None, ("KDOL", "default", "ok", 3.0)), ("Staff cost ($)", "3000", "furlongs", ("DOL", "note", "ok", 3.0)), ("Staff cost (‰)", "3000", None, (None, None, "unknown", None)),
]


def test_notes_of_marks_alone(spark, attributes, units):
    attributes = attributes.union(spark.createDataFrame([("V5", "Idle share", "decimal", "share", "PCT")], attributes.schema))
    units = units.union(spark.createDataFrame([("PCT", "percent", "share", 1.0, "PCT", 0.0), ("PML", "per mille", "share", 0.1, "PCT", 0.0)], units.schema))
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(MARKS_ALONE)], ROW)
    got = {r.row_id: (r.unit_code, r.unit_from, r.unit_status, r.common_value if r.common_value is None else round(r.common_value, 9)) for r in harmonise(df, attributes, units).collect()}
    assert got == {i: c[3] for i, c in enumerate(MARKS_ALONE)}


def test_names_with_words_of_scale(spark, attributes):
    units = spark.createDataFrame(
        [("KDOL", "thousand dollars", "money", 1.0, "KDOL"), ("DOL", "dollars", "money", 0.001, "KDOL"), ("MDOL", "million dollars", "money", 1000.0, "KDOL"), ("T", "tonnes", "mass", 1.0, "T"), ("KT", "kilotonnes", "mass", 1000.0, "T")],
        "unit_code string, unit_name string, quantity string, factor_to_common double, common_unit string",
    )
    known = {(r.alias, r.unit_quantity): r.unit_code for r in alias_table(units).collect()}
    cases = {
        "money": {"$000": "KDOL", "'000 $": "KDOL", "Dollars x 1,000": "KDOL", "thousands of dollars": "KDOL", "DOLLARS_THOUSANDS": "KDOL", "$ thou.": "KDOL", "millions of $": "MDOL", "Dollar (mil.)": "MDOL", "billion dollars": None},
        "mass": {"tonnes (thousands)": "KT", "000 t": "KT", "thousand metric tons": "KT", "million tonnes": None},
    }
    spelled = spark.createDataFrame([(q, t) for q, texts in cases.items() for t in texts], "q string, t string")
    assert {(r.q, r.t): known.get((r.s, r.q)) for r in spelled.select("q", "t", unit_spelling(F.col("t")).alias("s")).collect()} == {(q, t): c for q, texts in cases.items() for t, c in texts.items()}


def test_attributes_of_the_same_letters(spark, attributes, units):
    twice = attributes.union(spark.createDataFrame([("V0", "staff-COST", "decimal", "money", "KDOL")], attributes.schema))
    df = spark.createDataFrame([(1, "Staff cost", "5", "$")], ROW)
    assert [r.attr_code for r in harmonise(df, twice, units).collect()] == ["V0"]
