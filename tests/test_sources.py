import dataclasses
import datetime as dt
import enum
import io
import re
import uuid
import zipfile
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from sparkloom.functions import naming
from sparkloom.sources import csv, excel, files, html, json


class Color(enum.Enum):
    RED = 1
    BLUE = 2


@dataclasses.dataclass
class Load:
    label: str
    weightInGrams: int
    packedOn: dt.date
    fragile: bool


@dataclasses.dataclass
class Seal:
    code: uuid.UUID
    closedAt: dt.datetime


@dataclasses.dataclass
class Crate:
    load: Load
    seal: Seal | None


@dataclasses.dataclass
class Person:
    name: str
    age: int | None


@dataclasses.dataclass
class Painted:
    color: Color
    price: Decimal


SEAL = uuid.UUID(int=0x5EA1)
CRATES = f"""label,weight_in_grams,packed_on,fragile,code,closed_at
anvil,84000,2020-02-29,false,,
glass eyes,310,2019-12-31,true,{SEAL},2020-01-01T23:59
"""


@pytest.mark.parametrize(
    ("strategy", "want"),
    [
        (naming.literal, "fieldNameHTML"), (naming.capitalize, "FieldNameHTML"), (naming.snake_case, "field_name_html"), (naming.screaming_snake_case, "FIELD_NAME_HTML"), (naming.kebab_case, "field-name-html"),
        (naming.with_spaces, "field Name HTML"), (naming.with_spaces_lower_case, "field name html"), (naming.with_spaces_capitalize, "Field Name Html"),
    ],
)
def test_naming(strategy, want):
    assert strategy("fieldNameHTML") == want


def test_csv_nested_and_optional(spark):
    anvil, eyes = csv.read(spark, Crate).option(naming=naming.snake_case).string(CRATES).orderBy("load.label").collect()
    assert anvil.load.weightInGrams == 84000 and anvil.seal is None
    assert eyes.seal.code == str(SEAL) and eyes.seal.closedAt == dt.datetime(2020, 1, 1, 23, 59)


def test_csv_header_order_case_and_empty_cells(spark):
    got = csv.read(spark, Person).string(" AGE ,Name\r\n5,ann\r\n\r\n,\r\n7,\r\n").collect()
    assert sorted((r["name"], r.age or 0) for r in got) == [("", 0), ("", 7), ("ann", 5)]
    with pytest.raises(PySparkException, match="field not found"):
        csv.read(spark, Person).option(case_sensitive=True).string("NAME,age\nx,1\n").collect()


def test_csv_errors_are_gathered(spark):
    bad = "label,weight_in_grams,packed_on,fragile,code,closed_at\nx,heavy,yesterday,,broken,\n"
    reader = csv.read(spark, Crate).option(naming=naming.snake_case)
    with pytest.raises(PySparkException) as e:
        reader.string(bad).collect()
    for path in ("load.weightInGrams: can't read heavy", "load.packedOn: can't read yesterday", "load.fragile: field not found", "seal.code: can't read", "seal.closedAt: field not found"):
        assert path in str(e.value)
    assert len(reader.lenient().string(bad).collect()[0].errors) == 5


def test_csv_enum_decimal_and_own_parser(spark):
    got = csv.read(spark, Painted).string("color,price\nRED,1.5\n").collect()[0]
    assert (got.color, got.price) == ("RED", Decimal("1.5"))
    with pytest.raises(PySparkException):
        csv.read(spark, Painted).string("color,price\nGREEN,1.5\n").collect()
    own = csv.read(spark, Painted).parser("price", lambda c: F.regexp_replace(c, "[^0-9.]", "").try_cast("decimal(38,18)"))
    assert own.string("color,price\nBLUE,$ 2\n").collect()[0].price == 2


def test_csv_files_directory_and_tsv(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.csv").write_text("name,age\nx,1\n")
    (tmp_path / "2.csv").write_text("age,name\n2,y\n")
    (tmp_path / "3.txt").write_text("nothing")
    assert files.directory(spark, str(tmp_path), "*.csv", 1) == [str(tmp_path / "2.csv"), str(tmp_path / "a/1.csv")] and files.directory(spark, str(tmp_path), "*.csv", 0) == [str(tmp_path / "2.csv")]
    got = csv.read(spark, Person).directory(str(tmp_path), "*.csv").collect()
    assert sorted((r["name"], r.age) for r in got) == [("x", 1), ("y", 2)]
    (tmp_path / "t.tsv").write_text('name\tage\n"q\t3\n')
    assert csv.read(spark, Person, csv.TSV).file(str(tmp_path / "t.tsv")).collect()[0]["name"] == '"q'
    assert csv.read(spark, Person).url((tmp_path / "2.csv").as_uri()).collect()[0].age == 2


def test_csv_writer_bytes(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1, ("x", None)), ('q"', None, ("", 2.5))], "theName string, n int, r struct<p:string,q:double>").coalesce(1)
    out = io.StringIO()
    csv.write_file(df, out, csv.Options(naming=naming.snake_case))
    assert out.getvalue() == 'the_name,n,p,q\r\n"a,b",1,x,\r\n"q""",,,2.5\r\n'
    out = io.StringIO()
    csv.write_file(df, out, csv.Options(quoting=csv.QUOTE_ALL, terminator="\n"))
    assert out.getvalue().splitlines()[1] == '"a,b","1","x",""'
    csv.write(df, str(tmp_path / "d"), csv.Options(quoting=csv.QUOTE_NON_NUMERIC, terminator="\n"))
    assert next((tmp_path / "d").glob("part*")).read_text() == '"a,b",1,"x",\n"q""",,"",2.5\n'
    out = io.StringIO()
    csv.write_file(df.where("false"), out)
    assert out.getvalue() == "theName,n,p,q\r\n"
    with pytest.raises(ValueError):
        csv.write_file(spark.createDataFrame([(1, (2,))], "a int, r struct<a:int>"), io.StringIO())


def test_json(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", None)], "name string, age bigint").coalesce(1)
    out = io.StringIO()
    json.write_file(df, out)
    assert out.getvalue() == '{"name":"x","age":1}\r\n{"name":"y","age":null}\r\n'
    out = io.StringIO()
    json.write_file(df, out, lines=False, terminator="\n")
    assert out.getvalue().startswith('[\n{\n   "name" : "x",') and out.getvalue().endswith("\n]")
    assert json.read_string(spark, Person, out.getvalue(), lines=False).collect() == df.collect()
    out = io.StringIO()
    json.write_file(df.where("false"), out, lines=False)
    assert out.getvalue() == "[]"
    json.write(df, str(tmp_path / "j"))
    assert sorted(json.read(spark, Person, str(tmp_path / "j")).collect()) == sorted(df.collect(), key=str)
    with pytest.raises(Exception, match="Malformed|CANNOT_PARSE"):
        json.read_string(spark, Person, '{"name": "x", "age": "old"}\n').collect()


def test_excel_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("anvil", 84000, dt.date(2020, 2, 29), False, None), ("<&>", 310, dt.date(2019, 12, 31), True, (str(SEAL), dt.datetime(2020, 1, 1, 23, 59)))],
        "label string, weightInGrams bigint, packedOn date, fragile boolean, seal struct<code:string,closedAt:timestamp_ntz>",
    )
    wanted = df.select(F.struct("label", "weightInGrams", "packedOn", "fragile").alias("load"), "seal")
    style = html.Styling().for_all_headers({"font-weight": "bold", "background-color": "FFFF00"}).for_field("label", {"color": "ff0000"})
    path = str(tmp_path / "a.xlsx")
    excel.write_file(wanted, path, sheet="Crates", header=True, naming=naming.with_spaces_capitalize, styling=style)
    named = excel.read(spark, Crate).option(by_name=True, naming=naming.with_spaces_capitalize, sheet="Crates").file(path)
    assert sorted(named.collect(), key=str) == sorted(wanted.collect(), key=str)
    excel.write_file(wanted, path)
    assert sorted(excel.read(spark, Crate).file(path).collect(), key=str) == sorted(wanted.collect(), key=str)
    with open(path, "rb") as book:
        assert excel.read(spark, Crate).option(sheet=lambda names: names[-1]).bytes(book.read()).count() == excel.read(spark, Crate).url(f"file://{path}").count() == 2
    with zipfile.ZipFile(path) as z:
        assert "xl/worksheets/sheet1.xml" in z.namelist()


def test_excel_formulas(spark, tmp_path):
    path = tmp_path / "f.xlsx"
    excel.write_file(spark.createDataFrame([("x", 1)], "name string, age bigint"), str(path))
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    sheet = "xl/worksheets/sheet1.xml"
    parts[sheet] = parts[sheet].replace(b"<v>1</v>", b"<f>A1+0</f><v>7</v>")
    with zipfile.ZipFile(path, "w") as z:
        for n, b in parts.items():
            z.writestr(n, b)
    assert excel.read(spark, Person).option(evaluate_formulas=True).file(str(path)).collect()[0].age == 7
    with pytest.raises(PySparkException):
        excel.read(spark, Person).file(str(path)).collect()


def test_html(spark):
    rows = [(True, [(1997, 5.0, [("x", "Ann")]), (1922, 2.0, [("y", "<Bo>"), ("z", None)])])]
    df = spark.createDataFrame(rows, "isProgrammer boolean, stats array<struct<birthYear:int,avg:double,records:array<struct<id:string,name:string>>>>")
    out = io.StringIO()
    html.write_file(df, out)
    head = "<tr><th>isProgrammer</th><th>birthYear</th><th>avg</th><th>id</th><th>name</th></tr>"

    def row(*cells):
        return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"

    body = row("true", "", "", "", "") + row("", 1997, 5.0, "", "") + row("", "", "", "x", "Ann") + row("", 1922, 2.0, "", "") + row("", "", "", "y", "&lt;Bo&gt;") + row("", "", "", "z", "")
    assert out.getvalue() == f"<html><head></head><body><table>{head}{body}</table></body></html>"
    style = html.Styling(default_field={"border": "1px"}).for_header("stats[].birthYear", {"background-color": "green"}).for_field("stats[].records[].id", {"color": "red"})
    out = io.StringIO()
    html.write_file(df, out, naming=naming.with_spaces_capitalize, styling=style, tr_tag=html.Tag("tr", {"border": "0"}))
    assert '<th style="background-color: green;">Birth Year</th>' in out.getvalue() and '<td style="color: red;">x</td>' in out.getvalue() and '<td style="border: 1px;"></td>' in out.getvalue()


@pytest.mark.parametrize(
    ("pattern", "path", "fits"),
    [("*.csv", "a.csv", True), ("*.csv", "a/b.csv", False), ("/d/**/x?.csv", "/d/x1.csv", True), ("/d/**/x?.csv", "/d/e/f/x1.csv", True), ("/d/**", "/d/e/f", True), ("a{1,2}.[x]", "a2.[x]", True), ("a,b", "a,b", True), ("a{1,2}", "a3", False)],
)
def test_globs(pattern, path, fits):
    assert bool(re.fullmatch(files.glob_expression(pattern), path)) == fits


def test_parser_with_its_own_error(spark):
    def price(c):
        value = F.regexp_replace(c, "[^0-9.]", "").try_cast("decimal(38,18)")
        return value, F.when(value.isNull(), F.concat(F.lit("no price in "), c)).when(value > 99, "too dear")

    reader = csv.read(spark, Painted).parser("price", price).lenient()
    got = reader.string("color,price\nRED,$ 5\nRED,gratis\nBLUE,100\n").collect()
    assert [list(r.errors) for r in got] == [[], ["price: no price in gratis"], ["price: too dear"]]


def test_styles_add_to_defaults():
    style = html.Styling().for_all_fields({"color": "red"}).add_field("a.b[].price", {"font-weight": "bold"}).add_header("price", {"color": "blue"})
    assert style.of_field("price") == {"color": "red", "font-weight": "bold"} and style.of_field("other") == {"color": "red"} and style.of_header("price") == {"color": "blue"}
