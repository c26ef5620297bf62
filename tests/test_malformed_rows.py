import random
import re

import pytest
from sparkloom.operators.malformed_rows import ENTERPRISE_SURVEY, Field, RowGrammar, loaded, parse_records, refused

SCHEMA = "line_id bigint, file_name string, line_no int, raw_line string"


def split(line):
    """Fields of a record by hand, or None if its quotes are wrong."""
    fields, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            at, text = at + 1, ""
            while True:
                end = line.find('"', at)
                if end < 0:
                    return None
                text += line[at:end]
                at = end + 1
                if line[at : at + 1] != '"':
                    break
                text, at = text + '"', at + 1
            if at < len(line) and line[at] != ",":
                return None
        else:
            end = line.find(",", at)
            end = len(line) if end < 0 else end
            text, at = line[at:end], end
            if '"' in text:
                return None
        fields.append(text)
        if at == len(line):
            return fields
        at += 1


def reason(line):
    f = split(line)
    if f is None:
        return "quotes"
    if len(f) != 7:
        return "columns"
    if not re.fullmatch(r"19[0-9]{2}|20[0-9]{2}|2100", f[0].strip()):
        return "year"
    v = f[5].strip()
    if v not in ("", "C", "S") and not re.fullmatch(r"[+-]?(([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]+)?|\.[0-9]+)([eE][+-]?[0-9]+)?", v):
        return "value"
    return None


CASES = [
    '2010,A1,name,ALL,Var,1,kg', '2010,A1,"na, ""x""",ALL,Var,"1,234.5",kg', '2010,A1,name,ALL,Var,1,234,kg', '1899,A1,n,ALL,V,1,kg', '2101,A1,n,ALL,V,1,kg',
    '2100,A1,n,ALL,V,.5e-3,kg', ' 2010 ,A1,n,ALL,V, C ,kg', '"2010",A1,n,ALL,V,"",', ' "2010",A1,n,ALL,V,1,kg', '2010,A1,"open,ALL,V,1,kg', '2010,A1,"x"y,ALL,V,1,kg',
    '2010,A1,n,ALL,V,12.,kg', '2010,A1,n,ALL,V,NaN,kg', '2010,A1,n,ALL,V,12 3,kg', '2010,A1,"two\nlines",ALL,V,1,kg', '２０１０,A1,n,ALL,V,1,kg', ',,,,,,', '2010', '"', '""', '"",',
    '2010,A1,n,ALL,V,"517,76,0",kg', '2010,A1,n,ALL,V,+1,234,kg', '2010,A1,n,ALL,V,c,kg', '2010,A1,n,ALL,V,1,"kg', '2010,A1,n,ALL,V,1,kg,"', '20100,A1,n,ALL,V,1,kg',
]


def test_cases(spark):
    rows = [(i, "f", i + 2, c) for i, c in enumerate(CASES)]
    got = {r.line_id: r.reason for r in parse_records(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: reason(c) for i, c in enumerate(CASES)}


def test_random_records_against_a_parser(spark):
    rng = random.Random(1)
    parts = ['2010', '"', '""', ",", "1,000", " ", "x", "\n", "C", "1e5", "-", ".", '","', "1999", "kg"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 16))) for _ in range(3000)]
    lines += [",".join(rng.choice(parts) for _ in range(7)) for _ in range(3000)]
    lines = [x for x in lines if x.strip()]
    df = spark.createDataFrame([(i, "f", 5, x) for i, x in enumerate(lines)], SCHEMA)
    got = {r.line_id: r.reason for r in parse_records(df).collect()}
    assert got == {i: reason(x) for i, x in enumerate(lines)}


def test_defined_results(spark):
    rows = [(1, "f", 1, "year,x"), (2, "f", 2, None), (3, "f", 3, " \t "), (4, "f", None, "bad"), (5, "f", 2, "bad"), (5, "f", 2, "bad"), (None, None, 2, "2010,A,b,c,d,1,e")]
    parsed = parse_records(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.line_id for r in refused(parsed).collect()) == [4, 5, 5]
    assert [r.line_id for r in loaded(parsed).collect()] == [None]
    assert parse_records(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_field(spark):
    long = '2010,A,"' + 'x""' * 300_000 + '",ALL,V,1,kg'
    rows = [(1, "f", 2, long), (2, "f", 3, long[:-9])]
    got = {r.line_id: r.reason for r in parse_records(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] is None and got[2] is not None


def test_clashing_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, 2, "bad", "x", "y")], "line_id bigint, line_no int, raw_line string, reason string, _raw string")
    assert [tuple(r) for r in refused(parse_records(df)).collect()] == [(1, "columns", "industry_code_anzsic", "bad")]


def test_broken_field_and_contents(spark):
    rows = [(1, "f", 2, '2010,A,"x"y,b,c,1,d'), (2, "f", 2, "2010,A,n,b,c,x,d"), (3, "f", 2, '1990,"A ""q""",n,b,c,"1,000",d')]
    parsed = parse_records(spark.createDataFrame(rows, SCHEMA))
    assert {r.line_id: r.broken_field for r in refused(parsed).collect()} == {1: "industry_name_anzsic", 2: "value"}
    row = loaded(parsed).collect()[0]
    assert (row.year, row.industry_code_anzsic, row["value"]) == (1990, 'A "q"', "1,000")


@pytest.mark.parametrize("n", [1, 3])
def test_other_schemas(spark, n):
    fields = tuple(Field(f"f{i}", r"[0-9]+", "number", "int") for i in range(n))
    assert RowGrammar(fields).row.endswith(r"\z") and len(ENTERPRISE_SURVEY) == 7
    df = spark.createDataFrame([(1, ",".join("7" * n)), (2, ",".join("x" * n))], "line_id bigint, raw string")
    got = {r.line_id: r.reason for r in parse_records(df, fields, "raw", None).collect()}
    assert got == {1: None, 2: "number"}
