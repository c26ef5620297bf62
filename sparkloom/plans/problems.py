"""Queries of the general data problems, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import code_key
from sparkloom.operators import malformed_rows, orphan_references, trailing_totals, unit_harmonise, wide_cells
from sparkloom.operators.orphan_references import Keyed, Reference
from sparkloom.runtime import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Refused records of survey_raw with the reason."""
    return malformed_rows.refused(malformed_rows.parse_records(table(spark, root, "survey_raw"))).select("line_id", "reason")


def p1_loaded(spark: SparkSession, root: str) -> DataFrame:
    """Loaded records of survey_raw as rows of the schema."""
    return malformed_rows.loaded(malformed_rows.parse_records(table(spark, root, "survey_raw")))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Days on which a customer's last week makes up most of a large month."""
    segments = trailing_totals.trailing_segments(trailing_totals.current_orders(table(spark, root, "sales_order")), (7, 30))
    week, month = F.col("total_7"), F.col("total_30")
    peaks = segments.where((week > 0) & (month >= 200_000) & (week * 100 >= month * 60))
    return trailing_totals.days_of(peaks).select(F.col("entity").alias("customer_id"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def p2_daily(spark: SparkSession, root: str) -> DataFrame:
    """Totals and averages of the last 7 and 30 days per customer and day."""
    return trailing_totals.trailing_totals(table(spark, root, "sales_order"))


def _survey_cells(spark: SparkSession, root: str) -> DataFrame:
    cells = wide_cells.cells_of(table(spark, root, "enterprise_survey"), table(spark, root, "survey_attribute"))
    return wide_cells.compact(wide_cells.stored_runs(cells))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Cells of the wide table that were given different values."""
    return wide_cells.contradictions(_survey_cells(spark, root))


def p3_wide(spark: SparkSession, root: str) -> DataFrame:
    """One row per year, industry code and size group with a typed column per attribute."""
    out = wide_cells.wide(_survey_cells(spark, root), table(spark, root, "survey_attribute"))
    return out.withColumn("contradicted", F.array_join("contradicted", ","))


def _sales_orphans(spark: SparkSession, root: str) -> DataFrame:
    """The cascade over order_detail, its products and orders, and the customers of orders.

    A customer is there if an order that stands, in its latest version, is theirs, under the id without stray blanks and
    case; orders refer to it as they are written.
    """
    orders, details, products = (table(spark, root, t) for t in ("sales_order", "order_detail", "product_ref"))
    latest = orders.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("loaded_at", "deleted_at", "customer_id")).alias("o"))
    customers = latest.where(F.col("o.deleted_at").isNull()).select(code_key(F.col("o.customer_id")).alias("customer_id"))
    tables = [
        Keyed("customer", customers, "customer_id"),
        Keyed("sales_order", orders, "id", orphan_references.first_to_last(orders, "id", "loaded_at", "deleted_at"), single=True),
        Keyed("product_ref", products, "product_id", orphan_references.every_span(products, "product_id", "created_at", "deleted_at")),
        Keyed("order_detail", details, "id"),
    ]
    at = F.col("loaded_at")
    references = [("sales_order", "customer_id", "customer"), ("order_detail", "order_id", "sales_order"), ("order_detail", "product_id", "product_ref")]
    return orphan_references.orphan_cascade(tables, [Reference(*r, at) for r in references])


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Details whose order or product wasn't there when they were loaded."""
    direct = _sales_orphans(spark, root).where((F.col("table_name") == "order_detail") & ~F.col("inherited"))
    return direct.select(F.col("id").alias("detail_id"), "field_name", "kind").distinct()


def p4_report(spark: SparkSession, root: str) -> DataFrame:
    """Orphans per table, month, field and kind, direct and inherited ones."""
    return orphan_references.orphan_report(_sales_orphans(spark, root))


def _harmonised(spark: SparkSession, root: str) -> DataFrame:
    return unit_harmonise.harmonise(*(table(spark, root, t) for t in ("enterprise_survey", "survey_attribute", "unit_reference")))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows recorded in another unit than the common one."""
    return unit_harmonise.in_other_unit(_harmonised(spark, root))


def p6_values(spark: SparkSession, root: str) -> DataFrame:
    """Every decimal value in the common unit of its attribute."""
    return _harmonised(spark, root).select("row_id", "attr_code", F.round("common_value", 6).alias("common_value"), "common_unit")


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p2_found, p2_daily, p3_found, p3_wide, p4_found, p4_report, p6_found, p6_values)}

_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_NUM = r"[+-]?(?:(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_TRIM = r"^[\s\p{Z}]+|[\s\p{Z}]+$"

_P1 = rf"""
split AS (SELECT line_id, raw_line AS raw, regexp_matches(raw_line, '\A{_FIELD}(?:,{_FIELD})*\z') AS well,
                 regexp_extract_all(',' || raw_line, ',({_FIELD})', 1) AS w
          FROM survey_raw WHERE coalesce(line_no <> 1, true) AND regexp_matches(raw_line, '[^\s\p{{Z}}]')),
cells AS (SELECT line_id, raw, well, list_transform(w, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS c FROM split),
judged AS (SELECT *, regexp_replace(c[1], '{_TRIM}', '', 'g') AS y, regexp_replace(c[6], '{_TRIM}', '', 'g') AS v,
    CASE WHEN NOT well THEN 'quotes' WHEN len(c) <> 7 THEN 'columns'
         WHEN NOT regexp_full_match(regexp_replace(c[1], '{_TRIM}', '', 'g'), '19[0-9][0-9]|20[0-9][0-9]|2100') THEN 'year'
         WHEN NOT regexp_full_match(regexp_replace(c[6], '{_TRIM}', '', 'g'), '(?:[CS]|{_NUM})?') THEN 'value' END AS reason FROM cells)"""

_P2 = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn FROM sales_order WHERE id IS NOT NULL) WHERE rn = 1),
daily AS (SELECT upper(trim(customer_id)) AS customer_id, order_date AS d, sum(CAST(round(freight * 100) AS BIGINT)) AS c, count(*) AS n FROM latest
          WHERE deleted_at IS NULL AND customer_id IS NOT NULL AND order_date IS NOT NULL AND freight IS NOT NULL AND NOT isnan(freight) GROUP BY ALL),
held AS (SELECT customer_id, d + CAST(o AS INTEGER) AS day, CAST(sum(c) FILTER (WHERE o < 7) AS BIGINT) AS t7, CAST(sum(c) AS BIGINT) AS t30,
                coalesce(CAST(sum(n) FILTER (WHERE o < 7) AS BIGINT), 0) AS n7, CAST(sum(n) AS BIGINT) AS n30
         FROM daily, range(30) r(o) GROUP BY ALL),
calendar AS (SELECT customer_id, CAST(unnest(generate_series(min(d), max(d) + 29, INTERVAL 1 DAY)) AS DATE) AS day FROM daily GROUP BY 1),
days AS (SELECT customer_id, day, coalesce(t7, 0) AS t7, coalesce(t30, 0) AS t30, coalesce(n7, 0) AS n7, coalesce(n30, 0) AS n30 FROM calendar LEFT JOIN held USING (customer_id, day))"""

_P3 = rf"""
a AS (SELECT attr_code, value_type, regexp_replace(lower(attr_name), '[^\p{{L}}]+', '', 'g') AS k FROM survey_attribute),
e AS (SELECT *, regexp_replace(lower(regexp_replace(variable, '(\s*[;\[(]|,\s*in\s|\s+-|-\s).*$', '')), '[^\p{{L}}]+', '', 'g') AS cut,
             regexp_replace(lower(variable), '[^\p{{L}}]+', '', 'g') AS whole FROM enterprise_survey),
m AS (SELECT e.year, upper(trim(e.industry_code_anzsic)) AS industry_code_anzsic, upper(trim(e.rme_size_grp)) AS rme_size_grp, a.attr_code, a.value_type,
             e.row_id, e.loaded_at, trim(e.value) AS v, lower(regexp_replace(trim(e.value), '\s+', ' ', 'g')) AS plain
      FROM e JOIN a ON a.k = e.whole OR (a.k = e.cut AND e.whole NOT IN (SELECT k FROM a))
      WHERE e.value IS NOT NULL AND upper(trim(e.value)) NOT IN ('', 'C', 'S', '..', 'N/A') AND e.year IS NOT NULL
        AND nullif(trim(e.industry_code_anzsic), '') IS NOT NULL AND nullif(trim(e.rme_size_grp), '') IS NOT NULL),
typed AS (SELECT *, CASE WHEN value_type = 'decimal' THEN CAST(TRY_CAST(replace(regexp_extract(v, '{_NUM}'), ',', '') AS DOUBLE) + 0.0 AS VARCHAR)
             WHEN value_type = 'date' THEN strftime(coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%d.%m.%Y'), try_strptime(v, '%d %b %Y')), '%Y-%m-%d')
             WHEN value_type = 'boolean' THEN CASE WHEN plain IN ('yes', 'y', 'true', '1') THEN 'true' WHEN plain IN ('no', 'n', 'false', '0') THEN 'false' END
             END AS t FROM m),
cells AS (SELECT *, coalesce(t, plain) AS text FROM typed)"""


def _p3_wide_sql() -> str:
    kinds = {"decimal": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN", "string": "VARCHAR"}
    codes = [f"V{k:02d}" for k in range(1, 39)]
    type_of = {**dict.fromkeys(codes[:31], "decimal"), "V32": "date", "V33": "date", "V34": "boolean", "V35": "boolean", "V36": "boolean", "V37": "string", "V38": "string"}
    columns = ", ".join(f"TRY_CAST(max(CASE WHEN attr_code = '{c}' THEN text END) AS {kinds[type_of[c]]}) AS {c}" for c in codes)
    return rf"""WITH {_P3.strip()},
cell AS (SELECT year, industry_code_anzsic, rme_size_grp, attr_code, arg_max(text, (loaded_at, row_id)) AS text, min(text) <> max(text) AS differs FROM cells GROUP BY ALL)
SELECT year, industry_code_anzsic, rme_size_grp, {columns},
       coalesce(string_agg(CASE WHEN differs THEN attr_code END, ',' ORDER BY attr_code), '') AS contradicted FROM cell GROUP BY ALL"""


_P4 = """
latest AS (SELECT id, arg_max(struct_pack(u := deleted_at, c := customer_id), struct_pack(a := loaded_at, d := coalesce(deleted_at, TIMESTAMP '0001-01-01'), c := coalesce(customer_id, ''))) AS o
           FROM sales_order WHERE id IS NOT NULL GROUP BY 1),
spans AS (SELECT 'sales_order' AS parent, CAST(id AS VARCHAR) AS key, min(loaded_at) AS f, arg_max(struct_pack(d := deleted_at), struct_pack(a := loaded_at)).d AS u
          FROM sales_order WHERE id IS NOT NULL GROUP BY 2
          UNION ALL SELECT 'product_ref', CAST(product_id AS VARCHAR), created_at, deleted_at FROM product_ref
          UNION ALL SELECT DISTINCT 'customer', upper(trim(o.c)), TIMESTAMP '0001-01-01', NULL FROM latest WHERE o.u IS NULL AND trim(o.c) <> ''),
refs AS (SELECT DISTINCT 'order_detail' AS table_name, id, 'order_id' AS field_name, CAST(order_id AS VARCHAR) AS key, loaded_at AS t, 'sales_order' AS parent FROM order_detail WHERE order_id IS NOT NULL
         UNION ALL SELECT DISTINCT 'order_detail', id, 'product_id', CAST(product_id AS VARCHAR), loaded_at, 'product_ref' FROM order_detail WHERE product_id IS NOT NULL
         UNION ALL SELECT DISTINCT 'sales_order', CAST(id AS VARCHAR), 'customer_id', customer_id, loaded_at, 'customer' FROM sales_order WHERE customer_id IS NOT NULL),
judged AS (SELECT r.table_name, r.id, r.field_name, r.key, r.t, count(s.key) AS n, min(s.f) AS f, coalesce(bool_or(s.f <= r.t AND (s.u IS NULL OR r.t < s.u)), false) AS live
           FROM refs r LEFT JOIN spans s ON s.parent = r.parent AND s.key = r.key GROUP BY 1, 2, 3, 4, 5),
cascade(table_name, id, field_name, key, t, kind, inherited, round) AS (
    SELECT table_name, id, field_name, key, t, CASE WHEN n = 0 THEN 'missing' WHEN t < f THEN 'later' ELSE 'deleted' END, false, 0 FROM judged WHERE NOT live
    UNION SELECT r.table_name, r.id, r.field_name, r.key, r.t, 'orphaned', true, c.round + 1 FROM refs r JOIN cascade c ON c.table_name = r.parent AND c.id = r.key),
orphans AS (SELECT * FROM cascade QUALIFY round = min(round) OVER (PARTITION BY table_name, id, field_name, key))"""


# For the SQL, per quantity and unit code what its texts look like in lower case without blanks, the first that fits.
_UNIT_PATTERNS = {
    "money": {"BDOL": r"bil|bn|\$b|b\$|1,000,000,000", "MDOL": r"mil|mn|\$m|m\$|1,000,000", "KDOL": r"thou|000|k", "DOL": r"dol|\$"},
    "mass": {"KT": r"kilotonne|^kt$|thousand|000", "KG": r"kilo|kg", "LB": r"pound|lb", "T": r"ton|^t$"},
    "area": {"SQKM": r"km|kilomet", "SQM": r"sq.*met|^m[2²]$|sqm$", "HA": r"hect|^ha$", "ACRE": r"acre|^ac$"},
    "energy": {"MWH": r"mega|^mwh$", "KWH": r"kilo|^kwh$", "GWH": r"gigaw|^gwh$", "GJ": r"gigaj|^gj$", "TJ": r"tera|^tj$"},
    "distance": {"KKM": r"thousand|000", "KM": r"km|kilom", "MI": r"mi"},
    "volume": {"MLT": r"mega|^ml$|million", "LTR": r"lit|ltr|^l$", "CUM": r"cu|m[3³]"},
    "persons": {"KPERS": r"thousand|000", "PERS": r"pers|people|number|count"},
    "share": {"PML": r"mille|thousand|‰", "BP": r"basis|^bps?$", "FRAC": r"frac|prop|of1|ratio", "PCT": r"cent|pct|%"},
    "time": {"MIN": r"min", "DAYS": r"day|^d$", "HR": r"h"},
}


def _p6_sql(tail: str) -> str:
    def unit_of(text: str) -> str:
        squeezed = rf"regexp_replace(lower({text}), '[\s\p{{Z}}()\[\]]', '', 'g')"
        cases = " ".join(f"WHEN quantity = '{q}' AND regexp_matches({squeezed}, '{p}') THEN '{code}'" for q, units in _UNIT_PATTERNS.items() for code, p in units.items())
        return f"CASE {cases} END"

    return rf"""WITH
a AS (SELECT *, regexp_replace(lower(attr_name), '[^\p{{L}}]+', '', 'g') AS k FROM survey_attribute),
v AS (SELECT DISTINCT variable, regexp_extract(variable, '^(.*?)(?:\s*[;\[(]\s*|,\s*in\s+|\s+-\s*|-\s+)(.*)$', ['name', 'note']) AS p FROM enterprise_survey),
n AS (SELECT v.variable, a.attr_code, a.common_unit, a.quantity,
             CASE WHEN regexp_replace(lower(v.variable), '[^\p{{L}}]+', '', 'g') = a.k AND regexp_matches(p.note, '\p{{L}}') THEN '' ELSE p.note END AS note
      FROM v JOIN a ON a.k = coalesce((SELECT k FROM a b WHERE b.k = regexp_replace(lower(v.variable), '[^\p{{L}}]+', '', 'g')), regexp_replace(lower(p.name), '[^\p{{L}}]+', '', 'g'))
      WHERE a.value_type = 'decimal'),
m AS (SELECT e.row_id, n.*, e.value, e.unit, coalesce(upper(trim(e.value)) IN ('', 'C', 'S', '..', 'N/A'), true) AS missing,
             regexp_extract(e.value, '^(.*?)({_NUM})(.*)$', ['before', 'number', 'behind']) AS x FROM enterprise_survey e JOIN n USING (variable)),
t AS (SELECT *, CASE WHEN NOT missing THEN TRY_CAST(replace(x.number, ',', '') AS DOUBLE) * CASE WHEN starts_with(ltrim(x.before), '-') THEN -1 ELSE 1 END END AS number,
             coalesce({unit_of("unit")}, {unit_of("x.before || x.behind")}, {unit_of("note")}, common_unit) AS unit_code FROM m),
j AS (SELECT t.*, u.factor_to_common AS factor FROM t JOIN unit_reference u USING (unit_code, quantity))
{tail}"""


SQL = {
    "p1_found": f"WITH {_P1.strip()} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_loaded": f"""WITH {_P1.strip()} SELECT line_id, CAST(y AS INTEGER) AS year, c[2] AS industry_code_anzsic, c[3] AS industry_name_anzsic, c[4] AS rme_size_grp,
        c[5] AS variable, c[6] AS value, c[7] AS unit FROM judged WHERE reason IS NULL""",
    "p2_found": f"WITH {_P2.strip()} SELECT customer_id, strftime(day, '%Y-%m-%d') AS day FROM days WHERE t7 > 0 AND t30 >= 200000 AND t7 * 100 >= t30 * 60",
    "p2_daily": f"""WITH {_P2.strip()} SELECT customer_id, day, coalesce(t7, 0) / 100 AS total_7, round(coalesce(t7, 0) / (100 * 7), 6) AS avg_day_7,
        round(t7 / nullif(100 * n7, 0), 6) AS avg_order_7, n7 AS orders_7, t30 / 100 AS total_30, round(t30 / (100 * 30), 6) AS avg_day_30,
        round(t30 / nullif(100 * n30, 0), 6) AS avg_order_30, n30 AS orders_30 FROM days""",
    "p3_found": f"WITH {_P3.strip()} SELECT year, industry_code_anzsic, rme_size_grp, attr_code FROM cells GROUP BY ALL HAVING min(text) <> max(text)",
    "p3_wide": _p3_wide_sql(),
    "p4_found": f"WITH RECURSIVE {_P4.strip()} SELECT DISTINCT id AS detail_id, field_name, kind FROM orphans WHERE table_name = 'order_detail' AND NOT inherited",
    "p4_report": f"""WITH RECURSIVE {_P4.strip()} SELECT table_name, CAST(date_trunc('month', t) AS DATE) AS period, field_name, kind, inherited,
        count(*) AS orphan_references, count(DISTINCT id) AS orphan_records FROM orphans GROUP BY ALL""",
    "p6_found": _p6_sql("SELECT row_id FROM j WHERE NOT missing AND unit_code <> common_unit"),
    "p6_values": _p6_sql("SELECT row_id, attr_code, round(number * factor, 6) AS common_value, common_unit FROM j"),
}
