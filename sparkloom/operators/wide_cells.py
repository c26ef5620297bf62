"""Attribute-value rows into wide tables by log-structured upserts.

Rows of a batch become sparse wide deltas: per entity a map from attribute to cell, each cell with the version
of its latest value and the least and greatest value seen. Deltas are stored as runs that are only appended to, in buckets by
entity and sorted by entity and batch; compaction merges the runs of an entity cell by cell: the latest version wins, the range of values
widens. A cell whose least and greatest value differ has contradicted itself. Merging is associative, commutative and
idempotent, so batches may arrive late or twice, be compacted in any grouping, or be merged with an earlier result.

Scale: rows are first combined per entity, attribute and batch (map-side combined, so one entity may hold any
share of the rows); what is then gathered by entity is bounded by attributes times batches. Runs are written once; compaction and the
wide row read them bucket by bucket without another shuffle.

Defined results: rows with a null key, or a variable that names no attribute, are left out; missing values
(null or marked) neither set nor contradict a cell; a cell with missing values only is null in the wide row; a value
that does not read as its type is compared as squeezed text and null in the typed column; equal versions are
ordered by row id, then value; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import code_key, is_missing, number_in, squeezed, trimmed
from sparkloom.operators.unit_harmonise import with_attribute
from sparkloom.runtime import shared_path, source_bytes

ENTITY = ("year", "industry_code_anzsic", "rme_size_grp")
#: Bytes of input per bucket of stored runs, and how many buckets there are at most.
BUCKET_BYTES, MOST_BUCKETS = 1 << 27, 100_000
_CELL = ("version", "text", "least", "greatest")

# Month names and the spellings of booleans.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
TRUE, FALSE = ("yes", "y", "true", "1"), ("no", "n", "false", "0")


_DATE = r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/. ]\d{1,2}[-/. ]\d{4}|\d{1,2}[-. ]*[a-z]{3}[a-z]*[-., ]*\d{4}"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once; keeps large expressions out of one generated method, which the JVM would interpret."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def iso_date(c: Column) -> Column:
    """A date text as ``YYYY-MM-DD``: ISO, day before month with points, strokes or blanks, or with a month's name."""

    def put(parts: Column) -> Column:
        iso = F.length(F.get(parts, F.lit(0))) == 4
        year, day = F.when(iso, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(2))), F.when(iso, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(0)))
        name = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(F.get(parts, F.lit(1)), 1, 3))
        month = F.when(name > 0, name.cast("string")).when(F.get(parts, F.lit(1)).rlike(r"^\d+$"), F.get(parts, F.lit(1)))
        return F.when(month.isNotNull(), F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))

    t = F.lower(trimmed(c))
    apart = F.regexp_replace(t, r"[-/., ]+|(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d)", " ")
    return F.when(t.rlike(rf"^(?:{_DATE})$"), _with(F.split(apart, " "), put))


def canonical(value: Column, value_type: Column) -> Column:
    """The value as text that is equal exactly if the values are equal as their type; null if missing."""
    known = F.create_map(*[F.lit(x) for words, truth in ((TRUE, "true"), (FALSE, "false")) for w in words for x in (w, truth)])
    plain = _with(squeezed(value), lambda p: F.coalesce(F.when(value_type == "boolean", F.try_element_at(known, p)), p))
    as_type = F.when(value_type == "decimal", (number_in(value) + F.lit(0.0)).cast("string")).when(value_type == "date", iso_date(value))
    return F.when(~is_missing(value), F.coalesce(as_type, plain))


def cells_of(rows: DataFrame, attributes: DataFrame, batch: Column | None = None) -> DataFrame:
    """One row per input row that sets a cell: the entity, batch, attr_code, version, text, least, greatest."""
    at = F.date_trunc("month", F.col("loaded_at")) if batch is None else batch
    named = with_attribute(rows.select("row_id", *ENTITY, "variable", "value", "loaded_at", at.alias("_batch")), attributes)
    told = named.where(~is_missing(F.col("value")) & F.col("year").isNotNull() & (trimmed(F.col(ENTITY[1])) != "") & (trimmed(F.col(ENTITY[2])) != ""))
    cells = told.select(
        F.col("year"),
        code_key(F.col("industry_code_anzsic")).alias("industry_code_anzsic"),
        code_key(F.col("rme_size_grp")).alias("rme_size_grp"),
        F.col("_batch").alias("batch"),
        "attr_code",
        F.struct(F.col("loaded_at").alias("at"), "row_id").alias("version"),
        canonical(F.col("value"), F.col("value_type")).alias("text"),
    )
    same = F.lit(None).cast("string")
    return cells.withColumns({"least": same, "greatest": same})


def _merge(cells: DataFrame, *by: str) -> DataFrame:
    """Merge cells: the text of the latest version, the range of values (null where it is the text itself)."""
    merged = cells.groupBy(*by).agg(
        F.max(F.struct("version", "text")).alias("latest"),
        F.min(F.coalesce("least", "text")).alias("least"),
        F.max(F.coalesce("greatest", "text")).alias("greatest"),
    )
    text = F.col("latest.text")
    return merged.select(*by, F.col("latest.version").alias("version"), text.alias("text"), F.nullif(F.col("least"), text).alias("least"), F.nullif(F.col("greatest"), text).alias("greatest"))


def differs() -> Column:
    """Whether a merged cell was given different values."""
    return F.col("least").isNotNull() | F.col("greatest").isNotNull()


def deltas(cells: DataFrame, buckets: int | None = None) -> DataFrame:
    """Sparse wide deltas: per entity and batch a map from attr_code to its cell."""
    per_cell = _merge(cells, *ENTITY, "batch", "attr_code")
    return (
        per_cell.repartition(*([buckets] if buckets else []), *[F.col(e) for e in ENTITY])
        .groupBy(*ENTITY, "batch")
        .agg(F.map_from_entries(F.collect_list(F.struct("attr_code", F.struct(*_CELL)))).alias("cells"))
    )


def sorted_run(delta: DataFrame) -> DataFrame:
    """Deltas in the order in which a run is stored."""
    return delta.sortWithinPartitions(*ENTITY, "batch")


def stored_runs(cells: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The deltas of ``cells`` as sorted runs in the shared folder, one bucket of entities per file; written when called."""
    spark = cells.sparkSession
    buckets = min(max(spark.sparkContext.defaultParallelism, source_bytes(cells) // bucket_bytes), MOST_BUCKETS)
    name = f"sparkloom_{uuid.uuid4().hex}"
    # Spark sorts each file by entity and batch as it writes it
    deltas(cells, buckets).write.bucketBy(buckets, *ENTITY).sortBy(*ENTITY, "batch").option("path", shared_path(spark, "runs", name)).saveAsTable(name)
    return spark.table(name)


def compact(runs: DataFrame) -> DataFrame:
    """Merge runs of deltas (any union of them) cell by cell: the entity, attr_code, version, text, least, greatest (null where they are the text)."""
    opened = runs.select(*ENTITY, F.explode("cells").alias("attr_code", "cell")).select(*ENTITY, "attr_code", "cell.*")
    return _merge(opened, *ENTITY, "attr_code")


def as_run(compacted: DataFrame, batch: Column) -> DataFrame:
    """A compacted result as one run again, to be merged with later deltas."""
    return deltas(compacted.withColumn("batch", batch))


def contradictions(compacted: DataFrame) -> DataFrame:
    """Cells that were given two or more different values."""
    return compacted.where(differs()).select(*ENTITY, "attr_code")


def wide(compacted: DataFrame, attributes: DataFrame, limit: int = 5_000) -> DataFrame:
    """One row per entity with a typed column per attribute (its latest value) and ``contradicted``, the attributes
    with differing values in order of their code.

    The attribute list becomes columns, so it is read to the driver; more than ``limit`` attributes are an error.
    """
    listed = attributes.select("attr_code", "value_type").distinct().orderBy("attr_code").limit(limit + 1).collect()
    if len(listed) > limit:
        raise ValueError(f"more than {limit} attributes can't be columns")
    types = {"decimal": "double", "date": "date", "boolean": "boolean"}
    columns = [
        F.max(F.when(F.col("attr_code") == r.attr_code, F.col("text"))).try_cast(types.get(r.value_type, "string")).alias(r.attr_code)
        for r in listed
    ]
    differing = F.sort_array(F.collect_set(F.when(differs(), F.col("attr_code"))))
    return compacted.groupBy(*ENTITY).agg(*columns, differing.alias("contradicted"))
