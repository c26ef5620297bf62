"""Queries of this subpackage's operators, with SQL where SQL gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import digests, packing, residue, winnowing
from sparkloom.runtime import cut, table

_GROUP = ["product_id", "period"]
_PERCENTS = (25, 50, 75, 90)


def _prices(spark: SparkSession, root: str) -> DataFrame:
    """id, product_id, month, day, unit_price of all details."""
    day = F.date_format("loaded_at", "yyyy-MM-dd")
    return table(spark, root, "order_detail").select("id", "product_id", F.substring(day, 1, 7).alias("month"), day.alias("day"), "unit_price")


def _price_digests(prices: DataFrame) -> DataFrame:
    """product_id, period, digest of every day and, merged from them, of every month."""
    values = digests.placed(prices, ["product_id", "month"], "unit_price", within="day", id_column="id", infinite=True)
    return digests.group_digests(values).select("product_id", F.coalesce("day", "month").alias("period"), "digest")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Published first quartiles that lie outside the 20th to 30th percentile of their product and period.

    The digests' certain rank bounds dismiss profiles that are surely right; the ranks of all others are counted.
    """
    prices = _prices(spark, root)
    profiles = (
        table(spark, root, "row_description")
        .where(F.col("field") == "unitPrice")
        .select("profile_id", *_GROUP, F.col("percentile25").try_cast("double").alias("point"))
        .where(F.col("point").isNotNull() & F.col("product_id").isNotNull() & F.col("period").isNotNull())
    )
    low, high = digests.nearest_rank(F.col("n"), 20), digests.nearest_rank(F.col("n"), 30)
    bounds = digests.rank_bounds(_price_digests(prices), _GROUP, profiles, "point")
    doubtful = cut(bounds.where(~((F.col("le_least") >= low) & (F.col("lt_most") < high))).select("profile_id", *_GROUP, "point"))
    wrong = []
    for period, length in (("day", 10), ("month", 7)):
        asked = doubtful.where(F.length("period") == length).withColumnRenamed("period", period)
        counts = digests.counted_ranks(prices, ["product_id", period], "unit_price", asked, "point", "id", infinite=True)
        wrong.append(asked.join(counts, ["product_id", period, "point"]).where((F.col("le") < low) | (F.col("lt") >= high)).select("profile_id"))
    return wrong[0].unionByName(wrong[1]).distinct()


def _percentiles(spark: SparkSession, root: str) -> DataFrame:
    prices = _prices(spark, root)
    estimates = cut(digests.percentiles(_price_digests(prices), _GROUP, _PERCENTS))
    held = []
    for period, length in (("day", 10), ("month", 7)):
        of = estimates.where(F.length("period") == length)
        values = prices.withColumnRenamed(period, "period")
        held.append(digests.certified(of, digests.counted_ranks(values, _GROUP, "unit_price", of, "estimate", "id", infinite=True), _GROUP))
    return held[0].unionByName(held[1])


def p5_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Quartiles and the 90th percentile of unit_price per product and day or month, with bounded and counted rank error."""
    return _percentiles(spark, root)


def p5_certified(spark: SparkSession, root: str) -> DataFrame:
    """Of every percentile the number of values, whether its counted rank error is within its bound, and whether that is at most 2 %."""
    bound = F.col("error_bound")
    return _percentiles(spark, root).select(*_GROUP, "percent", "n", (F.col("rank_error") <= bound).alias("within_bound"), (bound <= 0.02).alias("bound_holds"))


def p7_pack(spark: SparkSession, root: str) -> DataFrame:
    """Every text of documents in a container of 2,048 tokens."""
    return packing.pack(packing.pieces(packing.token_counts(table(spark, root, "documents"))))


def p7_documents(spark: SparkSession, root: str) -> DataFrame:
    """Of every document whether it is packed as a whole, split only if it is longer than a container, in containers that aren't overfull."""
    return packing.verified(p7_pack(spark, root))


def _passages(spark: SparkSession, root: str) -> DataFrame:
    return winnowing.shared_passages(table(spark, root, "documents"), table(spark, root, "eval_item"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return _passages(spark, root).select("doc_id", "item_id")


def p8_items(spark: SparkSession, root: str) -> DataFrame:
    """Which evaluation items leaked, and into how many documents."""
    return winnowing.leaked_items(_passages(spark, root)).select("item_id", "documents")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose author's own text holds template residue, filler, an error page or a script notice."""
    return residue.residue_records(table(spark, root, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p5_found, p5_percentiles, p5_certified, p7_pack, p7_documents, p8_found, p8_items, p9_found)}

_TAGS = r"</?[a-zA-Z][^<>]*>|\[/?(?:quote|b|i|u|s|url|img|code|color|size|font|list|spoiler)(?:=[^\]\n]*)?\]"


def _words_sql(rows: str, key: str) -> str:
    plain = rf"regexp_replace(regexp_replace(regexp_replace(text, '{_TAGS}', ' ', 'gi'), '&nbsp;|&amp;|&#39;', ' ', 'g'), '[\x{{00ad}}\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}]', '', 'g')"
    return rf"SELECT {key}, regexp_extract_all(lower({plain}), '[\p{{L}}\p{{N}}]+') AS w FROM {rows}"


_P8 = f"""
d AS ({_words_sql("documents", "doc_id")}), i AS ({_words_sql("eval_item", "item_id")}),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS p FROM d WHERE len(w) >= 10)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[p : p + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS p FROM i WHERE len(w) >= 10))"""

_P5 = """
v AS (SELECT product_id, unit_price AS x, strftime(loaded_at, '%Y-%m-%d') AS day, strftime(loaded_at, '%Y-%m') AS month
      FROM (SELECT DISTINCT id, product_id, unit_price, loaded_at FROM order_detail) WHERE product_id IS NOT NULL AND unit_price IS NOT NULL AND NOT isnan(unit_price)),
r AS (SELECT profile_id, product_id, period, TRY_CAST(percentile25 AS DOUBLE) AS p FROM row_description WHERE field = 'unitPrice' AND percentile25 IS NOT NULL),
j AS (SELECT r.profile_id, r.p, v.x FROM r JOIN v ON v.product_id = r.product_id AND r.period = v.day
      UNION ALL SELECT r.profile_id, r.p, v.x FROM r JOIN v ON v.product_id = r.product_id AND r.period = v.month)"""

SQL = {
    "p5_found": f"""WITH {_P5.strip()} SELECT profile_id FROM j GROUP BY profile_id, p
        HAVING count(*) FILTER (WHERE x <= p) < (count(*) * 20 + 99) // 100 OR count(*) FILTER (WHERE x < p) >= (count(*) * 30 + 99) // 100""",
    "p5_certified": """WITH v AS (SELECT DISTINCT id, product_id, unit_price, loaded_at FROM order_detail WHERE product_id IS NOT NULL AND unit_price IS NOT NULL AND NOT isnan(unit_price)),
        g AS (SELECT product_id, strftime(loaded_at, '%Y-%m-%d') AS period FROM v UNION ALL SELECT product_id, strftime(loaded_at, '%Y-%m') FROM v)
        SELECT product_id, period, percent, count(*) AS n, true AS within_bound, true AS bound_holds FROM g, (VALUES (25), (50), (75), (90)) p(percent) GROUP BY ALL""",
    "p7_documents": "SELECT doc_id, true AS whole, true AS split_only_if_longer, true AS fits FROM documents",
    "p8_items": f"""WITH {_P8.strip()} SELECT item_id, count(DISTINCT doc_id) AS documents FROM dg JOIN ig USING (g) GROUP BY 1""",
    "p8_found": f"WITH {_P8.strip()} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
}
