"""Rolling totals over trailing periods, days without activity included, from event-contribution deltas.

Each daily amount adds itself on its day and takes itself off again when it leaves a window, ``days`` later.
The running sum of these deltas is the trailing total; between two delta days it stays the same, so a
customer is a short list of segments and days are only made when asked for.

Scale: amounts are summed per entity and day before anything is gathered by entity, so what one entity sends
on is bounded by the calendar, however many rows it has. The only order-dependent step is a window per entity
over its delta days. No join against a calendar, no row pairs.

Defined results: rows with a null key, day or amount and amounts that are NaN or infinite don't count; keys
are trimmed and upper-cased; amounts are exact in cents (rounded half up from the double); zero and negative
amounts are amounts; rows without an order id are no order; of rows with the same id the one with the latest
``loaded_at`` counts once (all equal: any, they are the same; equal times but other content: the greatest by
customer, day and amount); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import code_key


def cents(amount: Column) -> Column:
    """A money amount as whole cents; null for NaN and infinities."""
    return F.round(F.nanvl(amount.cast("double"), F.lit(None).cast("double")) * 100).try_cast("bigint")


def current_orders(orders: DataFrame) -> DataFrame:
    """Of each order the latest row: columns entity, day, amount (cents). Orders that don't count are left out."""
    rows = orders.select(
        F.col("id").alias("_id"),
        F.struct(
            F.col("loaded_at").alias("at"),
            code_key(F.col("customer_id")).alias("entity"),
            F.col("order_date").cast("date").alias("day"),
            cents(F.col("freight")).alias("amount"),
            F.col("deleted_at").isNotNull().alias("deleted"),
        ).alias("_row"),
    ).where(F.col("_id").isNotNull())
    latest = rows.groupBy("_id").agg(F.max("_row").alias("_row")).select("_row.*")
    return latest.where(~F.col("deleted") & F.col("entity").isNotNull() & F.col("day").isNotNull() & F.col("amount").isNotNull()).select(
        "entity", "day", "amount"
    )


def trailing_segments(amounts: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Segments of days with the same trailing totals.

    ``amounts`` has entity, day, amount. The result has entity, from_day, to_day (both included) and per window
    ``total_w`` (same unit as amount) and ``events_w``. The last segment ends on the last day on which some
    window still holds an amount.
    """
    daily = amounts.groupBy("entity", "day").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")

    def delta(at: Column, only: int | None) -> Column:
        """The contribution that falls on ``at``: into all windows, or out of one."""
        parts = []
        for w in windows:
            parts += [
                (F.col("amount") if only is None else -F.col("amount") if only == w else zero).alias(f"total_{w}"),
                (F.col("n") if only is None else -F.col("n") if only == w else zero).alias(f"events_{w}"),
            ]
        return F.struct(at.alias("day"), *parts)

    entering = delta(F.col("day"), None)
    leaving = [delta(F.date_add("day", w), w) for w in windows]
    sums = [f"{kind}_{w}" for w in windows for kind in ("total", "events")]
    deltas = (
        daily.select("entity", F.explode(F.array(entering, *leaving)).alias("d"))
        .select("entity", "d.*")
        .repartition(F.col("entity"))  # one exchange serves both the sum by day and the window by entity
        .groupBy("entity", "day")
        .agg(*[F.sum(s).alias(s) for s in sums])
    )
    by_day = Window.partitionBy("entity").orderBy("day")
    running = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        deltas.select(
            "entity",
            F.col("day").alias("from_day"),
            F.date_sub(F.lead("day").over(by_day), 1).alias("to_day"),
            *[F.sum(s).over(running).alias(s) for s in sums],
        )
        .where(F.col("to_day").isNotNull())
    )


def days_of(segments: DataFrame) -> DataFrame:
    """One row per entity and day of the segments."""
    rest = [c for c in segments.columns if c not in ("entity", "from_day", "to_day")]
    return segments.select("entity", F.explode(F.sequence("from_day", "to_day")).alias("day"), *rest)


def trailing_totals(orders: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Per customer and calendar day, from the first order until no window holds one any more: for each window
    the total, the average per day of the window and the average per order (null without orders)."""
    days = days_of(trailing_segments(current_orders(orders), windows))
    columns = []
    for w in windows:
        total, n = F.col(f"total_{w}"), F.col(f"events_{w}")
        columns += [
            (total / 100).alias(f"total_{w}"),
            F.round(total / (100 * w), 6).alias(f"avg_day_{w}"),
            F.round(F.try_divide(total, 100 * n), 6).alias(f"avg_order_{w}"),
            n.alias(f"orders_{w}"),
        ]
    return days.select(F.col("entity").alias("customer_id"), "day", *columns)
