"""Stock and flow overview, turnover, cost estimate and product flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from granary.functions.numeric import first_match, ratio, total
from granary.schema import (
    HOLDING_COST_RATE,
    ITEM,
    PERIOD_DAYS,
    PERIOD_WEEKS,
    SLOW_WEEKS,
    STOCKOUT_COST_RATE,
)

INFINITY = float("inf")


def inventory_totals(summary: DataFrame) -> DataFrame:
    """One row: total opening and closing stock, distinct items."""
    return summary.agg(
        total("opening_qty").alias("total_opening"),
        total("closing_qty").alias("total_closing"),
        F.countDistinct(ITEM).alias("unique_items"),
    )


def stock_by_item(summary: DataFrame) -> DataFrame:
    """Opening and closing stock per item, largest opening first."""
    by_item = summary.groupBy(ITEM).agg(
        total("opening_qty").alias("total_opening"), total("closing_qty").alias("total_closing")
    )
    return by_item.orderBy(F.desc("total_opening"), ITEM)


def top_stock(summary: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` items with the most opening stock."""
    return stock_by_item(summary).limit(n)


def last_stock(summary: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` items with the least opening stock."""
    return stock_by_item(summary).orderBy("total_opening", F.desc(ITEM)).limit(n)


def flow_totals(summary: DataFrame) -> DataFrame:
    """One row: inflow, outflow, net change and its direction."""
    flows = summary.agg(total("in_qty").alias("total_in"), total("out_qty").alias("total_out"))
    flows = flows.withColumn("net_change", F.col("total_in") - F.col("total_out"))
    return flows.withColumn(
        "flow_direction",
        F.when(F.col("net_change") > 0, "up").when(F.col("net_change") < 0, "down").otherwise("flat"),
    )


def _flow_by_item(summary: DataFrame) -> DataFrame:
    return summary.groupBy(ITEM).agg(total("in_qty").alias("total_in"), total("out_qty").alias("total_out"))


def top_in(summary: DataFrame, n: int = 10) -> DataFrame:
    return _flow_by_item(summary).orderBy(F.desc("total_in"), ITEM).limit(n)


def top_out(summary: DataFrame, n: int = 10) -> DataFrame:
    return _flow_by_item(summary).orderBy(F.desc("total_out"), ITEM).limit(n)


def turnover(summary: DataFrame, weekly: DataFrame, slow_weeks: float = SLOW_WEEKS) -> DataFrame:
    """Turnover rate, days, weeks, days on hand and slow-moving flag per item.

    Infinity marks items that never turn over.
    """
    stock = weekly.groupBy(ITEM).agg(
        F.avg("week_balance").alias("avg_week_balance"),
        total("week_out").alias("total_week_out"),
        F.avg("week_out").alias("avg_week_out"),
    )
    rate = F.col("turnover_rate")
    return (
        summary.join(stock, ITEM, "left")
        .withColumn("turnover_rate", ratio(F.col("total_week_out"), F.col("avg_week_balance")))
        .withColumn("turnover_days", ratio(F.lit(float(PERIOD_DAYS)), rate, INFINITY))
        .withColumn("turnover_weeks", ratio(F.lit(float(PERIOD_WEEKS)), rate, INFINITY))
        .withColumn("days_on_hand", days_on_hand(F.col("closing_qty"), F.col("avg_week_out")))
        .withColumn("slow_moving", F.col("turnover_weeks") > slow_weeks)
    )


def days_on_hand(closing: Column, avg_week_out: Column) -> Column:
    """Days the stock lasts at the mean weekly outflow; infinity without outflow."""
    return ratio(closing, avg_week_out, INFINITY) * 7


def slow_moving(turned: DataFrame) -> DataFrame:
    """The slow-moving rows of ``turnover``."""
    return turned.filter("slow_moving")


def turnover_kpis(turned: DataFrame) -> DataFrame:
    """One row over the output of ``turnover``."""
    slow = F.col("slow_moving")
    kpis = turned.agg(
        F.avg(F.when(F.col("turnover_rate") > 0, F.col("turnover_rate"))).alias("avg_turnover_rate"),
        F.count_if(slow).alias("slow_count"),
        total("closing_qty").alias("total_closing"),
        total(F.when(slow, F.col("closing_qty"))).alias("slow_closing"),
    )
    return kpis.withColumn(
        "slow_share_pct", ratio(F.col("slow_closing"), F.col("total_closing")) * 100
    )


def capital_estimate(
    summary: DataFrame,
    holding_rate: float = HOLDING_COST_RATE,
    stockout_rate: float = STOCKOUT_COST_RATE,
) -> DataFrame:
    """Holding and stock-out cost of the closing stock, in quantity units.

    Without a ``unit_price`` column the row says ``skipped``; with one, the same estimates in
    money are added.
    """
    if "unit_price" not in summary.columns:
        return summary.sparkSession.range(1).select(
            F.lit("skipped").alias("status"), F.lit("no unit_price column").alias("reason")
        )
    # money in DECIMAL: the sum does not depend on the order of the rows
    amount = (F.col("closing_qty") * F.col("unit_price")).cast("decimal(18,2)")
    sums = summary.agg(
        total("opening_qty").alias("total_opening"),
        total("closing_qty").alias("total_closing"),
        F.coalesce(F.sum(amount).cast("double"), F.lit(0.0)).alias("closing_amount"),
    )
    return sums.select(
        F.lit("completed").alias("status"),
        "total_opening",
        "total_closing",
        (F.col("total_closing") * holding_rate).alias("holding_cost"),
        (F.col("total_closing") * stockout_rate).alias("stockout_cost"),
        "closing_amount",
        (F.col("closing_amount") * holding_rate).alias("holding_cost_amount"),
        (F.col("closing_amount") * stockout_rate).alias("stockout_cost_amount"),
    )


def product_flow(summary: DataFrame, order: str | None = None) -> DataFrame:
    """Flow per item and its state: idle, consuming, accumulating or balanced.

    ``order`` names the column that decides which opening stock is first and which closing
    stock is last; without it the input has to have one row per item, and several raise an error.
    """

    def only(name: str):
        several = F.raise_error(F.concat(F.lit("give an order: several rows of item "), F.col(ITEM)))
        return F.when(F.count(F.lit(1)) > 1, several).otherwise(F.min(name))

    first = F.min_by("opening_qty", order) if order else only("opening_qty")
    last = F.max_by("closing_qty", order) if order else only("closing_qty")
    flow = summary.groupBy(ITEM).agg(
        total("in_qty").alias("total_in"),
        total("out_qty").alias("total_out"),
        first.alias("first_opening"),
        last.alias("last_closing"),
    )
    inflow, outflow = F.col("total_in"), F.col("total_out")
    return flow.withColumn("net_flow", inflow - outflow).withColumn(
        "flow_state",
        first_match(
            [
                ((outflow == 0) & (F.col("first_opening") > 0), "idle"),
                (outflow > inflow, "consuming"),
                (inflow > outflow, "accumulating"),
            ],
            "balanced",
        ),
    )


def flow_distribution(flow: DataFrame) -> DataFrame:
    """Items per flow state."""
    return flow.groupBy("flow_state").agg(F.count(F.lit(1)).alias("items"))
