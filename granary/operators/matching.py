"""Supply against demand: position, gap, status and allocation to the best supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from granary.functions.numeric import filled, first_match, ratio, total
from granary.schema import DEMAND_ALIASES, ITEM, TIGHT_GAP


def normalize_demand(df: DataFrame) -> DataFrame:
    """(item_code, demand_qty) by alias, else the first numeric column is the demand."""
    chosen = {
        target: next((name for name in aliases if name in df.columns), None)
        for target, aliases in DEMAND_ALIASES.items()
    }
    if chosen[ITEM] is None:
        raise ValueError(f"demand table has no item column: {df.columns}")
    if chosen["demand_qty"] is None:
        numeric = [
            f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name != chosen[ITEM]
        ]
        if not numeric:
            raise ValueError(f"demand table has no quantity column: {df.columns}")
        chosen["demand_qty"] = numeric[0]
    return df.select(
        F.col(chosen[ITEM]).cast("string").alias(ITEM), F.col(chosen["demand_qty"]).cast("double").alias("demand_qty")
    )


def supply_position(summary: DataFrame) -> DataFrame:
    """Opening, on-hand, in-transit and total supply per item."""
    in_transit = total("in_transit_qty") if "in_transit_qty" in summary.columns else F.lit(0.0)
    by_item = summary.groupBy(ITEM).agg(
        total("opening_qty").alias("opening_qty"),
        total("closing_qty").alias("on_hand_qty"),
        in_transit.alias("in_transit_qty"),
    )
    return by_item.withColumn("total_supply", F.col("on_hand_qty") + F.col("in_transit_qty"))


def match_supply_demand(position: DataFrame, demand: DataFrame) -> DataFrame:
    """Full join on item with the gap, its ratio and its status; ``has_demand`` marks demand rows."""
    demand = demand.withColumn("has_demand", F.lit(True))
    joined = demand.join(position, ITEM, "full")
    gap, wanted = F.col("gap_qty"), F.col("demand_qty")
    return (
        joined.withColumns(
            {name: filled(name) for name in ("demand_qty", "on_hand_qty", "in_transit_qty", "total_supply")}
        )
        .withColumn("has_demand", F.coalesce("has_demand", F.lit(False)))
        .withColumn("gap_qty", wanted - F.col("total_supply"))
        .withColumn("gap_ratio", ratio(gap, wanted))
        .withColumn(
            "gap_status", first_match([(gap <= 0, "sufficient"), (F.col("gap_ratio") < TIGHT_GAP, "tight")], "short")
        )
    )


def gap_totals(matched: DataFrame) -> DataFrame:
    """One row of totals over the matched items."""
    sums = matched.agg(
        total("demand_qty").alias("total_demand"),
        total("total_supply").alias("total_supply"),
        total("gap_qty").alias("total_gap"),
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(F.col("gap_status") == "short").alias("short_items"),
        F.count_if(F.col("gap_qty") < 0).alias("surplus_items"),
    )
    return sums.withColumn("gap_ratio", ratio(F.col("total_gap"), F.col("total_demand")))


def shortages(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("gap_status") == "short").orderBy(F.desc("gap_qty"), ITEM)


def surplus(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("gap_qty") < 0).orderBy("gap_qty", ITEM)


def by_gap(matched: DataFrame) -> DataFrame:
    return matched.orderBy(F.desc("gap_qty"), ITEM)


def best_suppliers(scorecard: DataFrame, n: int):
    """Scalar array of the ``n`` suppliers with the best on-time share, name breaking ties."""
    best = scorecard.orderBy(F.desc("on_time_share"), "supplier").limit(n)
    ranked = best.select(
        (-F.col("on_time_share")).alias("lateness"), "supplier", "on_time_share", "delivery_risk"
    )
    return ranked.agg(F.array_sort(F.collect_list(F.struct("*"))).alias("best")).scalar()


def allocate_shortages(matched: DataFrame, scorecard: DataFrame) -> DataFrame:
    """Every short item with the supplier that has the best on-time share.

    No short item gives no rows; the one-row answer is a scalar subquery, not a join.
    """
    best = F.get(best_suppliers(scorecard, 1), F.lit(0))
    return (
        matched.filter((F.col("gap_status") == "short") & (F.col("gap_qty") > 0))
        .select(ITEM, "gap_qty", best.alias("best"))
        .select(ITEM, "gap_qty", "best.supplier", "best.on_time_share", "best.delivery_risk")
    )


def allocation_status(matched: DataFrame) -> DataFrame:
    """One row: ``completed`` with the number of allocations, or ``no_shortage``."""
    counted = matched.agg(F.count_if(F.col("gap_status") == "short").alias("allocations"))
    return counted.withColumn(
        "status", F.when(F.col("allocations") > 0, "completed").otherwise("no_shortage")
    )
