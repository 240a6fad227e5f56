"""Purchase plan from alerts: quantity, checks, order date, supplier split and priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from granary.functions.numeric import filled, first_match, lookup
from granary.operators.alerts import as_of_date
from granary.operators.matching import best_suppliers
from granary.schema import CLASS_SCORE, ITEM, TYPE_SCORE


def purchase_qty(demand: Column, safety: Column, balance: Column, in_transit: Column) -> Column:
    """What is still needed after stock and goods in transit, never negative."""
    return F.greatest(F.lit(0.0), demand + safety - balance - in_transit)


def eoq_warning(quantity: Column, eoq: Column) -> Column:
    """Text when an order is smaller than half the economic quantity, else null."""
    small = (eoq > 0) & (quantity > 0) & (quantity < eoq * 0.5)
    return F.when(small, F.format_string("order of %.2f is far below EOQ %.2f: combine orders", quantity, eoq))


def moq_adjust(quantity: Column, moq: float) -> tuple[Column, Column]:
    """(quantity raised to the minimum order, warning or null)."""
    if moq <= 0:
        return quantity, F.lit(None).cast("string")
    low = quantity < moq
    text = F.format_string("order of %.2f raised to the minimum order %.2f", quantity, F.lit(float(moq)))
    return F.when(low, F.lit(float(moq))).otherwise(quantity), F.when(low, text)


def order_date(urgency: Column, as_of: str | None = None) -> Column:
    """Day to place the order, by urgency."""
    today = as_of_date(as_of)
    quarter = F.greatest(F.lit(1), 12 - (F.floor(F.dayofyear(today) / 30) % 3).cast("int"))
    weeks = first_match(
        [(urgency == "urgent", 0), (urgency == "this_week", 1), (urgency == "this_month", 4), (urgency == "this_quarter", quarter)],
        1,
    )
    return F.date_add(today, (weeks * 7).cast("int"))


def priority_score(abc: Column, alert_type: Column) -> Column:
    return lookup(abc, CLASS_SCORE, 0) + lookup(alert_type, TYPE_SCORE, 0)


def supplier_split(abc: Column, quantity: Column, best: Column | None) -> Column:
    """Array of (supplier, role, share, quantity, on_time_share): 70:30 for class A, else one."""
    nobody = F.struct(
        F.lit("unassigned").alias("supplier"),
        F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("double").alias("share"),
        quantity.alias("quantity"),
        F.lit(None).cast("double").alias("on_time_share"),
    )
    if best is None:
        return F.array(nobody)

    def part(position: int, role: str, share: float) -> Column:
        chosen = F.get(best, F.lit(position))
        return F.struct(
            chosen["supplier"].cast("string").alias("supplier"),
            F.lit(role).alias("role"),
            F.lit(share).alias("share"),
            (quantity * share).alias("quantity"),
            chosen["on_time_share"].alias("on_time_share"),
        )

    both = F.array(part(0, "primary", 0.7), part(1, "backup", 0.3))
    return first_match(
        [(F.size(best) == 0, F.array(nobody)), ((abc == "A") & (F.size(best) >= 2), both)],
        F.array(part(0, "single", 1.0)),
    )


def purchase_plan(
    alerts: DataFrame,
    matched: DataFrame | None = None,
    plan: DataFrame | None = None,
    scorecard: DataFrame | None = None,
    moq: float = 0.0,
    as_of: str | None = None,
    formula: str = "full",
) -> DataFrame:
    """One row per shortage or reorder alert, highest priority first.

    The order quantity to check against comes with the alerts; ``plan`` overrides it.
    ``formula="full"`` takes stock off the quantity again even when the demand is the
    alert's own buy quantity, and counts no safety stock for reorders. ``formula="net"`` uses
    the alert's buy quantity as it is, since stock was already taken off there.
    """
    items = alerts.filter(F.col("alert_type").isin("shortage", "reorder"))
    if matched is not None:
        wanted = matched.filter("has_demand").select(ITEM, "demand_qty")
        items = items.join(wanted, ITEM, "left")
    else:
        items = items.withColumn("demand_qty", F.lit(None).cast("double"))
    if plan is not None:
        items = items.drop("eoq").join(plan.select(ITEM, "eoq"), ITEM, "left")
    elif "eoq" not in items.columns:
        items = items.withColumn("eoq", F.lit(None).cast("double"))
    safety = F.when(F.col("alert_type") == "shortage", F.col("safety_stock")).otherwise(F.lit(0.0))
    demand = F.coalesce("demand_qty", "buy_qty")
    quantity = purchase_qty(demand, safety, F.col("balance"), F.col("in_transit_qty"))
    if formula == "net":
        quantity = F.when(F.col("demand_qty").isNull(), F.col("buy_qty")).otherwise(quantity)
    elif formula != "full":
        raise ValueError(f"unknown formula {formula!r}")
    items = items.withColumn("needed_qty", quantity)
    raised, moq_text = moq_adjust(F.col("needed_qty"), moq)
    best = best_suppliers(scorecard, 2) if scorecard is not None else None
    items = items.withColumns(
        {
            "order_qty": raised,
            "warnings": F.array_compact(F.array(eoq_warning(F.col("needed_qty"), F.col("eoq")), moq_text)),
            "order_date": order_date(F.col("urgency"), as_of),
            "priority": priority_score(F.col("abc_class"), F.col("alert_type")),
        }
    )
    items = items.withColumn("allocations", supplier_split(F.col("abc_class"), F.col("order_qty"), best))
    return items.select(
        ITEM, "abc_class", "alert_type", "urgency", "balance", "safety_stock", "reorder_point",
        F.when(F.col("alert_type") == "shortage", F.col("quantity")).alias("gap_qty"),
        "eoq", "needed_qty", "order_qty", "order_date", "allocations", "warnings", "priority",
    ).orderBy(F.desc("priority"), ITEM)


def assign_suppliers(purchases: DataFrame) -> DataFrame:
    """The supplier split of the plan, one row per item and supplier."""
    return purchases.select(ITEM, "abc_class", F.inline("allocations"))


def purchase_summary(purchases: DataFrame) -> DataFrame:
    """One row of counts by urgency and the total quantity."""
    return purchases.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(F.col("urgency") == "urgent").alias("urgent_count"),
        F.count_if(F.col("urgency") == "this_week").alias("weekly_count"),
        F.count_if(F.col("urgency") == "this_month").alias("monthly_count"),
        filled(F.sum("order_qty")).alias("total_qty"),
    )


def top_purchases(purchases: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` urgent purchases."""
    return purchases.filter(F.col("urgency") == "urgent").orderBy(F.desc("priority"), ITEM).limit(n)


def first_warnings(purchases: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` warnings: shortages before reorders, then by item."""
    rows = purchases.select(ITEM, "alert_type", F.posexplode("warnings").alias("position", "warning"))
    return rows.orderBy(F.desc("alert_type"), ITEM, "position").limit(n)
