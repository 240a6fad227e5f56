"""Safety stock, reorder point, order quantity, stock limits, status and cost per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from granary.functions.numeric import filled, first_match, lookup, ratio
from granary.operators.forecast import Calendar
from granary.schema import (
    DEFAULT_POLICY,
    DEFAULT_SERVICE_LEVEL,
    HOLDING_RATE,
    ITEM,
    LEAD_TIME_WEEKS,
    LIFECYCLE_TYPES,
    MADE_TO_ORDER,
    ORDER_COST,
    PERIODIC_POLICIES,
    POLICY,
    SERVICE_LEVEL,
    SERVICE_Z,
    SHELF_MAX_SHARE,
    SHELF_SAFETY_SHARE,
)

INTERMITTENT_METHODS = ("tsb", "imapa")


def demand_variability(weekly: DataFrame, calendar: Calendar | None = None) -> DataFrame:
    """Mean outflow, deviation over all and over non-zero weeks, and the latest balance."""
    demand = F.when(F.col("week_out") > 0, F.col("week_out"))
    if calendar is not None:
        rows = calendar.keep(weekly).groupBy(ITEM).agg(
            F.count(F.lit(1)).alias("n"),
            filled(F.avg("week_out")).alias("mean_out"),
            filled(F.var_pop("week_out")).alias("var_out"),
            filled(F.stddev_samp(demand)).alias("std_nonzero"),
            filled(F.max_by("week_balance", "week_key")).alias("balance"),
        )
        mean, squares = calendar.moments(F.col("n"), F.col("mean_out"), F.col("var_out"))
        std = F.when(calendar.weeks > 1, F.sqrt(F.try_divide(squares, calendar.weeks - 1))).otherwise(F.lit(0.0))
        return rows.select(ITEM, mean.alias("mean_out"), std.alias("std_all"), "std_nonzero", "balance")
    return weekly.groupBy(ITEM).agg(
        filled(F.avg("week_out")).alias("mean_out"),
        filled(F.stddev_samp("week_out")).alias("std_all"),
        filled(F.stddev_samp(demand)).alias("std_nonzero"),
        filled(F.max_by("week_balance", "week_key")).alias("balance"),
    )


def service_level(combo: Column) -> Column:
    return lookup(combo, SERVICE_LEVEL, DEFAULT_SERVICE_LEVEL)


def service_z(level: Column) -> Column:
    return lookup(level, SERVICE_Z, 1.65)


def policy(combo: Column, field: int) -> Column:
    """Policy type (0), period in weeks (1) or method (2) of a combination."""
    table = {key: row[field] for key, row in POLICY.items() if row[field] is not None}
    return lookup(combo, table, DEFAULT_POLICY[field])


def safety_stock(z: Column, std: Column, lead_time: float) -> Column:
    return z * std * F.lit(float(lead_time) ** 0.5)


def safety_stock_variable_lead_time(z: Column, std: Column, mean: Column, lead_time: float, sigma_lt: float) -> Column:
    """Safety stock that also covers a varying lead time; needs demand."""
    spread = F.sqrt(float(lead_time) * std * std + mean * mean * float(sigma_lt) ** 2)
    return F.when(mean > 0, z * spread).otherwise(safety_stock(z, std, lead_time))


def shelf_cap(quantity: Column, mean: Column, shelf_days: Column, share: float) -> Column:
    """``quantity`` limited to what sells within ``share`` of the shelf life."""
    limit = mean * (shelf_days / 7.0) * share
    return F.when((shelf_days > 0) & (mean > 0), F.least(quantity, limit)).otherwise(quantity)


def reorder_point(combo: Column, forecast: Column, safety: Column, lead_time: float) -> Column:
    """Null for combinations that are bought by order."""
    return F.when(~combo.isin(*MADE_TO_ORDER), forecast * float(lead_time) + safety)


def future_reorder_points(forecast: Column, reorder: Column, weeks: int = 4) -> Column:
    """Array of (week_offset, forecast, reorder_point); empty without a reorder point."""
    ahead = F.transform(
        F.sequence(F.lit(1), F.lit(weeks)),
        lambda w: F.struct(w.alias("week_offset"), forecast.alias("forecast"), reorder.alias("reorder_point")),
    )
    return F.when(reorder.isNotNull(), ahead).otherwise(F.slice(ahead, F.lit(1), F.lit(0)))


def eoq(forecast: Column, order_cost: float = ORDER_COST, holding_rate: float = HOLDING_RATE) -> Column:
    """Economic order quantity of the yearly forecast; 0 without demand."""
    if holding_rate <= 0:
        return F.lit(0.0)
    annual = forecast * 52
    return F.when(annual > 0, F.sqrt(2 * annual * order_cost / holding_rate)).otherwise(F.lit(0.0))


def max_stock(
    policy_type: Column, period: Column, forecast: Column, safety: Column, reorder: Column, eoq_qty: Column, lead_time: float
) -> Column:
    periodic = forecast * (F.coalesce(period, F.lit(1)) + float(lead_time)) + safety
    return F.when(policy_type.isin(*PERIODIC_POLICIES), periodic).otherwise(filled(reorder) + eoq_qty)


def stock_status(balance: Column, safety: Column, reorder: Column, highest: Column) -> Column:
    return first_match(
        [
            (reorder.isNotNull() & (balance <= safety), "shortage_risk"),
            (reorder.isNotNull() & (balance <= reorder), "reorder"),
            (balance >= highest, "overstock"),
        ],
        "normal",
    )


def with_lifecycle(items: DataFrame, summary: DataFrame | None) -> DataFrame:
    """Left join of the lifecycle columns the summary has; the others become typed nulls.

    The side is not broadcast by hint: it grows with the items, so the planner decides by size.
    """
    present = [c for c in LIFECYCLE_TYPES if summary is not None and c in summary.columns]
    if present:
        items = items.join(summary.select(ITEM, *present), ITEM, "left")
    absent = {c: F.lit(None).cast(t) for c, t in LIFECYCLE_TYPES.items() if c not in present}
    return items.withColumns(absent) if absent else items


def plan_inventory(
    weekly: DataFrame | None,
    summary: DataFrame | None = None,
    classification: DataFrame | None = None,
    forecasts: DataFrame | None = None,
    lead_time: int = LEAD_TIME_WEEKS,
    order_cost: float = ORDER_COST,
    holding_rate: float = HOLDING_RATE,
    sigma_lt: float | None = None,
    std_method: str = "std_all",
    calendar: Calendar | None = None,
) -> DataFrame:
    """One row per item of ``weekly`` with every planning figure.

    ``classification`` has (item_code, combo), ``forecasts`` (item_code, forecast, method).
    Items without a class count as BX; items without a forecast use their mean outflow.
    Without ``weekly`` the output of ``forecast_demand`` supplies the statistics as well, and the
    weekly table is not read again. With a ``calendar``, weeks without a row count as zero.
    """
    if weekly is None:
        measured = forecasts.select(
            ITEM, "mean_out", F.col("std_out").alias("std_all"), "std_nonzero", "balance", "demand_arrow",
            "forecast", "method",
        )
        forecasts = None
    else:
        measured = demand_variability(weekly, calendar)
    items = with_lifecycle(measured, summary)
    if classification is not None:
        items = items.join(classification.select(ITEM, "combo"), ITEM, "left")
    else:
        items = items.withColumn("combo", F.lit(None).cast("string"))
    if forecasts is not None:
        items = items.join(forecasts.select(ITEM, "forecast", "method"), ITEM, "left")
    elif weekly is not None:
        items = items.withColumns({"forecast": F.lit(None).cast("double"), "method": F.lit(None).cast("string")})

    mean, combo, forecast = F.col("mean_out"), F.col("combo"), F.col("forecast")
    use_nonzero = F.lit(False)
    if std_method == "std_nonzero":
        use_nonzero = F.coalesce(F.col("method").isin(*INTERMITTENT_METHODS), F.lit(False)) & (F.col("std_nonzero") > 0)
    items = items.withColumns(
        {
            "combo": F.coalesce(combo, F.lit("BX")),
            "forecast": F.coalesce(forecast, mean),
            "lifecycle": F.coalesce("lifecycle", F.lit("active")),
            "std_out": F.when(use_nonzero, F.col("std_nonzero")).otherwise(F.col("std_all")),
            "std_basis": F.when(use_nonzero, "nonzero").otherwise("all"),
        }
    )
    items = items.withColumns(
        {
            "service_level": service_level(combo),
            "policy_type": policy(combo, 0),
            "period_weeks": policy(combo, 1).cast("int"),
            "policy_method": policy(combo, 2),
            "eoq": eoq(forecast, order_cost, holding_rate),
        }
    )
    z = service_z(F.col("service_level"))
    std = F.col("std_out")
    if sigma_lt is not None and sigma_lt > 0:
        safety = safety_stock_variable_lead_time(z, std, mean, lead_time, sigma_lt)
    else:
        safety = safety_stock(z, std, lead_time)
    shelf = F.col("shelf_life_days")
    items = items.withColumn("safety_stock", shelf_cap(safety, mean, shelf, SHELF_SAFETY_SHARE))
    items = items.withColumn("reorder_point", reorder_point(combo, forecast, F.col("safety_stock"), lead_time))
    highest = max_stock(
        F.col("policy_type"), F.col("period_weeks"), forecast, F.col("safety_stock"), F.col("reorder_point"),
        F.col("eoq"), lead_time,
    )
    items = items.withColumn("max_stock", shelf_cap(highest, mean, shelf, SHELF_MAX_SHARE))
    items = items.withColumns(
        {
            "future_rop": future_reorder_points(forecast, F.col("reorder_point")),
            "stock_level_pct": ratio(F.col("balance"), F.col("max_stock")) * 100,
        }
    )
    items = items.withColumns(lifecycle_policy(lead_time))
    items = items.withColumn("z_value", service_z(F.col("service_level")))
    items = items.withColumn(
        "status", stock_status(F.col("balance"), F.col("safety_stock"), F.col("reorder_point"), F.col("max_stock"))
    )
    items = items.withColumns(inventory_cost(order_cost, holding_rate))
    return items.withColumns({"lead_time": F.lit(lead_time), "sigma_lt": F.lit(sigma_lt).cast("double")}).drop(
        "std_all", "std_nonzero"
    )


def lifecycle_policy(lead_time: float) -> dict[str, Column]:
    """Columns replaced for launch, phase-out and obsolete items, after the shelf-life limits."""
    state = F.col("lifecycle")
    launch, leaving, gone = state == "launch", state == "phase_out", state == "obsolete"
    raised = F.greatest(F.col("safety_stock"), F.col("mean_out") * 2)
    stopped = leaving | gone
    return {
        "safety_stock": F.when(launch, raised).when(stopped, 0.0).otherwise(F.col("safety_stock")),
        "service_level": F.when(launch, 0.99).otherwise(F.col("service_level")),
        "reorder_point": F.when(launch, F.col("forecast") * float(lead_time) + raised)
        .when(~stopped, F.col("reorder_point")),
        "max_stock": F.when(leaving, F.col("balance")).otherwise(F.col("max_stock")),
        "policy_type": F.when(launch, "fixed_period").when(stopped, "variable").otherwise(F.col("policy_type")),
        "period_weeks": F.when(launch, 1).when(~stopped, F.col("period_weeks")),
        "policy_method": F.when(launch, "launch").when(leaving, "clearance").when(gone, "obsolete")
        .otherwise(F.col("policy_method")),
        "rop_note": F.when(leaving, "replenishment stopped, clearance").when(gone, "obsolete")
        .when(~launch & F.col("combo").isin(*MADE_TO_ORDER), "bought by order").otherwise(""),
    }


def inventory_cost(order_cost: float, holding_rate: float) -> dict[str, Column]:
    """Yearly holding, ordering and total cost columns."""
    holding = (F.col("safety_stock") + F.col("max_stock")) / 2 * holding_rate
    ordering = ratio(F.col("forecast") * 52, F.col("eoq")) * order_cost
    return {"holding_cost": holding, "ordering_cost": ordering, "total_cost": holding + ordering}


def plan_counts(plan: DataFrame) -> DataFrame:
    """Items per stock status."""
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("items"))
