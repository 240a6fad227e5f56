"""Shortage, reorder, overstock, clearance and expiry alerts from an inventory plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from granary.functions.numeric import filled, first_match, lookup
from granary.functions.ordering import running_total
from granary.functions.series import last_step_arrow
from granary.operators.forecast import Calendar
from granary.schema import (
    ALERT_COLOUR,
    ITEM,
    LEAD_TIME_WEEKS,
    OVERSTOCK_ACTION,
    REORDER_URGENCY,
    SHORTAGE_URGENCY,
    URGENCY_RANK,
)


def as_of_date(as_of: str | None) -> Column:
    """The day alerts are computed for: a literal, or today."""
    return F.lit(as_of).cast("date") if as_of else F.current_date()


def stockout_projection(plan: DataFrame, as_of: str | None = None, lead_time: int = LEAD_TIME_WEEKS) -> DataFrame:
    """Weeks of cover, stock-out date and latest order date.

    ``weeks_left`` is infinite when stock is there but nothing flows out. Dates are null with a
    ``projection_note`` for the cases without a date; one after the year 9999 is "beyond the calendar".
    """
    stock, mean = F.col("balance") + F.col("in_transit_qty"), F.col("mean_out")
    weeks = F.when(mean > 0, F.try_divide(stock, mean)).otherwise(
        F.when(stock > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    )
    today, left = as_of_date(as_of), F.col("weeks_left")
    dated = (mean > 0) & (left > 0)

    days = F.datediff(F.lit("9999-12-31").cast("date"), today)  # that the calendar still has

    def later(span: Column) -> Column:
        whole = F.floor(span * 7)
        return F.when(whole <= days, F.date_add(today, F.least(whole, days).cast("int")))

    return plan.withColumn("weeks_left", weeks).withColumns(
        {
            "stockout_date": F.when(dated, later(left)),
            "order_by_date": F.when(dated, later(F.greatest(F.lit(0.0), left - lead_time))),
            "projection_note": first_match(
                [
                    (mean <= 0, "no outflow, no estimate"),
                    (left <= 0, "already out, order now"),
                    (F.floor(left * 7) > days, "beyond the calendar"),
                ],
                "projected",
            ),
        }
    )


def demand_arrow(weekly: DataFrame, calendar: Calendar | None = None) -> DataFrame:
    """Arrow per item: last week against the week before."""
    if calendar is not None:
        at, n = calendar.position(), calendar.weeks
        pair = [filled(F.sum(F.when(at == n - back, F.col("week_out")))).alias(f"back{back}") for back in (1, 2)]
        pairs = weekly.groupBy(ITEM).agg(*pair)
        return pairs.select(ITEM, last_step_arrow(F.col("back1"), F.col("back2")).alias("demand_arrow"))
    # two rows of an item at most pass the shuffle
    back = F.row_number().over(W.partitionBy(ITEM).orderBy(F.desc("week_key"), F.desc("week_out")))
    latest = weekly.select(ITEM, "week_key", "week_out").withColumn("__back", back).filter("__back <= 2")
    pairs = latest.groupBy(ITEM).agg(*[F.max(F.when(F.col("__back") == n, F.col("week_out"))).alias(f"back{n}") for n in (1, 2)])
    return pairs.select(ITEM, last_step_arrow(F.col("back1"), F.col("back2")).alias("demand_arrow"))


def in_transit_lookup(
    items: DataFrame,
    by_item: DataFrame | None = None,
    item_supplier: DataFrame | None = None,
    by_supplier: DataFrame | None = None,
) -> DataFrame:
    """In-transit quantity: the item's own, else the quantity known for its supplier, else 0."""
    candidates = []
    if by_item is not None:
        items = items.join(by_item.select(ITEM, F.col("in_transit_qty").alias("__own")), ITEM, "left")
        candidates.append(F.nullif(F.col("__own"), F.lit(0.0)))
    if item_supplier is not None:
        items = items.join(item_supplier.select(ITEM, "supplier"), ITEM, "left")
        if by_supplier is not None:
            items = items.join(
                by_supplier.select("supplier", F.col("in_transit_qty").alias("__supplied")), "supplier", "left"
            )
            candidates.append(F.when(F.col("__supplied") > 0, F.col("__supplied")))
    return items.withColumn("in_transit_qty", F.coalesce(*candidates, F.lit(0.0))).drop("__own", "__supplied")


def expiry_level(plan: DataFrame, as_of: str | None = None) -> DataFrame:
    """Remaining shelf days and expiry severity (high / medium / null) per item with stock."""
    shelf = F.col("shelf_life_days")
    remaining = F.coalesce(
        "remaining_shelf_days", shelf - F.datediff(as_of_date(as_of), F.col("production_date"))
    )
    watched = (shelf > 0) & (F.col("balance") > 0)
    return plan.withColumn("days_left", F.when(watched, remaining)).withColumn(
        "expiry_severity",
        F.when(F.col("days_left") <= 30, "high").when(F.col("days_left") <= shelf * 0.3, "medium"),
    )


def generate_alerts(
    plan: DataFrame,
    weekly: DataFrame | None = None,
    as_of: str | None = None,
    lead_time: int = LEAD_TIME_WEEKS,
    in_transit: DataFrame | None = None,
    item_supplier: DataFrame | None = None,
    supplier_in_transit: DataFrame | None = None,
    calendar: Calendar | None = None,
) -> DataFrame:
    """One row per alert; an item can have a stock alert and an expiry alert.

    All kinds come out of a single pass over the plan, told apart by ``alert_type``.
    """
    items = in_transit_lookup(plan, in_transit, item_supplier, supplier_in_transit)
    if weekly is not None:
        items = items.drop("demand_arrow").join(demand_arrow(weekly, calendar), ITEM, "left")
    elif "demand_arrow" not in items.columns:
        items = items.withColumn("demand_arrow", F.lit("→"))
    items = expiry_level(stockout_projection(items, as_of, lead_time), as_of)
    abc = F.substring("combo", 1, 1)
    items = items.withColumn("abc_class", abc).withColumn(
        "colour", lookup(F.col("abc_class"), ALERT_COLOUR, "yellow")
    )
    if "supplier" not in items.columns:
        items = items.withColumn("supplier", F.lit(None).cast("string"))

    balance, safety, transit = F.col("balance"), F.col("safety_stock"), F.col("in_transit_qty")
    reorder = filled("reorder_point")
    cls, state, status = F.col("abc_class"), F.col("lifecycle"), F.col("status")
    running = state != "obsolete"  # a phase-out item without stock is treated like any other
    nothing = F.lit(None).cast("double")

    def alert(kind, urgency, quantity, buy, action) -> Column:
        return F.struct(
            F.lit(kind).alias("alert_type"),
            urgency.cast("string").alias("urgency"),
            quantity.cast("double").alias("quantity"),
            buy.cast("double").alias("buy_qty"),
            action.cast("string").alias("action"),
        )

    shortage = alert(
        "shortage", lookup(cls, SHORTAGE_URGENCY, "normal"), safety - balance,
        F.greatest(F.lit(0.0), reorder - balance - transit), F.lit("buy"),
    )
    refill = alert(
        "reorder", lookup(cls, REORDER_URGENCY, "this_quarter"), nothing,
        F.greatest(F.lit(0.0), reorder - balance + safety - transit), F.lit("buy"),
    )
    refill = refill.withField("quantity", refill["buy_qty"])
    excess = alert(
        "overstock", F.lit(None), balance - F.col("max_stock"), nothing, lookup(cls, OVERSTOCK_ACTION, "keep")
    )
    clearance = alert("clearance", F.lit(None), balance, nothing, F.lit("clear stock, stop buying"))
    expiry = alert(
        "expiry", F.col("expiry_severity"), F.col("days_left"), nothing,
        F.when(F.col("expiry_severity") == "high", "promote, discount or scrap").otherwise("use first, adjust plan"),
    )
    stock_alert = first_match(
        [
            ((state == "phase_out") & (balance > 0), clearance),
            (running & (status == "shortage_risk"), shortage),
            (running & (status == "reorder"), refill),
            (running & (status == "overstock"), excess),
        ]
    )
    found = F.array_compact(F.array(stock_alert, F.when(F.col("expiry_severity").isNotNull(), expiry)))
    return items.withColumn("alert", F.explode(found)).select(
        ITEM,
        "abc_class",
        "combo",
        "colour",
        "lifecycle",
        "alert.*",
        "balance",
        "safety_stock",
        "reorder_point",
        "max_stock",
        "eoq",
        "mean_out",
        "in_transit_qty",
        "supplier",
        "weeks_left",
        "stockout_date",
        F.when(F.col("alert.alert_type") != "clearance", F.col("order_by_date")).alias("order_by_date"),
        "projection_note",
        "demand_arrow",
        "shelf_life_days",
        "days_left",
    )


def of_type(alerts: DataFrame, kind: str) -> DataFrame:
    """Alerts of one kind; ``overstock`` includes clearance, as the overstock list does."""
    kinds = ("overstock", "clearance") if kind == "overstock" else (kind,)
    return alerts.filter(F.col("alert_type").isin(*kinds))


def priority_keys() -> list[tuple[Column, bool]]:
    """(column, descending) of the order inside the kinds: first the top urgency, then quantity; expiry by days left."""
    first = F.when(F.col("urgency").isin("urgent", "this_week", "high"), 0).otherwise(1)
    size = F.when(F.col("alert_type") == "expiry", -F.col("days_left").cast("double")).otherwise(F.col("quantity"))
    urgent = F.when(F.col("alert_type").isin("overstock", "clearance"), 0).otherwise(first)
    return [(_list_name(), False), (urgent, False), (size, True), (F.col(ITEM), False)]


def priority_order() -> list[Column]:
    return [c.desc() if descending else c.asc() for c, descending in priority_keys()]


def _list_name() -> Column:
    return F.when(F.col("alert_type") == "clearance", "overstock").otherwise(F.col("alert_type"))


def prioritised(alerts: DataFrame) -> DataFrame:
    """Alerts in list order."""
    return alerts.orderBy(*priority_order())


def alert_priority(alerts: DataFrame, slices: int | None = None) -> DataFrame:
    """Alerts with their position in the whole list, ranked without a single-task window."""
    return running_total(alerts, priority_keys(), rank_name="position", slices=slices)


def top_urgent(alerts: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` shortages, or reorders when there is no shortage.

    One pass: shortages sort before reorders, and of the ``n`` rows left only the first kind stays.
    """
    wanted = F.when(F.col("alert_type") == "shortage", 0).otherwise(1)
    buys = alerts.filter(F.col("alert_type").isin("shortage", "reorder")).withColumn("__kind", wanted)
    first = buys.orderBy("__kind", *priority_order()).limit(n)
    best = F.min("__kind").over(W.partitionBy())  # over `n` rows
    return first.withColumn("__best", best).filter("__kind = __best").drop("__kind", "__best")


def urgency_rank(urgency: Column) -> Column:
    return lookup(urgency, URGENCY_RANK, 0)


def alerts_by_supplier(alerts: DataFrame) -> DataFrame:
    """Items, quantity to buy and highest urgency per supplier over shortages and reorders.

    The items themselves are rows of ``supplier_alert_items``: one supplier may hold a third of
    all alerts, too many for one array.
    """
    buys = _supplier_rows(alerts)
    rank = F.struct(urgency_rank(F.col("urgency")), F.col("urgency"))
    return buys.groupBy("supplier").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("buy_qty").alias("total_buy"),
        F.max_by("urgency", rank).alias("max_urgency"),
    )


def supplier_alert_items(alerts: DataFrame) -> DataFrame:
    """The item list behind ``alerts_by_supplier``, one row per item."""
    return _supplier_rows(alerts).select("supplier", ITEM, "alert_type", "urgency", "buy_qty")


def _supplier_rows(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("alert_type").isin("shortage", "reorder")).withColumn(
        "supplier", F.coalesce("supplier", F.lit("unknown"))
    )


def alert_counts(alerts: DataFrame) -> DataFrame:
    """One row: alerts in total and per list."""
    kind = _list_name()
    return alerts.select(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("total_alerts"),
        *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("shortage", "reorder", "overstock", "expiry")],
    )
