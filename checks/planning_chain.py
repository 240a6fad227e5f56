"""Suppliers, matching, planning, alerts, purchases and KPIs: queries and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from checks.fixtures import AS_OF, Inputs
from checks.registry import query
from checks.sqlparts import plan_sql, purchases_sql
from granary.operators import (
    alerts as J,
    forecast as G,
    kpi as K,
    matching as M,
    overview as O,
    planning as P,
    purchasing as B,
    suppliers as E,
)
from granary.operators.quality import check_balance


# --- suppliers ----------------------------------------------------------------------
@query(
    "delivery_performance",
    """SELECT supplier, R(avg_delay) AS avg_delay, R(std_delay) AS std_delay, deliveries, R(on_time_share) AS on_time_share FROM delivery""",
    need="delivery",
)
def delivery_performance(i: Inputs):
    return E.delivery_performance(i.deliveries())


def scorecard(i: Inputs):
    return E.delivery_risk(E.delivery_performance(i.deliveries()))


@query(
    "delivery_risk",
    """SELECT supplier, R(on_time_share) AS on_time_share, delivery_risk FROM scorecard""",
    need="scorecard",
)
def delivery_risk(i: Inputs):
    return scorecard(i).select("supplier", "on_time_share", "delivery_risk")


@query(
    "high_risk_suppliers",
    """SELECT count(*) AS total_suppliers, count(*) FILTER (WHERE delivery_risk = 'high') AS high_risk FROM scorecard""",
    need="scorecard",
)
def high_risk_suppliers(i: Inputs):
    return E.high_risk_count(scorecard(i), "delivery_risk")


@query(
    "quality_performance",
    """SELECT supplier, R(qualified_qty) AS qualified_qty, delivered_qty, batches, R(quality_share) AS quality_share FROM quality""",
    need="quality",
    digits=5,
)
def quality_performance(i: Inputs):
    return E.quality_performance(i.deliveries())


@query("quality_risk", "SELECT supplier, R(quality_share) AS quality_share, quality_risk FROM quality", need="quality", digits=5)
def quality_risk(i: Inputs):
    return E.quality_risk(E.quality_performance(i.deliveries())).select("supplier", "quality_share", "quality_risk")


@query(
    "dependency",
    "SELECT supplier, items, total_out, R(item_share) AS item_share, dependency_risk FROM dependence",
    need="dependence",
)
def dependency(i: Inputs):
    return E.dependency(i.deliveries())


@query(
    "dependency_by_nation",
    """SELECT n_name, items, total_out, R(item_share) AS item_share,
    CASE WHEN item_share >= 0.3 THEN 'high' WHEN item_share >= 0.1 THEN 'medium' ELSE 'low' END AS dependency_risk
    FROM (SELECT n_name, count(DISTINCT item_code) AS items, sum(out_qty) AS total_out,
                 CAST(count(DISTINCT item_code) AS DOUBLE) / (SELECT count(DISTINCT item_code) FROM deliveries) AS item_share
          FROM deliveries JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)""",
    need="deliveries",
)
def dependency_by_nation(i: Inputs):
    nations = i.table("supplier").join(i.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = i.deliveries().join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
    return E.dependency(rows, by="n_name")


@query(
    "risk_summary",
    """SELECT count(*) FILTER (WHERE level = 'low') AS low_count, count(*) FILTER (WHERE level = 'medium') AS medium_count,
    count(*) FILTER (WHERE level = 'high') AS high_count, 3 AS dimensions,
    count(*) FILTER (WHERE level = 'high') || ' high-risk scores: review these suppliers now' AS recommendation
    FROM (SELECT delivery_risk AS level FROM scorecard UNION ALL SELECT quality_risk FROM quality UNION ALL SELECT dependency_risk FROM dependence)""",
    need="scorecard quality dependence",
)
def risk_summary(i: Inputs):
    return E.risk_summary(cards=E.scorecards(i.deliveries()))


@query(
    "scorecards",
    """SELECT supplier, R(s.avg_delay) AS avg_delay, R(s.std_delay) AS std_delay, s.deliveries, R(s.on_time_share) AS on_time_share, s.delivery_risk,
    R(q.quality_share) AS quality_share, q.quality_risk, d.items, R(d.item_share) AS item_share, d.dependency_risk
    FROM scorecard s JOIN quality q USING (supplier) JOIN dependence d USING (supplier)""",
    need="scorecard quality dependence",
)
def scorecards(i: Inputs):
    shown = ("avg_delay", "std_delay", "deliveries", "on_time_share", "delivery_risk", "quality_share", "quality_risk", "items", "item_share", "dependency_risk")
    return E.scorecards(i.deliveries()).select("supplier", *shown)


@query(
    "supplier_columns",
    """SELECT supplier, count(*) AS deliveries, sum(delivered_qty) AS delivered_qty FROM deliveries GROUP BY 1""",
    need="deliveries",
)
def supplier_columns(i: Inputs):
    named = {"supplier": "供应商", "planned_date": "计划交期", "actual_date": "实际日期", "delivered_qty": "交货数量", "item_code": "物料编码"}
    found = E.resolve_supplier_columns(i.deliveries().withColumnsRenamed(named))
    return found.groupBy("supplier").agg(F.count("item_code").alias("deliveries"), F.sum("delivered_qty").alias("delivered_qty"))


# --- matching -----------------------------------------------------------------------
@query(
    "normalize_demand",
    "SELECT item_code, CAST(demand_qty AS DOUBLE) AS demand_qty FROM demand",
    need="demand",
)
def normalize_demand(i: Inputs):
    return M.normalize_demand(i.demand().withColumnsRenamed({"item_code": "material_code", "demand_qty": "需求数量"}))


@query(
    "supply_position",
    "SELECT item_code, opening_qty, on_hand_qty, in_transit_qty, on_hand_qty + in_transit_qty AS total_supply FROM stock",
    need="stock",
)
def supply_position(i: Inputs):
    return M.supply_position(i.stock())


def matched(i: Inputs):
    return M.match_supply_demand(M.supply_position(i.stock()), i.demand())


@query(
    "match_supply_demand",
    """SELECT item_code, has_demand, demand_qty, on_hand_qty, in_transit_qty, total_supply, gap_qty, R(gap_ratio) AS gap_ratio FROM matched""",
    need="matched",
)
def match_supply_demand(i: Inputs):
    return matched(i).drop("opening_qty", "gap_status")


@query("gap_status", "SELECT item_code, gap_status FROM matched", need="matched")
def gap_status(i: Inputs):
    return matched(i).select("item_code", "gap_status")


@query(
    "gap_totals",
    """SELECT sum(demand_qty) AS total_demand, sum(total_supply) AS total_supply, sum(gap_qty) AS total_gap, count(*) AS total_items,
    count(*) FILTER (WHERE gap_status = 'short') AS short_items, count(*) FILTER (WHERE gap_qty < 0) AS surplus_items,
    R(sum(gap_qty) / sum(demand_qty)) AS gap_ratio FROM matched""",
    need="matched",
)
def gap_totals(i: Inputs):
    return M.gap_totals(matched(i))


@query("shortages", "SELECT item_code, gap_qty FROM matched WHERE gap_status = 'short'", need="matched")
def shortages(i: Inputs):
    return M.shortages(matched(i)).select("item_code", "gap_qty")


@query("surplus", "SELECT item_code, gap_qty FROM matched WHERE gap_qty < 0", need="matched")
def surplus(i: Inputs):
    return M.surplus(matched(i)).select("item_code", "gap_qty")


@query("items_by_gap", "SELECT item_code, gap_qty, gap_status FROM matched", need="matched")
def items_by_gap(i: Inputs):
    return M.by_gap(matched(i)).select("item_code", "gap_qty", "gap_status")


@query(
    "allocate_shortages",
    """SELECT item_code, gap_qty, supplier, R(on_time_share) AS on_time_share, delivery_risk FROM matched,
    (SELECT * FROM scorecard ORDER BY on_time_share DESC, supplier LIMIT 1) WHERE gap_status = 'short'""",
    need="matched scorecard",
)
def allocate_shortages(i: Inputs):
    return M.allocate_shortages(matched(i), scorecard(i))


@query(
    "allocation_status",
    "SELECT count(*) FILTER (WHERE gap_status = 'short') AS allocations, 'completed' AS status FROM matched",
    need="matched",
)
def allocation_status(i: Inputs):
    return M.allocation_status(matched(i))


# --- planning -----------------------------------------------------------------------
def plan(i: Inputs, **options) -> DataFrame:
    return P.plan_inventory(
        i.stock_weekly(), i.master(), i.classes(), i.given_forecasts(), calendar=i.calendar(), **options
    )


@query(
    "demand_variability",
    "SELECT item_code, R(mean_out) AS mean_out, R(std_all) AS std_all, R(std_nonzero) AS std_nonzero, balance FROM spread",
    need="spread",
)
def demand_variability(i: Inputs):
    return P.demand_variability(i.weekly())


_PLAN = """SELECT item_code, lifecycle, combo, service_level, R(mean_out) AS mean_out, R(std_out) AS std_out, R(forecast) AS forecast,
    R(safety_stock) AS safety_stock, R(reorder_point) AS reorder_point, R(eoq) AS eoq, R(max_stock) AS max_stock, balance,
    R(stock_level_pct) AS stock_level_pct, status, R(holding_cost) AS holding_cost, R(ordering_cost) AS ordering_cost,
    R(holding_cost + ordering_cost) AS total_cost FROM {source}"""
_PLAN_COLUMNS = ("item_code", "lifecycle", "combo", "service_level", "mean_out", "std_out", "forecast", "safety_stock",
                 "reorder_point", "eoq", "max_stock", "balance", "stock_level_pct", "status", "holding_cost",
                 "ordering_cost", "total_cost")


@query("plan_inventory", _PLAN.format(source="plan"), need="plan")
def plan_inventory(i: Inputs):
    return plan(i).select(*_PLAN_COLUMNS)


@query(
    "plan_variable_lead_time",
    _PLAN.format(source="(" + plan_sql(variable="0.5", lead=2) + ")"),
    need="spread classes given master",
)
def plan_variable_lead_time(i: Inputs):
    return plan(i, lead_time=2, sigma_lt=0.5).select(*_PLAN_COLUMNS)


@query(
    "plan_nonzero_deviation",
    _PLAN.format(source="(" + plan_sql(std="CASE WHEN g.method = 'tsb' AND std_nonzero > 0 THEN std_nonzero ELSE std_all END") + ")"),
    need="spread classes given master",
)
def plan_nonzero_deviation(i: Inputs):
    return plan(i, std_method="std_nonzero").select(*_PLAN_COLUMNS)


@query(
    "service_level",
    """SELECT item_code, CASE c.combo WHEN 'AX' THEN 0.99 WHEN 'AY' THEN 0.97 WHEN 'AZ' THEN 0.95 WHEN 'BX' THEN 0.97 WHEN 'BY' THEN 0.95
    WHEN 'BZ' THEN 0.9 WHEN 'CX' THEN 0.95 WHEN 'CY' THEN 0.9 ELSE 0.85 END::DOUBLE AS service_level,
    CASE c.combo WHEN 'AX' THEN 2.33 WHEN 'AY' THEN 1.88 WHEN 'AZ' THEN 1.65 WHEN 'BX' THEN 1.88 WHEN 'BY' THEN 1.65
    WHEN 'BZ' THEN 1.28 WHEN 'CX' THEN 1.65 WHEN 'CY' THEN 1.28 ELSE 1.04 END::DOUBLE AS z_value FROM classes c""",
    need="classes",
)
def service_level(i: Inputs):
    level = P.service_level(F.col("combo"))
    return i.classes().select("item_code", level.alias("service_level"), P.service_z(level).alias("z_value"))


@query(
    "policy",
    """SELECT item_code, CASE WHEN lifecycle = 'launch' THEN 'fixed_period' WHEN lifecycle <> 'active' THEN 'variable'
      WHEN combo IN ('AX', 'BX') THEN 'fixed_period_fixed_qty' WHEN combo IN ('AY', 'BY') THEN 'fixed_period'
      WHEN combo = 'CX' THEN 'fixed_qty' ELSE 'variable' END AS policy_type,
    CAST(CASE WHEN lifecycle = 'launch' THEN 1 WHEN lifecycle <> 'active' THEN NULL WHEN combo = 'BY' THEN 2
      WHEN combo IN ('AX', 'AY', 'BX') THEN 1 END AS INTEGER) AS period_weeks FROM plan""",
    need="plan",
)
def policy(i: Inputs):
    return plan(i).select("item_code", "policy_type", "period_weeks")


@query(
    "future_reorder_points",
    """SELECT item_code, CAST(w AS INTEGER) AS week_offset, R(forecast) AS forecast, R(forecast + ss1) AS reorder_point
    FROM plan, (SELECT unnest([1, 2, 3, 4]) AS w) WHERE policy <> 'o'""",
    need="plan",
)
def future_reorder_points(i: Inputs):
    return plan(i).select("item_code", F.inline("future_rop"))


@query(
    "shelf_life_caps",
    """SELECT item_code, R(ss1) AS safety_stock, R(max1) AS max_stock FROM plan WHERE lifecycle = 'active' AND (ss1 < ss0 OR max1 < max0)""",
    need="plan",
)
def shelf_life_caps(i: Inputs):
    capped = plan(i).filter("lifecycle = 'active'")
    free = P.plan_inventory(
        i.stock_weekly(), i.master().drop("shelf_life_days"), i.classes(), i.given_forecasts(), calendar=i.calendar()
    )
    free = free.select("item_code", F.col("safety_stock").alias("free_ss"), F.col("max_stock").alias("free_max"))
    both = capped.join(free, "item_code").filter("safety_stock < free_ss or max_stock < free_max")
    return both.select("item_code", "safety_stock", "max_stock")


@query("plan_counts", "SELECT status, count(*) AS items FROM plan GROUP BY 1", need="plan")
def plan_counts(i: Inputs):
    return P.plan_counts(plan(i))


# --- alerts -------------------------------------------------------------------------
def alerts(i: Inputs) -> DataFrame:
    return J.generate_alerts(
        plan(i), i.sparse_weekly(), AS_OF, 1, i.item_transit(), i.preferred_suppliers(), i.supplier_transit(), i.calendar()
    )


_ALERT = """SELECT item_code, abc_class, alert_type, urgency, R(quantity) AS quantity, R(buy_qty) AS buy_qty, action, in_transit_qty,
    supplier, stockout_date, order_by_date, demand_arrow FROM alerts"""
_ALERT_COLUMNS = ("item_code", "abc_class", "alert_type", "urgency", "quantity", "buy_qty", "action", "in_transit_qty",
                  "supplier", "stockout_date", "order_by_date", "demand_arrow")


@query("generate_alerts", _ALERT, need="alerts")
def generate_alerts(i: Inputs):
    return alerts(i).select(*_ALERT_COLUMNS)


def _kind(name: str, kinds: str):
    @query(name, _ALERT + f" WHERE alert_type IN ({kinds})", need="alerts")
    def of_kind(i: Inputs):
        return J.of_type(alerts(i), name.removesuffix("_alerts")).select(*_ALERT_COLUMNS)


_kind("shortage_alerts", "'shortage'")
_kind("reorder_alerts", "'reorder'")
_kind("overstock_alerts", "'overstock', 'clearance'")
_kind("clearance_alerts", "'clearance'")
_kind("expiry_alerts", "'expiry'")


@query(
    "stockout_projection",
    """SELECT item_code, R(balance / mean_out) AS weeks_left, DATE '2001-11-05' + CAST(floor(balance / mean_out * 7) AS INTEGER) AS stockout_date,
    DATE '2001-11-05' + CAST(floor(greatest(0, balance / mean_out - 2) * 7) AS INTEGER) AS order_by_date, 'projected' AS projection_note FROM spread""",
    need="spread",
)
def stockout_projection(i: Inputs):
    rows = P.demand_variability(i.weekly()).withColumn("in_transit_qty", F.lit(0.0))
    shown = J.stockout_projection(rows, AS_OF, 2)
    return shown.select("item_code", "weeks_left", "stockout_date", "order_by_date", "projection_note")


@query("demand_arrow", "SELECT * FROM arrows", need="arrows")
def demand_arrow(i: Inputs):
    return J.demand_arrow(i.dense_weekly())


@query("in_transit_lookup", "SELECT item_code, supplier, in_transit_qty FROM transit", need="transit")
def in_transit_lookup(i: Inputs):
    items = i.summary().select("item_code")
    return J.in_transit_lookup(items, i.item_transit(), i.preferred_suppliers(), i.supplier_transit())


_RANK = """SELECT *, row_number() OVER (ORDER BY CASE WHEN alert_type = 'clearance' THEN 'overstock' ELSE alert_type END,
    CASE WHEN alert_type IN ('overstock', 'clearance') THEN 0 WHEN urgency IN ('urgent', 'this_week', 'high') THEN 0 ELSE 1 END,
    round(CASE WHEN alert_type = 'expiry' THEN -days_left ELSE quantity END, 9) DESC, item_code) AS position FROM alerts"""


@query("alert_priority", f"SELECT item_code, alert_type, position FROM ({_RANK})", need="alerts")
def alert_priority(i: Inputs):
    rows = alerts(i).withColumn("quantity", F.round("quantity", 9))
    return J.alert_priority(rows).select("item_code", "alert_type", "position")


@query(
    "top_urgent",
    f"SELECT item_code, alert_type, urgency FROM ({_RANK}) WHERE alert_type = 'shortage' ORDER BY position LIMIT 5",
    need="alerts",
)
def top_urgent(i: Inputs):
    rows = alerts(i).withColumn("quantity", F.round("quantity", 9))
    return J.top_urgent(rows).select("item_code", "alert_type", "urgency")


_URGENCY = "CASE urgency WHEN 'urgent' THEN 3 WHEN 'important' THEN 2 WHEN 'this_week' THEN 2 WHEN 'this_month' THEN 1 ELSE 0 END"


@query(
    "alerts_by_supplier",
    f"""SELECT coalesce(supplier, 'unknown') AS supplier, count(*) AS items, R(sum(buy_qty)) AS total_buy,
    arg_max(urgency, ({_URGENCY}, urgency)) AS max_urgency FROM alerts WHERE alert_type IN ('shortage', 'reorder') GROUP BY 1""",
    need="alerts",
    digits=5,
)
def alerts_by_supplier(i: Inputs):
    return J.alerts_by_supplier(alerts(i))


@query(
    "supplier_alert_items",
    """SELECT coalesce(supplier, 'unknown') AS supplier, item_code, alert_type, urgency, R(buy_qty) AS buy_qty FROM alerts
    WHERE alert_type IN ('shortage', 'reorder')""",
    need="alerts",
)
def supplier_alert_items(i: Inputs):
    return J.supplier_alert_items(alerts(i))


@query(
    "alert_counts",
    """SELECT count(*) AS total_alerts, count(*) FILTER (WHERE alert_type = 'shortage') AS shortage_count,
    count(*) FILTER (WHERE alert_type = 'reorder') AS reorder_count,
    count(*) FILTER (WHERE alert_type IN ('overstock', 'clearance')) AS overstock_count,
    count(*) FILTER (WHERE alert_type = 'expiry') AS expiry_count FROM alerts""",
    need="alerts",
)
def alert_counts(i: Inputs):
    return J.alert_counts(alerts(i))


# --- purchases ----------------------------------------------------------------------
def purchases(i: Inputs, formula: str = "full", own_plan: bool = False) -> DataFrame:
    demand = i.demand().withColumn("has_demand", F.lit(True))
    other = plan(i) if own_plan else None
    return B.purchase_plan(alerts(i), demand, other, scorecard(i), moq=20.0, as_of=AS_OF, formula=formula)


_BUY = """SELECT item_code, abc_class, alert_type, urgency, R(needed_qty) AS needed_qty, R(order_qty) AS order_qty, order_date,
    CAST(warnings AS INTEGER) AS warnings, CAST(priority AS INTEGER) AS priority FROM {source}"""


def _bought(rows: DataFrame) -> DataFrame:
    return rows.withColumn("warnings", F.size("warnings")).select(
        "item_code", "abc_class", "alert_type", "urgency", "needed_qty", "order_qty", "order_date", "warnings", "priority"
    )


@query("purchase_plan", _BUY.format(source="purchases"), need="purchases")
def purchase_plan(i: Inputs):
    return _bought(purchases(i))


@query("purchase_plan_net", _BUY.format(source="(" + purchases_sql("net") + ")"), need="alerts demand")
def purchase_plan_net(i: Inputs):
    return _bought(purchases(i, "net", own_plan=True))


@query(
    "purchase_qty",
    "SELECT item_code, R(needed_qty) AS needed_qty FROM purchases",
    need="purchases",
)
def purchase_qty(i: Inputs):
    return purchases(i).select("item_code", "needed_qty")


# the texts of both checks, in their order
WARNINGS = """SELECT item_code, alert_type, CAST(row_number() OVER (PARTITION BY item_code ORDER BY kind) - 1 AS INTEGER) AS position, warning FROM (
    SELECT item_code, alert_type, 1 AS kind, 'order of ' || printf('%.2f', needed_qty) || ' is far below EOQ ' || printf('%.2f', eoq) || ': combine orders' AS warning
    FROM purchases WHERE eoq > 0 AND needed_qty > 0 AND needed_qty < eoq * 0.5
    UNION ALL SELECT item_code, alert_type, 2, 'order of ' || printf('%.2f', needed_qty) || ' raised to the minimum order 20.00' FROM purchases WHERE needed_qty < 20)"""


@query("purchase_warnings", f"SELECT item_code, position, warning FROM ({WARNINGS})", need="purchases")
def purchase_warnings(i: Inputs):
    return purchases(i).select("item_code", F.posexplode("warnings").alias("position", "warning"))


@query("order_dates", "SELECT item_code, urgency, order_date FROM purchases", need="purchases")
def order_dates(i: Inputs):
    return purchases(i).select("item_code", "urgency", "order_date")


@query(
    "assign_suppliers",
    """SELECT item_code, abc_class, s.supplier, role, share, R(order_qty * share) AS quantity, R(on_time_share) AS on_time_share
    FROM purchases p JOIN (SELECT *, row_number() OVER (ORDER BY on_time_share DESC, supplier) AS place FROM scorecard) s ON true
    JOIN (VALUES ('A', 1, 'primary', 0.7::DOUBLE), ('A', 2, 'backup', 0.3), ('-', 1, 'single', 1.0)) r(cls, place, role, share)
      ON r.place = s.place AND r.cls = CASE WHEN p.abc_class = 'A' THEN 'A' ELSE '-' END""",
    need="purchases scorecard",
)
def assign_suppliers(i: Inputs):
    return B.assign_suppliers(purchases(i))


@query(
    "purchase_summary",
    """SELECT count(*) AS total_items, count(*) FILTER (WHERE urgency = 'urgent') AS urgent_count,
    count(*) FILTER (WHERE urgency = 'this_week') AS weekly_count, count(*) FILTER (WHERE urgency = 'this_month') AS monthly_count,
    R(sum(order_qty)) AS total_qty FROM purchases""",
    need="purchases",
    digits=4,
)
def purchase_summary(i: Inputs):
    return B.purchase_summary(purchases(i))


@query(
    "top_purchases",
    "SELECT item_code, CAST(priority AS INTEGER) AS priority FROM purchases WHERE urgency = 'urgent' ORDER BY priority DESC, item_code LIMIT 10",
    need="purchases",
)
def top_purchases(i: Inputs):
    return B.top_purchases(purchases(i)).select("item_code", "priority")


@query("first_warnings", f"SELECT item_code, alert_type, position, warning FROM ({WARNINGS}) ORDER BY alert_type DESC, item_code, position LIMIT 10", need="purchases")
def first_warnings(i: Inputs):
    return B.first_warnings(purchases(i)).select("item_code", "alert_type", "position", "warning")


# --- KPIs ---------------------------------------------------------------------------
@query(
    "supplier_forecast_share",
    """SELECT item_code, R(f.forecast) AS forecast, f.trend,
    printf('%.2f', greatest(0, f.forecast - 1.65 * std_out * sqrt(1 + 1.0 / points))) || ' ~ ' || printf('%.2f', f.forecast + 1.65 * std_out * sqrt(1 + 1.0 / points)) AS "interval"
    FROM longf f JOIN stats USING (item_code) ORDER BY item_code LIMIT 20""",
    need="longf stats",
    digits=4,
)
def supplier_forecast_share(i: Inputs):
    return K.supplier_forecast_share(G.forecast_demand(i.sparse_weekly(), calendar=i.calendar()))


@query(
    "annual_budget",
    """SELECT count(*) AS total_items, R(sum(holding_cost)) AS holding_cost, R(sum(ordering_cost)) AS ordering_cost,
    R(sum(holding_cost) + sum(ordering_cost)) AS total_cost FROM plan""",
    need="plan",
    digits=3,
)
def annual_budget(i: Inputs):
    return K.annual_budget(plan(i))


# One run per year: the same KPIs from the order lines of that year.
RUNS = """SELECT year(d) - 1990 AS run, item_code, sum(q) AS out_qty, sum(qin) AS in_qty FROM lines
    WHERE item_code LIKE 'P%' GROUP BY 1, 2"""
HISTORY = f"""SELECT run, unnest(['risk_count', 'reorder_count', 'overstock_count', 'total_alerts', 'avg_mae']) AS metric,
    unnest([CAST(count(*) FILTER (WHERE out_qty > 200) AS DOUBLE), count(*) FILTER (WHERE out_qty BETWEEN 100 AND 200),
            count(*) FILTER (WHERE in_qty > 100000), count(*) FILTER (WHERE in_qty > 60), avg(in_qty)]) AS value
    FROM ({RUNS}) GROUP BY 1"""


def history(i: Inputs) -> DataFrame:
    runs = i.daily("P").groupBy((F.year("date") - 1990).alias("run"), "item_code").agg(
        F.sum("out_qty").alias("out_qty"), F.sum("in_qty").alias("in_qty")
    )
    wide = runs.groupBy("run").agg(
        F.count_if(F.col("out_qty") > 200).cast("double").alias("risk_count"),
        F.count_if(F.col("out_qty").between(100, 200)).cast("double").alias("reorder_count"),
        F.count_if(F.col("in_qty") > 100000).cast("double").alias("overstock_count"),
        F.count_if(F.col("in_qty") > 60).cast("double").alias("total_alerts"),
        F.avg("in_qty").alias("avg_mae"),
    )
    return wide.unpivot(["run"], wide.columns[1:], "metric", "value")


@query(
    "kpi_history",
    f"SELECT CAST(run AS INTEGER) AS run, metric, R(value) AS value FROM ({HISTORY}) WHERE run > (SELECT max(run) - 4 FROM ({RUNS}))",
    need="lines",
)
def kpi_history(i: Inputs):
    return K.kpi_history(history(i), keep=4)


@query(
    "kpi_compare",
    f"""SELECT CAST(run AS INTEGER) AS run, metric, value, previous, R(CASE WHEN previous > 0 THEN (value - previous) / previous * 100 ELSE 0 END) AS change_pct,
    CASE WHEN previous = 0 THEN 'first_record' WHEN value < previous THEN 'improved' WHEN value > previous THEN 'worse' ELSE 'same' END AS trend
    FROM (SELECT *, coalesce(lag(value) OVER (PARTITION BY metric ORDER BY run), 0) AS previous FROM ({HISTORY}) WHERE metric <> 'avg_mae')""",
    need="lines",
)
def kpi_compare(i: Inputs):
    return K.kpi_compare(history(i))


@query(
    "kpi_snapshot",
    """SELECT 1 AS run, metric, R(value) AS value FROM (
      SELECT 'forecasted_items' AS metric, CAST(count(*) AS DOUBLE) AS value FROM longf
      UNION ALL SELECT 'avg_mae', avg(mae) FROM (SELECT avg(abs(forecast - week_out)) AS mae FROM longf JOIN dense USING (item_code) GROUP BY item_code)
      UNION ALL SELECT 'risk_count', count(*) FILTER (WHERE status = 'shortage_risk') FROM plan
      UNION ALL SELECT 'reorder_count', count(*) FILTER (WHERE status = 'reorder') FROM plan
      UNION ALL SELECT 'overstock_count', count(*) FILTER (WHERE status = 'overstock') FROM plan
      UNION ALL SELECT 'total_alerts', count(*) FROM alerts)""",
    need="longf plan alerts",
    digits=5,
)
def kpi_snapshot(i: Inputs):
    return K.kpi_snapshot(G.forecast_demand(i.sparse_weekly(), calendar=i.calendar()), plan(i), alerts(i), run=1)


HEADLINE = """
      SELECT 'data_quality_issues' AS metric, CAST(count(*) FILTER (WHERE item_code LIKE 'P%' AND k % 97 = 0) AS DOUBLE) AS value FROM summary
      UNION ALL SELECT 'total_opening', sum(opening_qty) FROM summary
      UNION ALL SELECT 'total_closing', sum(closing_qty) FROM summary
      UNION ALL SELECT 'unique_items', count(DISTINCT item_code) FROM summary
      UNION ALL SELECT 'total_alerts', count(*) FROM alerts
      UNION ALL SELECT 'shortage_count', count(*) FROM alerts WHERE alert_type = 'shortage'
      UNION ALL SELECT 'reorder_count', count(*) FROM alerts WHERE alert_type = 'reorder'
      UNION ALL SELECT 'overstock_count', count(*) FROM alerts WHERE alert_type IN ('overstock', 'clearance')
      UNION ALL SELECT 'purchase_items', count(*) FROM purchases
      UNION ALL SELECT 'urgent_purchases', count(*) FROM purchases WHERE urgency = 'urgent'
      UNION ALL SELECT 'total_purchase_qty', sum(order_qty) FROM purchases"""


def headline(i: Inputs) -> DataFrame:
    issues = check_balance(i.summary("P", unbalanced=True))
    return K.headline_metrics(i.summary(), issues, J.alert_counts(alerts(i)), purchases(i))


@query("headline_metrics", f"SELECT metric, R(value) AS value FROM ({HEADLINE})", need="summary alerts purchases", digits=4)
def headline_metrics(i: Inputs):
    return headline(i)


@query(
    "next_actions",
    f"""SELECT CAST(step AS INTEGER) AS step, CAST(CAST(value AS BIGINT) AS VARCHAR) || text AS action FROM ({HEADLINE})
    JOIN (VALUES ('data_quality_issues', 1, ' data quality issues: review the error report'), ('shortage_count', 2, ' shortage alerts: review and order now'),
    ('overstock_count', 3, ' overstock alerts: decide how to reduce'), ('urgent_purchases', 4, ' urgent purchases: place the orders today')) a(metric, step, text)
    USING (metric) WHERE value > 0""",
    need="summary alerts purchases",
)
def next_actions(i: Inputs):
    return K.next_actions(headline(i))
