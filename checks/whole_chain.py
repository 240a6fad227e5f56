"""The chain from weekly table to purchases, and from ledger files to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import AS_OF, Inputs
from checks.ledgers import DAY, ONE, SUMMARY, WIDTH, YEAR, _scratch, ledger_folder
from checks.planning_chain import scorecard
from checks.registry import query
from checks.sqlparts import CTES, plan_sql, purchases_sql
from granary.plans.chain import ingest_ledgers, replenish
from granary.sources.tables import write_table

CTES["classes2"] = """
        SELECT s.item_code, CASE WHEN cum_share <= 0.7 THEN 'A' WHEN cum_share <= 0.9 THEN 'B' ELSE 'C' END
               || CASE WHEN std_out / mean_out <= 0.3 THEN 'X' WHEN std_out / mean_out <= 0.8 THEN 'Y' ELSE 'Z' END AS combo
        FROM stats s JOIN (SELECT item_code, CAST(sum(out_amount) OVER (ORDER BY out_amount DESC, item_code ROWS BETWEEN UNBOUNDED PRECEDING
                                  AND CURRENT ROW) AS DOUBLE) / CAST(sum(out_amount) OVER () AS DOUBLE) AS cum_share FROM summary) USING (item_code)"""
CTES["given2"] = """
        SELECT l.item_code, CASE WHEN lifecycle IN ('obsolete', 'phase_out') THEN 0 ELSE forecast END AS forecast,
               CASE lifecycle WHEN 'obsolete' THEN 'obsolete' WHEN 'phase_out' THEN 'clearance' ELSE method END AS method
        FROM longf l JOIN master USING (item_code)"""
CTES["plan2"] = plan_sql().replace("classes c", "classes2 c").replace("given g", "given2 g")
CTES["alerts2"] = CTES["alerts"].replace("FROM plan p", "FROM plan2 p")
CTES["purchases2"] = purchases_sql().replace("FROM alerts a", "FROM alerts2 a")


def chain(i: Inputs):
    # balances, lifecycle, amounts and transit all start from the summary: the line items are added up to it once
    i.kept["PS"] = i.spark.read.parquet(_scratch(i, "summary", lambda p: write_table(i.summary(), p)))
    stored = _scratch(i, "moves", lambda p: write_table(i.stock_weekly(), p))
    weekly = i.spark.read.parquet(stored)
    summary = i.summary().join(i.master(), "item_code")
    demand = i.demand().withColumn("has_demand", F.lit(True))
    return replenish(
        weekly, summary, scorecard(i), demand, in_transit=i.item_transit(), item_supplier=i.preferred_suppliers(),
        supplier_in_transit=i.supplier_transit(), as_of=AS_OF, moq=20.0, calendar=i.calendar(),
    )


@query(
    "replenish_plan",
    """SELECT item_code, combo, R(forecast) AS forecast, R(safety_stock) AS safety_stock, R(reorder_point) AS reorder_point,
    R(max_stock) AS max_stock, status FROM plan2""",
    need="plan2",
    digits=4,
)
def replenish_plan(i: Inputs):
    return chain(i).plan.select("item_code", "combo", "forecast", "safety_stock", "reorder_point", "max_stock", "status")


@query(
    "replenish_purchases",
    """SELECT item_code, alert_type, urgency, R(order_qty) AS order_qty, order_date, CAST(priority AS INTEGER) AS priority FROM purchases2""",
    need="purchases2",
    digits=4,
)
def replenish_purchases(i: Inputs):
    return chain(i).purchases.select("item_code", "alert_type", "urgency", "order_qty", "order_date", "priority")


@query(
    "ingest_ledgers",
    f"""SELECT s.item_code, s.opening_qty, s.closing_qty, 'active' AS lifecycle, w.weeks, w.week_out FROM ({ONE}) s
    JOIN (SELECT item_code, count(DISTINCT weekofyear(date)) AS weeks, sum(out_qty) AS week_out FROM ({DAY}) GROUP BY 1) w USING (item_code)""",
)
def ingest(i: Inputs):
    import uuid

    done = ingest_ledgers(i.spark, ledger_folder(i), f"granary-rows-{uuid.uuid4().hex}", width=WIDTH, reference_year=YEAR)
    per_item = done.weekly.groupBy("item_code").agg(F.count("week_key").alias("weeks"), F.sum("week_out").alias("week_out"))
    return done.summary.select("item_code", "opening_qty", "closing_qty", "lifecycle").join(per_item, "item_code")
