"""Reports over a run: supplier view, budget, KPI snapshot, comparison and next actions."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from granary.functions.numeric import filled, first_match
from granary.schema import ITEM

COMPARED = ("risk_count", "reorder_count", "overstock_count", "total_alerts")
# metric -> message of the next-action rules
ACTIONS = {
    "data_quality_issues": "%d data quality issues: review the error report",
    "shortage_count": "%d shortage alerts: review and order now",
    "overstock_count": "%d overstock alerts: decide how to reduce",
    "urgent_purchases": "%d urgent purchases: place the orders today",
}
NO_ACTION = "stock is in good shape: keep the regular review"


def supplier_forecast_share(forecasts: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` items with forecast, trend and interval text, for suppliers."""
    interval = F.format_string("%.2f ~ %.2f", "lower", "upper")
    return forecasts.orderBy(ITEM).limit(n).select(ITEM, "forecast", "trend", interval.alias("interval"))


def annual_budget(plan: DataFrame) -> DataFrame:
    """One row: yearly holding, ordering and total cost."""
    sums = plan.agg(
        F.count(F.lit(1)).alias("total_items"),
        filled(F.sum("holding_cost")).alias("holding_cost"),
        filled(F.sum("ordering_cost")).alias("ordering_cost"),
    )
    return sums.withColumn("total_cost", F.col("holding_cost") + F.col("ordering_cost"))


def _long(frame: DataFrame, run: Column | None = None) -> DataFrame:
    """A one-row frame of numbers as (metric, value) rows."""
    names = frame.columns
    wide = frame.select(*[F.col(c).cast("double").alias(c) for c in names])
    return wide.unpivot([], names, "metric", "value")


def kpi_snapshot(forecasts: DataFrame, plan: DataFrame, alerts: DataFrame, run: int) -> DataFrame:
    """KPIs of one run as (run, metric, value)."""
    parts = [
        forecasts.agg(F.count(F.lit(1)).alias("forecasted_items"), filled(F.avg("mae")).alias("avg_mae")),
        plan.agg(
            F.count_if(F.col("status") == "shortage_risk").alias("risk_count"),
            F.count_if(F.col("status") == "reorder").alias("reorder_count"),
            F.count_if(F.col("status") == "overstock").alias("overstock_count"),
        ),
        alerts.agg(F.count(F.lit(1)).alias("total_alerts")),
    ]
    rows = reduce(DataFrame.unionByName, [_long(p) for p in parts])
    return rows.select(F.lit(run).alias("run"), "metric", "value")


def kpi_history(history: DataFrame, keep: int = 10) -> DataFrame:
    """The KPI rows of the latest ``keep`` runs."""
    kept = history.select("run").distinct().orderBy(F.desc("run")).limit(keep)
    return history.join(F.broadcast(kept), "run", "left_semi")  # at most `keep` rows


def kpi_compare(history: DataFrame, keep: int = 10) -> DataFrame:
    """Each compared KPI of each kept run against the run before.

    A previous value of zero counts as a first record.
    """
    rows = kpi_history(history, keep).filter(F.col("metric").isin(*COMPARED))
    runs = W.partitionBy("metric").orderBy("run")  # `keep` rows per metric
    previous, change = F.col("previous"), F.col("change_pct")
    known = F.coalesce(previous > 0, F.lit(False))
    return (
        rows.withColumn("previous", F.coalesce(F.lag("value").over(runs), F.lit(0.0)))
        .withColumn(
            "change_pct",
            F.when(known, F.try_divide(F.col("value") - previous, previous) * 100).otherwise(F.lit(0.0)),
        )
        .withColumn(
            "trend",
            first_match([(~known, "first_record"), (change < 0, "improved"), (change > 0, "worse")], "same"),
        )
    )


def append_kpis(snapshot: DataFrame, path: str) -> str:
    """Append the runs of ``snapshot`` to the KPI table in ``path``; the name of the batch.

    The rows are written first, under a batch of their own; a manifest row per run then makes them count. A run that is
    appended again, at another time or at the same one, counts once: readers take its first batch in the order of names
    (they begin with the time). A batch without a manifest row, left by a job that failed, is never read.
    """
    batch = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    snapshot.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{path}/rows")
    written = snapshot.sparkSession.read.parquet(f"{path}/rows").where(F.col("batch") == batch)
    written.select("run", "batch").distinct().coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return batch


def read_kpis(spark: SparkSession, path: str) -> DataFrame:
    """The rows of every run once."""
    counted = spark.read.parquet(f"{path}/manifest").groupBy("run").agg(F.min("batch").alias("batch"))
    return spark.read.parquet(f"{path}/rows").join(counted, ["run", "batch"]).drop("batch")


def headline_metrics(
    summary: DataFrame | None = None,
    errors: DataFrame | None = None,
    alert_counts: DataFrame | None = None,
    purchases: DataFrame | None = None,
    raw_rows: DataFrame | None = None,
) -> DataFrame:
    """(metric, value) rows of the final report; a missing input leaves its metrics out."""
    parts = []
    if raw_rows is not None:
        parts.append(
            raw_rows.agg(F.countDistinct("file").alias("source_files"), F.count(F.lit(1)).alias("total_rows_raw"))
        )
    if errors is not None:
        parts.append(errors.agg(F.count(F.lit(1)).alias("data_quality_issues")))
    if summary is not None:
        parts.append(
            summary.agg(
                filled(F.sum("opening_qty")).alias("total_opening"),
                filled(F.sum("closing_qty")).alias("total_closing"),
                F.countDistinct(ITEM).alias("unique_items"),
            )
        )
    if alert_counts is not None:
        parts.append(alert_counts.select("total_alerts", "shortage_count", "reorder_count", "overstock_count"))
    if purchases is not None:
        parts.append(
            purchases.agg(
                F.count(F.lit(1)).alias("purchase_items"),
                F.count_if(F.col("urgency") == "urgent").alias("urgent_purchases"),
                filled(F.sum("order_qty")).alias("total_purchase_qty"),
            )
        )
    return reduce(DataFrame.unionByName, [_long(p) for p in parts])


def next_actions(metrics: DataFrame) -> DataFrame:
    """Messages for the metrics above zero, or the default message when there is none."""
    step = first_match([(F.col("metric") == name, at) for at, name in enumerate(ACTIONS, start=1)])
    text = first_match(
        [
            (F.col("metric") == name, F.format_string(message, F.col("value").cast("bigint")))
            for name, message in ACTIONS.items()
        ]
    )
    due = metrics.filter(F.col("metric").isin(*ACTIONS) & (F.col("value") > 0))
    # one row per rule at most, so the list is bounded by the rule table
    listed = due.agg(F.array_sort(F.collect_list(F.struct(step.alias("step"), text.alias("action")))).alias("due"))
    quiet = F.array(F.struct(F.lit(0).alias("step"), F.lit(NO_ACTION).alias("action")))
    return listed.select(F.inline(F.when(F.size("due") > 0, F.col("due")).otherwise(quiet)))
