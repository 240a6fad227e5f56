"""Whole chains: ledger files to tables, and tables to purchases."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from granary.operators import alerts as J, classify as C, forecast as G, ingest as N, planning as P, purchasing as B
from granary.schema import ITEM, LEAD_TIME_WEEKS
from granary.session import cut_lineage, shared_folder
from granary.sources import ledger as L, tables as T

_XYZ_COLUMNS = (ITEM, "std_out", "mean_out", "total_out", "points")


@dataclass
class Ingested:
    """What comes out of a set of ledger files."""

    summary: DataFrame
    weekly: DataFrame
    errors: DataFrame
    excluded: DataFrame
    mismatches: DataFrame
    window: DataFrame
    problems: DataFrame
    folder: str


def ingest_ledgers(
    spark: SparkSession,
    paths: list[str] | str,
    name: str,
    width: int | None = None,
    header_row: int = 1,
    data_row: int | None = None,
    reference_year: int = 2021,
    master: DataFrame | None = None,
    lifecycle_config: str | None = None,
    keywords: tuple[str, ...] | None = None,
    columns: list[str] | None = None,
) -> Ingested:
    """Read, clean and roll up wide ledgers.

    The CSV text is parsed once: its rows go to a new folder ``<shared folder>/<name>-<id>`` as Parquet, and summary,
    weekly and checks all start from there. Runs of one name do not touch each other; ``folder`` of the result can be
    deleted once its frames are used up.
    """
    staged = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    T.write_table(L.read_ledgers(spark, paths, width), staged)
    staged_rows = L.number_rows(spark.read.parquet(staged))
    data_row = header_row + 1 if data_row is None else data_row
    layouts = L.parse_ledger_layout(staged_rows, header_row, reference_year)
    words = keywords or N.TOTAL_WORDS
    rows = L.without_totals(staged_rows, data_row, words)
    lines = L.extract_summary(rows, layouts, data_row)
    watched = columns or [ITEM, *N.QUANTITIES]
    items = N.exclude_total_rows(lines, watched, words)
    summary = N.dedupe_items(items).drop("file", "row_no")
    if master is not None:
        summary = N.merge_master(summary, master)
    elif lifecycle_config is not None:
        summary = N.apply_lifecycle_constants(summary, lifecycle_config)
    else:
        summary = N.default_lifecycle(summary)
    daily = N.exclude_total_rows(L.unpivot_daily(rows, layouts, data_row), [ITEM], words)
    weekly = N.weekly_rollup(daily)
    return Ingested(
        summary=summary,
        weekly=weekly,
        errors=N.extraction_errors(items),
        excluded=L.total_lines(staged_rows, data_row, words).unionByName(
            N.excluded_rows(lines, watched, words).select("file", "row_no", ITEM, "reason")
        ),
        mismatches=N.cross_validate(summary, weekly),
        window=N.week_window(daily),
        problems=L.layout_problems(layouts),
        folder=staged,
    )


@dataclass
class Replenishment:
    """Every stage from classification to purchases."""

    classes: DataFrame
    forecasts: DataFrame
    plan: DataFrame
    alerts: DataFrame
    purchases: DataFrame


def replenish(
    weekly: DataFrame,
    summary: DataFrame,
    scorecard: DataFrame | None = None,
    matched: DataFrame | None = None,
    tuned: DataFrame | None = None,
    in_transit: DataFrame | None = None,
    item_supplier: DataFrame | None = None,
    supplier_in_transit: DataFrame | None = None,
    as_of: str | None = None,
    lead_time: int = LEAD_TIME_WEEKS,
    moq: float = 0.0,
    calendar: G.Calendar | None = None,
) -> Replenishment:
    """Classify, forecast, plan, alert and buy.

    ``weekly`` has one row per item and week with balance and is aggregated once; the forecasts
    (one row per item) are materialised in the shared folder, and every later stage starts there.
    """
    lifecycle = summary.select(ITEM, "lifecycle") if "lifecycle" in summary.columns else None
    forecasts = cut_lineage(G.forecast_demand(weekly, lifecycle, tuned, calendar=calendar))
    items = C.abc_xyz_items(C.abc_classify(summary), C.xyz_from_stats(forecasts.select(*_XYZ_COLUMNS)))
    plan = P.plan_inventory(None, summary, C.classification_map(items), forecasts, lead_time)
    alerts = J.generate_alerts(plan, None, as_of, lead_time, in_transit, item_supplier, supplier_in_transit)
    purchases = B.purchase_plan(alerts, matched, None, scorecard, moq, as_of)
    return Replenishment(C.control_strategy(items), forecasts, plan, alerts, purchases)
