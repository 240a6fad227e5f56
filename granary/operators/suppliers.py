"""Supplier scorecard: delivery, quality, dependency and the risk roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DecimalType

from granary.functions.numeric import ratio, total
from granary.schema import DEPENDENCY_LIMITS, ITEM, ON_TIME_LIMITS, QUALITY_LIMITS, STANDARD_NAMES, SUPPLIER_ALIASES

# Columns each dimension needs besides the supplier.
DIMENSIONS = {
    "delivery": ("planned_date", "actual_date"),
    "quality": ("qualified_qty", "delivered_qty"),
    "dependency": (ITEM, "out_qty"),
}


def resolve_supplier_columns(df: DataFrame) -> DataFrame:
    """Rename the first alias present of each role; roles without a column stay absent."""
    renames = {}
    for role, aliases in SUPPLIER_ALIASES.items():
        found = next((name for name in aliases if name in df.columns), None)
        if found and found != role and role not in df.columns:
            renames[found] = role
    for source, target in STANDARD_NAMES.items():
        if source in df.columns and target not in df.columns:
            renames[source] = target
    return df.withColumnsRenamed(renames)


def supplier_dimensions(df: DataFrame) -> DataFrame:
    """One row per dimension: available or skipped, from the schema alone."""
    rows = []
    for name, needed in DIMENSIONS.items():
        missing = [c for c in ("supplier", *needed) if c not in df.columns]
        status = "skipped" if missing else "available"
        rows.append((name, status, ", ".join(missing)))
    return df.sparkSession.createDataFrame(rows, "dimension string, status string, missing string")


def _level(value: Column, low: float, medium: float) -> Column:
    return F.when(value >= low, "low").when(value >= medium, "medium").otherwise("high")


def delivery_performance(df: DataFrame) -> DataFrame:
    """Delay statistics and on-time share per supplier; rows without a delay count as late."""
    delay = F.datediff(F.expr("try_cast(actual_date AS date)"), F.expr("try_cast(planned_date AS date)"))
    rows = df.select("supplier", delay.alias("delay_days"))
    by_supplier = rows.groupBy("supplier").agg(
        F.avg("delay_days").alias("avg_delay"),
        F.stddev_samp("delay_days").alias("std_delay"),
        F.count(F.lit(1)).alias("deliveries"),
        F.count_if(F.col("delay_days") <= 0).alias("__on_time"),
    )
    return by_supplier.withColumn("on_time_share", F.col("__on_time") / F.col("deliveries")).drop("__on_time")


def delivery_risk(performance: DataFrame) -> DataFrame:
    """Risk level per supplier from its on-time share."""
    return performance.withColumn("delivery_risk", _level(F.col("on_time_share"), *ON_TIME_LIMITS))


def quality_performance(df: DataFrame) -> DataFrame:
    """Accepted share and number of batches per supplier; 0 when nothing was delivered.

    DECIMAL quantities are added as they are, all others as doubles: no size of number is lost.
    """

    def added(name: str) -> Column:
        exact = isinstance(df.schema[name].dataType, DecimalType)
        return F.coalesce(F.sum(F.col(name) if exact else F.col(name).try_cast("double")).cast("double"), F.lit(0.0))

    by_supplier = df.groupBy("supplier").agg(
        *[added(name).alias(name) for name in ("qualified_qty", "delivered_qty")],
        F.count(F.lit(1)).alias("batches"),
    )
    return by_supplier.withColumn("quality_share", ratio(F.col("qualified_qty"), F.col("delivered_qty")))


def quality_risk(performance: DataFrame) -> DataFrame:
    return performance.withColumn("quality_risk", _level(F.col("quality_share"), *QUALITY_LIMITS))


def dependency(df: DataFrame, by: str = "supplier") -> DataFrame:
    """Share of all items each supplier provides, its outflow and the risk level."""
    per_supplier = df.groupBy(by).agg(F.countDistinct(ITEM).alias("items"), total("out_qty").alias("total_out"))
    all_items = df.agg(F.countDistinct(ITEM)).scalar()
    share = ratio(F.col("items").cast("double"), all_items.cast("double"))
    return per_supplier.withColumn("item_share", share).withColumn("dependency_risk", _dependency_level())


def high_risk_count(scored: DataFrame, column: str) -> DataFrame:
    """One row: suppliers and how many of them are high risk in ``column``."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_suppliers"), F.count_if(F.col(column) == "high").alias("high_risk")
    )


def scorecards(df: DataFrame) -> DataFrame:
    """All three dimensions per supplier from one pass over the deliveries, with their risk levels.

    Measures are added up per supplier and item first, which also counts the items; the result has the columns of
    ``delivery_risk``, ``quality_risk`` and ``dependency``.
    """
    delay = F.datediff(F.expr("try_cast(actual_date AS date)"), F.expr("try_cast(planned_date AS date)"))

    def added(name: str) -> Column:
        exact = isinstance(df.schema[name].dataType, DecimalType)
        return F.sum(F.col(name) if exact else F.col(name).try_cast("double")).alias(name)

    rows = df.withColumn("__delay", delay)
    parts = rows.groupBy("supplier", ITEM).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("__delay").alias("known"),
        F.sum("__delay").alias("delay"),
        F.sum(F.col("__delay").cast("double") * F.col("__delay")).alias("square"),
        F.count_if(F.col("__delay") <= 0).alias("on_time"),
        *[added(name) for name in ("qualified_qty", "delivered_qty", "out_qty")],
    )
    known, mean = F.sum("known"), F.sum("delay") / F.sum("known")
    quantity = lambda name: F.coalesce(F.sum(name).cast("double"), F.lit(0.0)).alias(name)
    card = parts.groupBy("supplier").agg(
        mean.alias("avg_delay"),
        F.when(known > 1, F.sqrt(F.greatest(F.sum("square") - known * mean * mean, F.lit(0.0)) / (known - 1))).alias("std_delay"),
        F.sum("n").alias("deliveries"),
        (F.sum("on_time") / F.sum("n")).alias("on_time_share"),
        quantity("qualified_qty"),
        quantity("delivered_qty"),
        F.sum("n").alias("batches"),
        F.count(ITEM).alias("items"),
        quantity("out_qty").alias("total_out"),
    )
    all_items = parts.agg(F.countDistinct(ITEM)).scalar()
    card = card.withColumn("quality_share", ratio(F.col("qualified_qty"), F.col("delivered_qty")))
    card = card.withColumn("item_share", ratio(F.col("items").cast("double"), all_items.cast("double")))
    return quality_risk(delivery_risk(card)).withColumn("dependency_risk", _dependency_level())


def _dependency_level() -> Column:
    high, medium = DEPENDENCY_LIMITS
    return F.when(F.col("item_share") >= high, "high").when(F.col("item_share") >= medium, "medium").otherwise("low")


_DIMENSIONS = ("delivery_risk", "quality_risk", "dependency_risk")


def risk_summary(
    delivery: DataFrame | None = None, quality: DataFrame | None = None, dependence: DataFrame | None = None, cards: DataFrame | None = None
) -> DataFrame:
    """Counts per level over the dimensions at hand and a recommendation; None if there are none.

    ``cards`` has several dimensions in one frame (``scorecards``) and takes the place of the three.
    """
    if cards is not None:
        given = [c for c in _DIMENSIONS if c in cards.columns]
        levels = cards.select(F.explode(F.array(*given)).alias("level")) if given else None
    else:
        frames = zip((delivery, quality, dependence), _DIMENSIONS, strict=True)
        given = [frame.select(F.col(column).alias("level")) for frame, column in frames if frame is not None]
        levels = reduce(DataFrame.unionByName, given) if given else None
    if levels is None:
        return None
    counts = levels.agg(
        *[F.count_if(F.col("level") == level).alias(f"{level}_count") for level in ("low", "medium", "high")]
    )
    high, medium = F.col("high_count"), F.col("medium_count")
    return counts.withColumn("dimensions", F.lit(len(given))).withColumn(
        "recommendation",
        F.when(high > 0, F.format_string("%d high-risk scores: review these suppliers now", high))
        .when(medium > 0, F.format_string("%d medium-risk scores: monitor more closely", medium))
        .otherwise("suppliers perform well: keep the regular review"),
    )
