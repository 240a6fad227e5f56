"""ABC by share of outflow, XYZ by variation, their matrix and control strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from granary.functions.numeric import first_match, lookup, ratio
from granary.functions.ordering import running_total
from granary.schema import ABC_LIMITS, CONTROL_STRATEGY, DEFAULT_STRATEGY, ITEM, XYZ_LIMITS

_STRATEGY_FIELDS = ("service_level", "replenishment", "count_frequency", "stock_rule", "remark")


def abc_classify(
    df: DataFrame, a_limit: float = ABC_LIMITS[0], b_limit: float = ABC_LIMITS[1], slices: int | None = None
) -> DataFrame:
    """Class per item by cumulative share, largest first; item code breaks ties.

    The measure is ``out_amount`` if the table has it, else ``out_qty``. Amounts are added as
    DECIMAL, so the cumulative share does not depend on how rows are split over tasks.
    """
    by_amount = "out_amount" in df.columns
    measures = [F.coalesce(F.sum("out_qty"), F.lit(0.0)).alias("total_out")]
    if by_amount:
        measures.append(F.sum(F.col("out_amount").cast("decimal(18,2)")).alias("total_amount"))
    items = df.groupBy(ITEM).agg(*measures)
    measure = "total_amount" if by_amount else "total_out"
    ranked = running_total(
        items, [(F.col(measure), True), (F.col(ITEM), False)], measure, "__running", grand_name="__grand", slices=slices
    )
    whole = F.col("__grand").cast("double")
    share = ratio(F.col(measure).cast("double"), whole, None)
    cumulative = ratio(F.col("__running").cast("double"), whole, None)
    return (
        ranked.withColumn("share", share)
        .withColumn("cum_share", cumulative)
        .withColumn(
            "abc_class",
            first_match([(F.col("cum_share") <= a_limit, "A"), (F.col("cum_share") <= b_limit, "B")], "C"),
        )
        .drop("__running", "__grand")
    )


def abc_distribution(classified: DataFrame) -> DataFrame:
    return classified.groupBy("abc_class").agg(F.count(F.lit(1)).alias("items"))


def xyz_classify(
    weekly: DataFrame, x_limit: float = XYZ_LIMITS[0], y_limit: float = XYZ_LIMITS[1]
) -> DataFrame:
    """Class per item by the coefficient of variation of its outflow per bucket."""
    stats = weekly.groupBy(ITEM).agg(
        F.stddev_samp("week_out").alias("std_out"),
        F.avg("week_out").alias("mean_out"),
        F.sum("week_out").alias("total_out"),
        F.count("week_out").alias("points"),
    )
    return xyz_from_stats(stats, x_limit, y_limit)


def xyz_from_stats(
    stats: DataFrame, x_limit: float = XYZ_LIMITS[0], y_limit: float = XYZ_LIMITS[1]
) -> DataFrame:
    """The same for rows that have std_out, mean_out and points already, such as forecasts."""
    cv = ratio(F.col("std_out"), F.col("mean_out"), float("inf"))
    return (
        stats.withColumn("cv", cv)
        .withColumn(
            "xyz_class",
            first_match(
                [
                    (F.col("points") < 3, "insufficient"),
                    (F.col("cv") <= x_limit, "X"),
                    (F.col("cv") <= y_limit, "Y"),
                ],
                "Z",
            ),
        )
        .withColumn("x_limit", F.lit(x_limit))
        .withColumn("y_limit", F.lit(y_limit))
    )


def xyz_distribution(classified: DataFrame) -> DataFrame:
    return classified.groupBy("xyz_class").agg(F.count(F.lit(1)).alias("items"))


def lifecycle_hints(xyz: DataFrame, flow: DataFrame) -> DataFrame:
    """XYZ rows with the flow state of the item and a hint where one applies."""
    state, unstable = F.col("flow_state"), F.col("xyz_class") == "Z"
    hint = first_match(
        [
            (
                unstable & state.isin("consuming", "accumulating"),
                "review whether to keep or buy by order",
            ),
            (state == "idle", "possibly dead stock, check"),
            (unstable & (state == "balanced"), "volatile but balanced, review more often"),
        ]
    )
    return xyz.join(flow.select(ITEM, "flow_state"), ITEM, "left").withColumn("hint", hint)


def abc_xyz_items(abc: DataFrame, xyz: DataFrame) -> DataFrame:
    """One row per XYZ item with both classes and their combination; no ABC class means C."""
    abc_class = F.coalesce(F.col("abc_class"), F.lit("C"))
    return (
        xyz.join(abc.select(ITEM, "abc_class"), ITEM, "left")
        .withColumn("abc_class", abc_class)
        .withColumn("combo", F.concat("abc_class", "xyz_class"))
    )


def abc_xyz_matrix(items: DataFrame) -> DataFrame:
    """Items per combination."""
    return items.groupBy("combo").agg(F.count(F.lit(1)).alias("items"))


def abc_xyz_grid(items: DataFrame) -> DataFrame:
    """The same counts as a grid: one row per ABC class, one column per XYZ class."""
    return items.groupBy("abc_class").pivot("xyz_class", ["X", "Y", "Z"]).agg(F.count(F.lit(1))).na.fill(0)


def strategy_column(combo: Column, field: str) -> Column:
    """One field of the control strategy of a combination."""
    at = _STRATEGY_FIELDS.index(field)
    return lookup(combo, {key: row[at] for key, row in CONTROL_STRATEGY.items()}, DEFAULT_STRATEGY[at])


def control_strategy(items: DataFrame) -> DataFrame:
    """Service level, replenishment, count frequency and stock rule per item."""
    return items.withColumns({field: strategy_column(F.col("combo"), field) for field in _STRATEGY_FIELDS})


def classification_map(
    strategy: DataFrame | None = None, abc: DataFrame | None = None, xyz: DataFrame | None = None
) -> DataFrame:
    """(item, combo): from the matrix rows, else ABC and XYZ merged with defaults B and Y."""
    if strategy is not None:
        return strategy.select(ITEM, F.coalesce("combo", F.lit("BX")).alias("combo"))
    merged = abc.select(ITEM, "abc_class").join(xyz.select(ITEM, "xyz_class"), ITEM, "full")
    combo = F.concat(F.coalesce("abc_class", F.lit("B")), F.coalesce("xyz_class", F.lit("Y")))
    return merged.select(ITEM, combo.alias("combo"))
