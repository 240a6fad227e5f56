"""Grid search of smoothing parameters: the constant forecast closest to the history wins.

Series stay one array per item. The grids (19, 361, 6 859 and 64 points) are evaluated inside
the row with numpy over Arrow batches, so rows are never multiplied by the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from granary.functions import series as S
from granary.functions.numeric import first_match, settle
from granary.functions.seasonal import grid_search
from granary.operators.forecast import METHODS, Calendar, demand_profile, lifecycle_override, route
from granary.schema import IMAPA_WINDOW, ITEM, SEASON, SEASON_TEST_POINTS


def _search(
    weekly: DataFrame,
    kind: str,
    fields: tuple[str, ...],
    mode: Column,
    steps: int | None,
    calendar: Calendar | None,
    m: int = SEASON,
) -> DataFrame:
    items = demand_profile(weekly, calendar)
    items = settle(items, {"season_mode": mode})
    found = items.withColumn("best", grid_search(kind, steps, m)("v", "season_mode"))
    return found.select(
        ITEM, "pattern", *[F.col(f"best.{f}").alias(f) for f in fields], F.col("best.rmse").alias("rmse"), "points"
    )


def tune_ses(weekly: DataFrame, steps: int | None = None, calendar: Calendar | None = None) -> DataFrame:
    """Best alpha per item; the objective is Holt with a trend that never changes."""
    return _search(weekly, "ses", ("alpha",), F.lit("add"), steps, calendar)


def tune_holt(weekly: DataFrame, steps: int | None = None, calendar: Calendar | None = None) -> DataFrame:
    return _search(weekly, "holt", ("alpha", "beta"), F.lit("add"), steps, calendar)


def tune_tsb(weekly: DataFrame, steps: int | None = None, calendar: Calendar | None = None) -> DataFrame:
    return _search(weekly, "tsb", ("alpha", "beta"), F.lit("add"), steps, calendar)


def tune_holt_winters(
    weekly: DataFrame, steps: int | None = None, calendar: Calendar | None = None, season: int = SEASON
) -> DataFrame:
    mode = F.when(F.size("v") >= SEASON_TEST_POINTS, S.seasonal_mode(F.col("v"), season)).otherwise("add")
    return _search(weekly, "holt_winters", ("alpha", "beta", "gamma"), mode, steps, calendar, season)


def _best_window(v: Column, mean: Column, var_pop: Column, points: Column, max_window: int) -> Column:
    """Struct(distance, window, rmse): every window scored alone, the smaller one on ties.

    As in the grids, the distance of the forecast to the mean decides.
    """
    def score(window: int) -> Column:
        def scored(fitted: Column) -> Column:
            forecast = F.coalesce(fitted["forecast"], F.lit(0.0))
            distance = F.when(points >= 2, F.round(F.abs(forecast - mean), 9)).otherwise(F.lit(0.0))
            rmse = S.constant_rmse(forecast, mean, var_pop, points)
            return F.struct(distance.alias("distance"), F.lit(window).alias("window"), rmse.alias("rmse"))

        # fitted once, though distance and error both read its forecast
        return S.bind(S.imapa_level(v, window), scored)

    return F.array_min(F.array(*[score(window) for window in S.imapa_windows(max_window)]))


def tune_imapa(
    weekly: DataFrame, max_window: int = IMAPA_WINDOW, calendar: Calendar | None = None
) -> DataFrame:
    """Best aggregation window per item."""
    items = demand_profile(weekly, calendar)
    best = _best_window(F.col("v"), F.col("mean_out"), F.col("var_out"), F.col("points"), max_window)
    return items.withColumn("best", best).select(
        ITEM, "pattern", F.col("best.window").alias("window"), F.col("best.rmse").alias("rmse"), "points"
    )


def tune(
    weekly: DataFrame,
    lifecycle: DataFrame | None = None,
    method: str | None = None,
    steps: int | None = None,
    imapa_window: int = IMAPA_WINDOW,
    season: int = SEASON,
    calendar: Calendar | None = None,
) -> DataFrame:
    """Best parameters per item for the model its pattern and length call for.

    ``method`` forces one model (ses, holt, holt-winters, tsb, imapa) for all items. Items the
    lifecycle takes out and items with fewer than three points are returned with a note.
    """
    if method not in (None, "auto", *METHODS):
        raise ValueError(f"unknown method {method!r}, expected auto or one of {METHODS}")
    items = demand_profile(weekly, calendar)
    if lifecycle is None:
        items = items.withColumn("lifecycle", F.lit("active"))
    else:
        items = items.join(lifecycle.select(ITEM, "lifecycle"), ITEM, "left").withColumn(
            "lifecycle", F.coalesce("lifecycle", F.lit("active"))
        )
    points, v = F.col("points"), F.col("v")
    routed = route(F.col("pattern"), points) if method in (None, "auto") else F.lit(method.replace("-", "_"))
    skip = lifecycle_override(F.col("lifecycle"), points)
    model = F.coalesce(skip, F.when(routed.isin("mean", "last", "none"), "insufficient").otherwise(routed))
    items = items.withColumn("model", model)

    def chosen(name: str, kind: str, mode: Column) -> Column:
        return grid_search(kind, steps, season)(F.when(F.col("model") == name, v), mode)

    add = F.lit("add")
    mode = F.when(
        (F.col("model") == "holt_winters") & (points >= SEASON_TEST_POINTS), S.seasonal_mode(v, season)
    ).otherwise("add")
    items = settle(items, {"season_mode": mode})
    items = items.withColumns(
        {
            "__ses": chosen("ses", "ses", add),
            "__holt": chosen("holt", "holt", add),
            "__tsb": chosen("tsb", "tsb", add),
            "__hw": chosen("holt_winters", "holt_winters", F.col("season_mode")),
            "__imapa": F.when(
                F.col("model") == "imapa",
                _best_window(v, F.col("mean_out"), F.col("var_out"), points, imapa_window),
            ),
        }
    )
    searched = ("__ses", "__holt", "__tsb", "__hw")
    return items.select(
        ITEM,
        "lifecycle",
        "pattern",
        "model",
        F.when(F.col("model") == "holt_winters", F.col("season_mode")).alias("season_mode"),
        *[F.coalesce(*[F.col(f"{s}.{p}") for s in searched]).alias(p) for p in ("alpha", "beta", "gamma")],
        F.col("__imapa.window").alias("window"),
        F.coalesce(*[F.col(f"{s}.rmse") for s in searched], F.col("__imapa.rmse"), F.lit(0.0)).alias("rmse"),
        "points",
        first_match(
            [
                (F.col("model").isin("obsolete", "clearance", "launch_manual"), "skipped by lifecycle"),
                (F.col("model") == "insufficient", "fewer than three points"),
            ]
        ).alias("note"),
    )
