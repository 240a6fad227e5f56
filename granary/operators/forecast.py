"""Weekly demand forecast: series, pattern, routing to a method, interval and error measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from granary.functions import series as S
from granary.functions.numeric import filled, first_match, settle
from granary.functions.seasonal import holt_winters, imapa_fit, tsb_fit
from granary.schema import (
    ADI_LIMIT,
    ALPHA,
    BETA,
    CV2_LIMIT,
    GAMMA,
    HOLT_POINTS,
    IMAPA_WINDOW,
    INTERVAL_Z,
    ITEM,
    SEASON,
    SEASON_TEST_POINTS,
    SEASONAL_POINTS,
    TSB_ALPHA,
    TSB_BETA,
)

METHODS = ("ses", "holt", "holt-winters", "tsb", "imapa")
DENSE_TASKS = 200


def densify(weekly: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Every item in every week of the calendar, zero where nothing moved.

    ``weekly`` has one row per item and ``week_start``. The weeks are generated inside the item
    row, so there is no item-by-week join, and the result stays partitioned by item: a later
    ``groupBy(item_code)`` needs no shuffle. The moves are small and their weeks many, so items are dealt to a set number of
    tasks: merged by the size of the moves, one task would hold, and sort, the weeks of a large share of all items.
    """
    if first is None or last is None:
        bounds = weekly.agg(F.struct(F.min("week_start").alias("lo"), F.max("week_start").alias("hi"))).scalar()
        first, last = bounds["lo"], bounds["hi"]
    moves = F.map_from_entries(F.collect_list(F.struct("week_start", F.struct("week_in", "week_out"))))
    tasks = max(DENSE_TASKS, int(weekly.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = weekly.repartition(tasks, ITEM).groupBy(ITEM).agg(moves.alias("moves"))
    rows = rows.select(
        ITEM, "moves", F.explode(F.sequence(first, last, F.expr("interval 7 days"))).alias("week_start")
    )
    seen = F.element_at("moves", F.col("week_start"))
    return rows.select(
        ITEM, "week_start", week_key(F.col("week_start")).alias("week_key"), seen.alias("seen")
    ).select(
        ITEM,
        "week_key",
        "week_start",
        filled(F.col("seen.week_in")).alias("week_in"),
        filled(F.col("seen.week_out")).alias("week_out"),
    )


def week_key(day: Column) -> Column:
    """ISO year * 100 + ISO week, so that weeks of different years stay apart."""
    return (F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)).cast("int")


def _ordered(value: str = "week_out") -> Column:
    pairs = F.sort_array(F.collect_list(F.struct("week_key", filled(value).alias("x"))))
    return F.transform(pairs, lambda p: p["x"])


def demand_series(weekly: DataFrame) -> DataFrame:
    """One row per item with its outflow in week order (one row per item and week expected)."""
    return settle(weekly.groupBy(ITEM).agg(_ordered().alias("v")), {"v": F.col("v")})


def demand_stats(weekly: DataFrame) -> DataFrame:
    """Mean, sample deviation, sum, count and last value of the weekly outflow."""
    return weekly.groupBy(ITEM).agg(*_stats())


def _stats() -> list[Column]:
    return [
        filled(F.avg("week_out")).alias("mean_out"),
        filled(F.stddev_samp("week_out")).alias("std_out"),
        filled(F.sum("week_out")).alias("total_out"),
        F.count("week_out").alias("points"),
        filled(F.max_by("week_out", "week_key")).alias("last_out"),
    ]


def _pattern_measures() -> list[Column]:
    demand = F.when(F.col("week_out") > 0, F.col("week_out"))
    return [
        F.count(F.lit(1)).alias("weeks"),
        F.count(demand).alias("nonzero"),
        F.avg(demand).alias("nonzero_mean"),
        F.stddev_pop(demand).alias("nonzero_std"),
    ]


def _pattern() -> Column:
    adi = F.try_divide(F.col("weeks"), F.col("nonzero"))
    cv = F.try_divide(F.col("nonzero_std"), F.col("nonzero_mean"))
    frequent, steady = adi <= ADI_LIMIT, cv * cv <= CV2_LIMIT
    return first_match(
        [
            (F.col("nonzero") < 3, "intermittent"),
            (frequent & steady, "smooth"),
            (frequent, "erratic"),
            (steady, "lumpy"),
        ],
        "intermittent",
    )


def demand_pattern(weekly: DataFrame) -> DataFrame:
    """smooth / erratic / lumpy / intermittent per item, with the numbers behind it."""
    measured = weekly.groupBy(ITEM).agg(*_pattern_measures())
    return measured.withColumns(
        {
            "adi": F.try_divide(F.col("weeks"), F.col("nonzero")),
            "cv2": F.pow(F.try_divide(F.col("nonzero_std"), F.col("nonzero_mean")), F.lit(2.0)),
            "pattern": _pattern(),
        }
    )


@dataclass(frozen=True)
class Calendar:
    """First and last week (Monday dates, as columns) of series whose empty weeks have no row.

    With a calendar the operators read only the weeks that moved and count the others as zero,
    so the zero rows of ``densify`` are never made.
    """

    first: Column
    last: Column

    @property
    def weeks(self) -> Column:
        return (F.datediff(self.last, self.first) / 7 + 1).cast("int")

    def position(self, day: str = "week_start") -> Column:
        return (F.datediff(F.col(day), self.first) / 7).cast("int")

    def keep(self, weekly: DataFrame) -> DataFrame:
        return weekly.filter(F.col("week_start").between(self.first, self.last))

    def moments(
        self, count: Column, mean: Column, var_pop: Column, weeks: Column | None = None
    ) -> tuple[Column, Column]:
        """Mean and sum of squared deviations after adding the empty weeks.

        Merging ``weeks - count`` zeros into the moments of the rows: exact, without the
        cancellation of sum(x^2) - n mean^2.
        """
        weeks = self.weeks if weeks is None else weeks
        return mean * count / weeks, var_pop * count + mean * mean * count * (weeks - count) / weeks


def _without_gaps(entries: Column, weeks: Column) -> Column:
    """Dense series of ``weeks`` values from (at, x) pairs sorted by position."""

    def fill(sorted_entries):
        def before(entry, i):
            previous = F.coalesce(F.get(sorted_entries, i - 1)["at"], F.lit(-1))
            return F.concat(F.array_repeat(F.lit(0.0), entry["at"] - previous - 1), F.array(entry["x"]))

        tail = weeks - 1 - F.element_at(sorted_entries, -1)["at"]
        return F.concat(F.flatten(F.transform(sorted_entries, before)), F.array_repeat(F.lit(0.0), tail))

    return S.bind(entries, fill)


def demand_profile(weekly: DataFrame, calendar: Calendar | None = None) -> DataFrame:
    """All that later stages need from the weekly table, from one aggregation per item.

    Series, statistics, pattern, deviation over non-zero weeks, latest balance (if the table has
    it) and the arrow of the last two weeks: forecast, XYZ class, plan and alerts can all start
    from here, so the weekly table is shuffled once.
    """
    demand = F.when(F.col("week_out") > 0, F.col("week_out"))
    balance = F.max_by("week_balance", "week_key") if "week_balance" in weekly.columns else F.first(F.lit(0.0))
    measures = [
        *_stats(),
        filled(F.var_pop("week_out")).alias("var_out"),
        filled(F.stddev_samp(demand)).alias("std_nonzero"),
        filled(balance).alias("balance"),
        *_pattern_measures(),
    ]
    if calendar is None:
        profile = settle(weekly.groupBy(ITEM).agg(_ordered().alias("v"), *measures), {"v": F.col("v")})
    else:
        # the week count travels as a value: a scalar subquery may not stand inside a lambda
        rows = calendar.keep(weekly).withColumns({"at": calendar.position(), "calendar_weeks": calendar.weeks})
        pairs = F.sort_array(F.collect_list(F.struct("at", filled("week_out").alias("x"))))
        n = F.col("calendar_weeks")
        profile = rows.groupBy(ITEM).agg(pairs.alias("pairs"), F.max(n).alias("calendar_weeks"), *measures)
        mean, squares = calendar.moments(F.col("points"), F.col("mean_out"), F.col("var_out"), n)
        profile = settle(profile, {"v": _without_gaps(F.col("pairs"), n)}).withColumns(
            {
                "mean_out": mean,
                "var_out": squares / n,
                "std_out": F.when(n > 1, F.sqrt(F.try_divide(squares, n - 1))).otherwise(F.lit(0.0)),
                "points": n.cast("bigint"),
                "weeks": n.cast("bigint"),
                "last_out": F.element_at("v", -1),
            }
        ).drop("pairs", "calendar_weeks")
    latest = F.size("v")
    arrow = S.last_step_arrow(F.get("v", latest - 1), F.get("v", latest - 2))
    return profile.withColumns({"pattern": _pattern(), "demand_arrow": arrow}).drop(
        "weeks", "nonzero", "nonzero_mean", "nonzero_std"
    )


def lifecycle_override(lifecycle: Column, points: Column) -> Column:
    """Method forced by the lifecycle, null when the item is forecast normally."""
    return first_match(
        [
            (lifecycle == "obsolete", "obsolete"),
            (lifecycle == "phase_out", "clearance"),
            ((lifecycle == "launch") & (points == 0), "launch_manual"),
        ]
    )


def route(pattern: Column, points: Column) -> Column:
    """Method by pattern, then by length of the series."""
    return first_match(
        [
            (pattern == "intermittent", "tsb"),
            (pattern == "lumpy", "imapa"),
            (points >= SEASONAL_POINTS, "holt_winters"),
            (points >= HOLT_POINTS, "holt"),
            (points >= 3, "ses"),
            (points == 2, "mean"),
            (points == 1, "last"),
        ],
        "none",
    )


def with_parameters(
    items: DataFrame, tuned: DataFrame | None, alpha: float, beta: float, gamma: float
) -> DataFrame:
    """Per-item alpha, beta, gamma: tuned values where there are some, else the defaults.

    TSB items have their own defaults.
    """
    if tuned is None:
        items = items.withColumns({f"tuned_{p}": F.lit(None).cast("double") for p in ("alpha", "beta", "gamma")})
    else:
        picked = [ITEM] + [
            (F.col(p) if p in tuned.columns else F.lit(None).cast("double")).alias(f"tuned_{p}")
            for p in ("alpha", "beta", "gamma")
        ]
        items = items.join(tuned.select(*picked), ITEM, "left")
    is_tsb = F.col("method") == "tsb"
    return items.withColumns(
        {
            "alpha": F.coalesce("tuned_alpha", F.when(is_tsb, TSB_ALPHA).otherwise(alpha)),
            "beta": F.coalesce("tuned_beta", F.when(is_tsb, TSB_BETA).otherwise(beta)),
            "gamma": F.coalesce("tuned_gamma", F.lit(gamma)),
        }
    ).drop("tuned_alpha", "tuned_beta", "tuned_gamma")


def forecast_demand(
    weekly: DataFrame,
    lifecycle: DataFrame | None = None,
    tuned: DataFrame | None = None,
    alpha: float = ALPHA,
    beta: float = BETA,
    gamma: float = GAMMA,
    z_value: float = INTERVAL_Z,
    imapa_window: int = IMAPA_WINDOW,
    season: int = SEASON,
    calendar: Calendar | None = None,
) -> DataFrame:
    """One row per item: method, forecast for next week, interval, trend and error measures.

    ``lifecycle`` is any table with item_code and lifecycle; ``tuned`` the output of
    ``tuning.tune``. With a ``calendar``, weeks without a row count as zero.
    """
    items = demand_profile(weekly, calendar)
    if lifecycle is None:
        items = items.withColumn("lifecycle", F.lit("active"))
    else:
        items = items.join(lifecycle.select(ITEM, "lifecycle"), ITEM, "left").withColumn(
            "lifecycle", F.coalesce("lifecycle", F.lit("active"))
        )
    points, v = F.col("points"), F.col("v")
    method = F.coalesce(lifecycle_override(F.col("lifecycle"), points), route(F.col("pattern"), points))
    items = with_parameters(items.withColumn("method", method), tuned, alpha, beta, gamma)

    is_seasonal = F.col("method") == "holt_winters"
    mode = F.when(is_seasonal & (points >= SEASON_TEST_POINTS), S.seasonal_mode(v, season)).when(is_seasonal, "add")
    items = settle(items, {"season_mode": mode})
    # a series goes to Python for its own method only; to the others the item sends null
    only = lambda method: F.when(F.col("method") == method, v)
    fits = {
        "seasonal_fit": holt_winters(only("holt_winters"), F.col("alpha"), F.col("beta"), F.col("gamma"), F.col("season_mode"), season),
        "tsb_fit": tsb_fit(only("tsb"), F.col("alpha"), F.col("beta")),
        "imapa_fit": imapa_fit(only("imapa"), S.imapa_windows(imapa_window)),
    }
    items = items.withColumns(fits)
    # on the way back from pandas NaN is null
    fitted = lambda name: F.coalesce(F.col(name), F.lit(float("nan")))
    level = fitted("imapa_fit.forecast")
    error = first_match([(F.col("method") == m, fitted(f"{m}_fit.mae")) for m in ("tsb", "imapa")])

    def answer(forecast, trend, window=None) -> Column:
        return F.struct(
            forecast.alias("forecast"), trend.alias("trend"), F.lit(window).cast("int").alias("imapa_window")
        )

    no_trend = F.lit("n/a")
    result = first_match(
        [
            (F.col("method") == "tsb", answer(fitted("tsb_fit.forecast"), F.lit("intermittent"))),
            (F.col("method") == "imapa", answer(level, F.lit("lumpy"), F.when(level > 0, F.col("imapa_fit.window")))),
            (is_seasonal, answer(F.col("seasonal_fit.forecast"), F.col("seasonal_fit.direction"))),
            (
                F.col("method") == "holt",
                S.bind(
                    S.holt(v, F.col("alpha"), F.col("beta")), lambda h: answer(h["forecast"], h["direction"])
                ),
            ),
            (
                F.col("method") == "ses",
                answer(S.ses(F.col("mean_out"), F.col("last_out"), F.col("alpha")), S.half_trend(v)),
            ),
            (F.col("method") == "mean", answer(F.col("mean_out"), no_trend)),
            (F.col("method") == "last", answer(F.col("last_out"), no_trend)),
        ],
        answer(F.lit(0.0), no_trend),
    )
    items = items.withColumns({"result": result, "error": error}).select("*", "result.*").drop("result", *fits)
    forecast = F.col("forecast")
    return (
        items.withColumns(prediction_interval(forecast, F.col("std_out"), points, z_value))
        .withColumns(forecast_metrics(v, forecast, F.col("mean_out"), F.col("var_out"), points, F.col("error")))
        .withColumn("z_value", F.lit(z_value))
        .withColumn("parameter_source", F.lit("tuned" if tuned is not None else "default"))
        .drop("v", "var_out", "error")
    )


def prediction_interval(forecast: Column, std: Column, points: Column, z_value: float = INTERVAL_Z) -> dict[str, Column]:
    """Columns ``lower`` and ``upper`` around the forecast; lower is never negative."""
    se = std * F.sqrt(1 + F.lit(1.0) / F.greatest(points, F.lit(1)))
    return {"lower": F.greatest(F.lit(0.0), forecast - z_value * se), "upper": forecast + z_value * se}


def forecast_metrics(
    v: Column, forecast: Column, mean: Column, var_pop: Column, points: Column, mae: Column | None = None
) -> dict[str, Column]:
    """Columns ``mae``, ``rmse``, ``bias`` of the constant forecast over the history; ``mae`` where it is known already."""
    error = S.mean_absolute_error(v, forecast)
    return {
        "mae": error if mae is None else F.when(mae.isNotNull(), mae).otherwise(error),
        "rmse": S.constant_rmse(forecast, mean, var_pop, points),
        "bias": F.when(points >= 2, forecast - mean).otherwise(F.lit(0.0)),
    }


def forecast_summary(forecasts: DataFrame) -> DataFrame:
    """One row: items, items with enough and with too little data, source of the parameters."""
    return forecasts.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(F.col("points") >= HOLT_POINTS).alias("sufficient_items"),
        F.count_if(F.col("points") < 3).alias("insufficient_items"),
        F.max("parameter_source").alias("parameter_source"),
    )
