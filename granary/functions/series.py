"""Recurrences over a series of weekly quantities, as JVM higher-order functions.

Every function takes ``v``, an ``array<double>`` column in week order, and returns a column.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from granary.schema import IMAPA_WINDOW, SEASON


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    The optimizer may inline a column into a lambda, which then computes it for every element;
    as the element of a one-element array it is a variable instead.
    """
    return F.transform(F.array(value), use)[0]


def _params(alpha, beta) -> Column:
    return F.struct(_lit(alpha).alias("alpha"), _lit(beta).alias("beta"))


def series_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def series_mean(v: Column) -> Column:
    """Mean of the series, null when it is empty."""
    return F.when(F.size(v) > 0, series_sum(v) / F.size(v))


def direction(trend: Column, level: Column) -> Column:
    """up / down / flat at five percent of the level."""
    return (
        F.when(trend > 0.05 * level, "up").when(trend < -0.05 * level, "down").otherwise("flat")
    )


def holt(v: Column, alpha, beta) -> Column:
    """Holt's linear method: struct(forecast, direction) one week ahead.

    Fewer than three points give forecast 0 and direction ``insufficient``.
    """
    start = F.struct(
        F.get(v, F.lit(0)).alias("level"), (F.get(v, F.lit(1)) - F.get(v, F.lit(0))).alias("trend")
    )

    def fit(p):
        def step(state, x):
            level = p["alpha"] * x + (1 - p["alpha"]) * (state["level"] + state["trend"])
            trend = p["beta"] * (level - state["level"]) + (1 - p["beta"]) * state["trend"]
            return F.struct(level.alias("level"), trend.alias("trend"))

        return F.aggregate(
            F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))),
            start,
            step,
            lambda s: F.struct(
                (s["level"] + s["trend"]).alias("forecast"),
                direction(s["trend"], s["level"]).alias("direction"),
            ),
        )

    short = F.struct(F.lit(0.0).alias("forecast"), F.lit("insufficient").alias("direction"))
    return F.when(F.size(v) >= 3, bind(_params(alpha, beta), fit)).otherwise(short)


def ses(mean: Column, last: Column, alpha) -> Column:
    """Single smoothing as defined here: the last value blended with the mean."""
    alpha = _lit(alpha)
    return alpha * last + (1 - alpha) * mean


def tsb(v: Column, alpha, beta) -> Column:
    """Teunter-Syntetos-Babai: demand probability times demand size; 0 without demand."""
    position = F.array_position(F.transform(v, lambda x: x > 0), F.lit(True))

    def fit(p):
        def step(state, x):
            hit = F.when(x > 0, 1.0).otherwise(0.0)
            size = F.when(x > 0, p["alpha"] * x + (1 - p["alpha"]) * state["size"]).otherwise(state["size"])
            chance = p["beta"] * hit + (1 - p["beta"]) * state["chance"]
            return F.struct(size.alias("size"), chance.alias("chance"))

        start = F.struct(
            F.get(v, (p["position"] - 1).cast("int")).alias("size"),
            (F.lit(1.0) / p["position"]).alias("chance"),
        )
        fitted = F.aggregate(
            F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))),
            start,
            step,
            lambda s: s["size"] * s["chance"],
        )
        return F.when(p["position"] > 0, fitted).otherwise(F.lit(0.0))

    return bind(
        F.struct(position.alias("position"), _lit(alpha).alias("alpha"), _lit(beta).alias("beta")), fit
    )


def imapa_windows(max_window: int = IMAPA_WINDOW) -> list[int]:
    """Aggregation windows tried: 1, 2, 4 always, 8 and 16 when asked for."""
    return [1, 2, 4] + [w for w in (8, 16) if max_window >= w]


def imapa_level(v: Column, window: int) -> Column:
    """One IMAPA window: struct(rmse, window, forecast), null below three full blocks."""
    blocks_count = F.floor(F.size(v) / window).cast("int")
    if window == 1:
        blocks = v
    else:
        starts = F.sequence(F.lit(0), F.greatest(blocks_count - 1, F.lit(0)))

        def block(k):
            parts = [F.get(v, k * window + j) for j in range(window)]
            acc = parts[0]
            for part in parts[1:]:
                acc = acc + part
            return acc

        blocks = F.transform(starts, block)

    def step(state, x):
        miss = state["level"] - x
        return F.struct(
            (0.1 * x + 0.9 * state["level"]).alias("level"), (state["sse"] + miss * miss).alias("sse")
        )

    def fit(sums):
        return F.aggregate(
            F.slice(sums, F.lit(2), F.greatest(F.size(sums) - 1, F.lit(0))),
            F.struct(F.get(sums, F.lit(0)).alias("level"), F.lit(0.0).alias("sse")),
            step,
            lambda s: F.struct(
                F.sqrt(s["sse"] / F.greatest(F.size(sums) - 1, F.lit(1))).alias("rmse"),
                F.lit(window).alias("window"),
                (s["level"] / window).alias("forecast"),
            ),
        )

    return F.when(blocks_count >= 3, bind(blocks, fit))


def imapa(v: Column, max_window: int = IMAPA_WINDOW) -> Column:
    """Best aggregation window by RMSE, the smaller window on ties: struct(rmse, window, forecast)."""
    return F.array_min(F.array_compact(F.array(*[imapa_level(v, w) for w in imapa_windows(max_window)])))


def half_trend(v: Column) -> Column:
    """Second half against first half of the series at +-15 %."""
    half = F.floor(F.size(v) / 2).cast("int")
    first = series_mean(F.slice(v, F.lit(1), half))
    second = series_mean(F.slice(v, half + 1, F.size(v) - half))
    return (
        F.when(F.size(v) < 3, "insufficient")
        .when(second > first * 1.15, "up")
        .when(second < first * 0.85, "down")
        .otherwise("flat")
    )


def last_step_arrow(last: Column, previous: Column) -> Column:
    """Last week against the week before at +-15 %; flat when either is missing."""
    return F.when(last > previous * 1.15, "↑").when(last < previous * 0.85, "↓").otherwise("→")


def mean_absolute_error(v: Column, forecast: Column) -> Column:
    """MAE of one constant forecast over the whole series; 0 below two points."""
    gap = bind(forecast, lambda f: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.abs(f - x)))
    return F.when(F.size(v) >= 2, gap / F.size(v)).otherwise(F.lit(0.0))


def constant_rmse(forecast: Column, mean: Column, var_pop: Column, n: Column) -> Column:
    """RMSE of a constant forecast from the moments: the mean squared error is var + bias^2."""
    return F.when(n >= 2, F.sqrt(var_pop + (forecast - mean) * (forecast - mean))).otherwise(F.lit(0.0))


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of Pearson's r over ``n`` pairs.

    Student's t has a finite series for whole degrees of freedom; with theta = asin(r) the
    terms are powers of cos^2(theta) = 1 - r^2.
    """
    df = n - 2
    cos2 = F.greatest(1 - r * r, F.lit(0.0))
    size = F.abs(r)
    odd = (df % 2) == 1

    # even: sin * sum_{j<df/2} prod (2i-1)/(2i) * cos^2j; odd: prod 2i/(2i+1), from cos^1 up
    def series(terms, numerator, denominator):
        steps = F.when(terms > 1, F.sequence(F.lit(1), F.greatest(terms - 1, F.lit(1)))).otherwise(
            F.array().cast("array<int>")
        )
        return F.aggregate(
            steps,
            F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
            lambda s, i: F.struct(
                (s["term"] * numerator(i) / denominator(i) * cos2).alias("term"),
                (s["total"] + s["term"] * numerator(i) / denominator(i) * cos2).alias("total"),
            ),
            lambda s: s["total"],
        )

    even_area = size * series((df / 2).cast("int"), lambda i: 2.0 * i - 1, lambda i: 2.0 * i)
    odd_terms = ((df - 1) / 2).cast("int")
    odd_tail = F.when(
        odd_terms > 0,
        size * F.sqrt(cos2) * series(odd_terms, lambda i: 2.0 * i, lambda i: 2.0 * i + 1),
    ).otherwise(F.lit(0.0))
    odd_area = (F.asin(F.least(size, F.lit(1.0))) + odd_tail) * 2 / F.lit(3.141592653589793)
    return 1 - F.when(odd, odd_area).otherwise(even_area)


def season_correlation(v: Column, season: int = SEASON) -> Column:
    """Struct(r, cycles): cycle amplitude against cycle mean over the full cycles.

    ``r`` is null when either side does not vary.
    """
    cycles = F.floor(F.size(v) / season).cast("int")
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(cycles - 1, F.lit(0))), lambda c: F.slice(v, c * season + 1, season)
    )
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            (F.array_max(p) - F.array_min(p)).alias("x"), (series_sum(p) / season).alias("y")
        ),
    )

    def correlate(cells):
        means = F.struct(
            (series_sum(F.transform(cells, lambda p: p["x"])) / F.size(cells)).alias("x"),
            (series_sum(F.transform(cells, lambda p: p["y"])) / F.size(cells)).alias("y"),
        )
        return bind(
            means,
            lambda mean: F.aggregate(
                cells,
                F.struct(F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"), F.lit(0.0).alias("xy")),
                lambda s, p: F.struct(
                    (s["xx"] + (p["x"] - mean["x"]) * (p["x"] - mean["x"])).alias("xx"),
                    (s["yy"] + (p["y"] - mean["y"]) * (p["y"] - mean["y"])).alias("yy"),
                    (s["xy"] + (p["x"] - mean["x"]) * (p["y"] - mean["y"])).alias("xy"),
                ),
                lambda s: F.when(
                    (s["xx"] > 0) & (s["yy"] > 0), s["xy"] / (F.sqrt(s["xx"]) * F.sqrt(s["yy"]))
                ),
            ),
        )

    moments = bind(pairs, correlate)
    return F.struct(F.when(cycles >= 3, moments).alias("r"), cycles.alias("cycles"))


def seasonal_mode(v: Column, season: int = SEASON) -> Column:
    """``mul`` when amplitude grows with the level (p < .05), else ``add``."""
    zero_share = F.size(F.filter(v, lambda x: x == 0)) / F.size(v)
    grows = bind(
        season_correlation(v, season),
        lambda found: (found["r"] > 0) & (pearson_p(found["r"], found["cycles"]) < 0.05),
    )
    return F.when((F.size(v) >= 3 * season) & (zero_share <= 0.3) & grows, "mul").otherwise("add")
