"""Holt-Winters, intermittent demand and parameter grids: numpy over Arrow batches of series.

A batch holds many series; each recurrence advances all of them (and all grid points) by one
week per numpy call, so Python overhead is per week, not per item.

The additive models are linear in the series: the forecast of a grid point is the series times the point's impulse-response weights.
These depend on the length and the parameters only, so they are built once per length, for all grid points, by running the
recurrence backwards from the forecast (its adjoint), and a batch of series is then one matrix product.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from granary.schema import SEASON

# Grid steps: 0.05 .. 0.95 for smoothing, 0.05 .. 0.40 for intermittent demand.
GRID_STEPS = 19
TSB_GRID_STEPS = 8
# Largest working array of a grid search, in doubles (8 MB, to stay near the cache).
_BUDGET = 1_000_000


def grid(steps: int) -> np.ndarray:
    return np.round(np.arange(1, steps + 1) * 0.05, 2)


def _holt_winters(x: np.ndarray, alpha, beta, gamma, multiplicative: np.ndarray, m: int):
    """Advance series of one length. ``x``: (items, weeks); parameters: (items or 1, grid)."""
    items, n = x.shape
    shape = np.broadcast_shapes((items, 1), alpha.shape)
    mul = multiplicative[:, None]
    pair_mean = (x[:, :m] + x[:, m : 2 * m]) / 2
    ratio = np.divide(x[:, :m], pair_mean, out=np.ones_like(pair_mean), where=pair_mean > 0)
    start = np.where(mul, ratio, x[:, :m] - pair_mean)
    seasonal = np.repeat(start.T[:, :, None], shape[1], axis=2)  # (m, items, grid), a ring over weeks
    level = np.broadcast_to(x[:, :m].sum(axis=1)[:, None] / m, shape).copy()
    trend = np.broadcast_to(
        ((x[:, m : 2 * m].sum(axis=1) - x[:, :m].sum(axis=1)) / (m * m))[:, None], shape
    ).copy()
    any_mul, all_mul = bool(mul.any()), bool(mul.all())
    for t in range(m, n):
        value = x[:, t][:, None]
        season = seasonal[t % m]
        if not any_mul:
            base = value - season
        else:
            usable = np.abs(season) > 1e-10
            divided = np.where(usable, value / np.where(usable, season, 1.0), value)
            base = divided if all_mul else np.where(mul, divided, value - season)
        new_level = alpha * base + (1 - alpha) * (level + trend)
        trend = beta * (new_level - level) + (1 - beta) * trend
        level = new_level
        if not any_mul:
            observed = value - level
        else:
            usable = np.abs(level) > 1e-10
            share = np.where(usable, value / np.where(usable, level, 1.0), 0.0)
            kept = np.where(usable, gamma * share + (1 - gamma) * season, season)
            if all_mul:
                seasonal[t % m] = kept
                continue
            seasonal[t % m] = np.where(mul, kept, gamma * (value - level) + (1 - gamma) * season)
            continue
        seasonal[t % m] = gamma * observed + (1 - gamma) * season
    # seasonal position n-m is the oldest slot of the ring
    season = seasonal[n % m]
    forecast = np.where(mul, (level + trend) * season, level + trend + season)
    return np.maximum(forecast, 0.0), level, trend


def _by_length(series: pd.Series, minimum: int):
    """Yield (positions, matrix) for every series length of the batch."""
    lengths = series.map(lambda a: -1 if a is None else len(a)).to_numpy()
    for n in np.unique(lengths[lengths >= minimum]):
        where = np.flatnonzero(lengths == n)
        yield where, np.stack([np.asarray(series.iloc[i], dtype=float) for i in where])


def holt_winters_fit(m: int = SEASON):
    """Pandas UDF (v, alpha, beta, gamma, mode) -> struct(forecast, direction).

    A null series gives null; fewer than two seasons give 0 and ``insufficient``.
    """

    @F.pandas_udf("forecast double, direction string")
    def fit(
        v: pd.Series, alpha: pd.Series, beta: pd.Series, gamma: pd.Series, mode: pd.Series
    ) -> pd.DataFrame:
        forecast = v.map(lambda a: np.nan if a is None else 0.0).to_numpy(dtype=float)
        label = v.map(lambda a: None if a is None else "insufficient").to_numpy(dtype=object)
        parameters = [p.to_numpy(dtype=float) for p in (alpha, beta, gamma)]
        multiplicative = (mode == "mul").to_numpy()
        for where, x in _by_length(v, 2 * m):
            a, b, g = (p[where][:, None] for p in parameters)
            value, level, trend = _holt_winters(x, a, b, g, multiplicative[where], m)
            forecast[where] = value[:, 0]
            label[where] = np.where(
                trend[:, 0] > 0.05 * level[:, 0],
                "up",
                np.where(trend[:, 0] < -0.05 * level[:, 0], "down", "flat"),
            )
        return pd.DataFrame({"forecast": pd.Series(forecast).replace({np.nan: None}), "direction": label})

    # Called once per row: a plan that reads two fields of the result must not copy the call.
    return fit.asNondeterministic()


def holt_winters(v: Column, alpha, beta, gamma, mode, m: int = SEASON) -> Column:
    """Holt-Winters one week ahead: struct(forecast, direction)."""
    as_column = [p if isinstance(p, Column) else F.lit(float(p)) for p in (alpha, beta, gamma)]
    mode = mode if isinstance(mode, Column) else F.lit(mode)
    return holt_winters_fit(m)(v, *as_column, mode)


def _in_groups(series: pd.Series):
    """As ``_by_length``, in groups that stay near the cache, with the weeks as rows."""
    for where, x in _by_length(series, 1):
        group = max(1, _BUDGET // x.shape[1])
        for begin in range(0, len(where), group):
            yield where[begin : begin + group], np.ascontiguousarray(x[begin : begin + group].T)


def _tsb(weeks: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Demand probability times size, as ``series.tsb``; NaN counts as demand there, too."""
    hit = ~(weeks <= 0)
    first = hit.argmax(axis=0)
    size, chance = weeks[first, np.arange(weeks.shape[1])], 1.0 / (first + 1)
    for now, value in zip(hit[1:], weeks[1:]):
        size = np.where(now, alpha * value + (1 - alpha) * size, size)
        chance = beta * now + (1 - beta) * chance
    return np.where(hit.any(axis=0), size * chance, 0.0)


def _mae(weeks: np.ndarray, forecast: np.ndarray) -> np.ndarray:
    """As ``series.mean_absolute_error``."""
    if len(weeks) < 2:
        return np.zeros(weeks.shape[1])
    gap = np.zeros(weeks.shape[1])
    for value in weeks:
        gap += np.abs(forecast - value)
    return gap / len(weeks)


def tsb_fit(v: Column, alpha: Column, beta: Column) -> Column:
    """``series.tsb`` for batches of series: struct(forecast, mae), null where NaN is the result."""

    @F.pandas_udf("forecast double, mae double")
    def fit(v: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.DataFrame:
        forecast, mae = np.zeros(len(v)), np.zeros(len(v))
        a, b = (p.to_numpy(dtype=float) for p in (alpha, beta))
        for where, weeks in _in_groups(v):
            forecast[where] = _tsb(weeks, a[where], b[where])
            mae[where] = _mae(weeks, forecast[where])
        return pd.DataFrame({"forecast": forecast, "mae": mae})

    return fit.asNondeterministic()(v, alpha, beta)  # called once per row, see holt_winters_fit


def _imapa(weeks: np.ndarray, windows: list[int]):
    """Window with the smallest RMSE, the smaller one on ties, and its forecast; window 0 below three weeks."""
    items = weeks.shape[1]
    best, forecast, chosen = np.full(items, np.nan), np.full(items, np.nan), np.zeros(items, dtype=int)
    for window in windows:
        count = len(weeks) // window
        if count < 3:
            continue
        sums = weeks[: count * window : window]
        for j in range(1, window):
            sums = sums + weeks[j : count * window : window]
        level, squares = sums[0], np.zeros(items)
        for value in sums[1:]:
            miss = level - value
            level = 0.1 * value + 0.9 * level
            squares += miss * miss
        rmse = np.sqrt(squares / (count - 1))
        better = (chosen == 0) | (rmse < best) | (np.isnan(best) & ~np.isnan(rmse))
        best, forecast = np.where(better, rmse, best), np.where(better, level / window, forecast)
        chosen = np.where(better, window, chosen)
    return np.where(chosen == 0, 0.0, forecast), chosen


def imapa_fit(v: Column, windows: list[int]) -> Column:
    """``series.imapa`` for batches of series: struct(forecast, window, mae), null where NaN is the result.

    Without a window of three blocks window and forecast are 0.
    """

    @F.pandas_udf("forecast double, window int, mae double")
    def fit(v: pd.Series) -> pd.DataFrame:
        forecast, window, mae = np.zeros(len(v)), np.zeros(len(v), dtype=int), np.zeros(len(v))
        for where, weeks in _in_groups(v):
            forecast[where], window[where] = _imapa(weeks, windows)
            mae[where] = _mae(weeks, forecast[where])
        return pd.DataFrame({"forecast": forecast, "window": window, "mae": mae})

    return fit.asNondeterministic()(v)


def _best(x: np.ndarray, forecasts: np.ndarray):
    """Index and RMSE of the grid point closest to the history; the first point wins ties.

    The squared error of a constant is variance + (forecast - mean)^2, so the distance to the
    mean decides. Distances are compared at nine decimals: rounding noise breaks no tie.
    """
    if x.shape[1] < 2:
        return np.zeros(len(x), dtype=int), np.zeros(len(x))
    distance = np.abs(forecasts - x.mean(axis=1)[:, None])
    index = np.argmin(np.round(distance, 9), axis=1)
    return index, np.sqrt(x.var(axis=1) + distance[np.arange(len(x)), index] ** 2)


@lru_cache(8)
def holt_weights(n: int, steps: int, with_trend: bool) -> np.ndarray:
    """(weeks, grid): what each week adds to Holt's forecast of a series of ``n`` weeks, at every grid point."""
    points = grid(steps)
    alpha, beta = (a.ravel() for a in np.meshgrid(points, points, indexing="ij")) if with_trend else (points, np.zeros_like(points))
    weights = np.zeros((n, alpha.size))
    level, trend = np.ones(alpha.size), np.ones(alpha.size)  # how the forecast depends on the state behind week t
    for t in range(n - 1, 0, -1):
        total = level + beta * trend
        weights[t] = alpha * total
        level, trend = (1 - alpha) * total - beta * trend, (1 - alpha) * total + (1 - beta) * trend
    weights[0] += level - trend
    weights[1] += trend
    return weights


@lru_cache(3)
def holt_winters_weights(n: int, steps: int, m: int) -> np.ndarray:
    """(weeks, grid): what each week adds to the additive Holt-Winters forecast of a series of ``n`` weeks, before it is cut at 0."""
    points = grid(steps)
    alpha, beta, gamma = (a.ravel() for a in np.meshgrid(points, points, points, indexing="ij"))
    weights = np.zeros((n, alpha.size))
    level, trend = np.ones(alpha.size), np.ones(alpha.size)
    season = np.zeros((m, alpha.size))
    season[n % m] = 1
    for t in range(n - 1, m - 1, -1):
        kept = season[t % m]
        total = level + beta * trend - gamma * kept
        weights[t] = alpha * total + gamma * kept
        season[t % m] = (1 - gamma) * kept - alpha * total
        level, trend = (1 - alpha) * total - beta * trend, (1 - alpha) * total + (1 - beta) * trend
    # the start: level and trend from the sums of the first two seasons, a slot from half their difference
    weights[:m] += level / m - trend / (m * m) + season / 2
    weights[m : 2 * m] += trend / (m * m) - season / 2
    return weights


def _tsb_grid(x: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Size depends on alpha only and chance on beta only: two small grids and one product."""
    hit = x > 0
    first = hit.argmax(axis=1)
    rows = np.arange(len(x))
    size = np.repeat(x[rows, first][:, None], alpha.size, axis=1)
    chance = np.repeat((1.0 / (first + 1))[:, None], beta.size, axis=1)
    for t in range(1, x.shape[1]):
        now = hit[:, t : t + 1]
        chance = beta * now + (1 - beta) * chance
        size = np.where(now, alpha * x[:, t : t + 1] + (1 - alpha) * size, size)
    product = size[:, :, None] * chance[:, None, :]
    product[~hit.any(axis=1)] = 0.0
    return product.reshape(len(x), -1)


def grid_search(kind: str, steps: int | None = None, m: int = SEASON):
    """Pandas UDF (v, mode) -> struct(alpha, beta, gamma, rmse) over the grid of ``kind``.

    ``kind``: ses, holt, tsb or holt_winters. A null series gives nulls.
    """
    points = grid(steps or (TSB_GRID_STEPS if kind == "tsb" else GRID_STEPS))
    if kind == "ses":
        mesh = [points, np.zeros_like(points)]
    elif kind == "holt_winters":
        mesh = [a.ravel() for a in np.meshgrid(points, points, points, indexing="ij")]
    else:
        mesh = [a.ravel() for a in np.meshgrid(points, points, indexing="ij")]
    names = {"ses": ("alpha",), "holt_winters": ("alpha", "beta", "gamma")}.get(kind, ("alpha", "beta"))
    minimum = {"holt_winters": 2 * m, "tsb": 1}.get(kind, 3)

    def evaluate(x: np.ndarray, multiplicative: np.ndarray) -> np.ndarray:
        if kind == "tsb":
            return _tsb_grid(x, points, points)
        if kind != "holt_winters":
            return x @ holt_weights(x.shape[1], points.size, kind == "holt")
        out = np.empty((len(x), mesh[0].size))
        add = ~multiplicative
        if add.any():
            out[add] = np.maximum(x[add] @ holt_winters_weights(x.shape[1], points.size, m), 0.0)
        a, b, g = (p[None, :] for p in mesh)
        for at in np.flatnonzero(multiplicative):  # a ring of seasons per grid point: one series at a time
            out[at] = _holt_winters(x[at : at + 1], a, b, g, multiplicative[at : at + 1], m)[0]
        return out

    group = max(1, _BUDGET // mesh[0].size)

    @F.pandas_udf("alpha double, beta double, gamma double, rmse double")
    def search(v: pd.Series, mode: pd.Series) -> pd.DataFrame:
        out = {name: np.full(len(v), np.nan) for name in ("alpha", "beta", "gamma", "rmse")}
        multiplicative = (mode == "mul").to_numpy()
        short = v.map(lambda a: a is not None and len(a) < minimum).to_numpy(dtype=bool)
        # too short for the model: every point forecasts 0, so the first point is the best
        for where, x in _by_length(v, 1):
            for begin in range(0, len(where), group):
                part = where[begin : begin + group]
                rows = x[begin : begin + group]
                if short[part[0]]:
                    forecasts = np.zeros((len(part), 1))
                else:
                    forecasts = evaluate(rows, multiplicative[part])
                index, rmse = _best(rows, forecasts)
                for name, values in zip(names, mesh):
                    out[name][part] = values[index]
                out["rmse"][part] = rmse
        return pd.DataFrame(out).replace({np.nan: None}).astype(object)

    return search.asNondeterministic()  # called once per row, see holt_winters_fit
