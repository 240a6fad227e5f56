"""Series, forecast and tuning: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import Inputs, item_key
from checks.registry import query
from checks.sqlparts import holt_sql, imapa_sql, tsb_sql
from granary.functions import series as S
from granary.functions.seasonal import holt_winters as holt_winters_column
from granary.operators import forecast as G, tuning as H

@query(
    "demand_series",
    """SELECT item_code, count(*) AS n, sum((t + 1) * week_out) AS weighted, arg_min(week_out, t) AS first_out,
    arg_max(week_out, t) AS last_out FROM dense GROUP BY 1""",
    need="dense",
)
def demand_series(i: Inputs):
    rows = G.demand_series(i.dense_weekly())
    return rows.select(
        "item_code",
        F.size("v").cast("bigint").alias("n"),
        S.series_sum(F.transform("v", lambda x, at: x * (at + 1))).alias("weighted"),
        F.get("v", F.lit(0)).alias("first_out"),
        F.element_at("v", -1).alias("last_out"),
    )


@query(
    "demand_profile",
    """SELECT s.item_code, R(mean_out) AS mean_out, R(std_out) AS std_out, total_out, points, last_out, R(var_out) AS var_out,
    R(coalesce(nonzero_dev, 0)) AS std_nonzero, demand_arrow, pattern
    FROM pattern s JOIN arrows USING (item_code) JOIN (SELECT item_code, stddev_samp(week_out) FILTER (WHERE week_out > 0) AS nonzero_dev
    FROM dense GROUP BY 1) USING (item_code)""",
    need="pattern arrows dense",
)
def demand_profile(i: Inputs):
    return G.demand_profile(i.sparse_weekly(), i.calendar()).drop("v", "balance")


@query(
    "demand_stats",
    """SELECT item_code, R(mean_out) AS mean_out, R(std_out) AS std_out, total_out, points, last_out FROM stats""",
    need="stats",
)
def demand_stats(i: Inputs):
    return G.demand_stats(i.dense_weekly())


@query(
    "demand_pattern",
    """SELECT item_code, points AS weeks, nonzero, R(adi) AS adi, R(cv2) AS cv2, pattern FROM pattern""",
    need="pattern",
    digits=7,
)
def demand_pattern(i: Inputs):
    return G.demand_pattern(i.dense_weekly()).drop("nonzero_mean", "nonzero_std")


@query(
    "ses",
    "SELECT item_code, R(0.3 * last_out + 0.7 * mean_out) AS forecast FROM stats",
    need="stats",
)
def ses(i: Inputs):
    rows = G.demand_stats(i.dense_weekly())
    return rows.select("item_code", S.ses(F.col("mean_out"), F.col("last_out"), 0.3).alias("forecast"))


DIRECTION = "CASE WHEN trend > 0.05 * (forecast - trend) THEN 'up' WHEN trend < -0.05 * (forecast - trend) THEN 'down' ELSE 'flat' END"


@query(
    "holt",
    f"SELECT item_code, R(forecast) AS forecast, {DIRECTION} AS direction FROM ({holt_sql('dense', 357, 'i = 6 AND j = 2')})",
    need="dense holtw",
)
def holt(i: Inputs):
    return G.demand_series(i.dense_weekly()).select("item_code", F.inline(F.array(S.holt(F.col("v"), 0.3, 0.1))))


@query("tsb", "SELECT item_code, R(forecast) AS forecast FROM tsb", need="tsb")
def tsb(i: Inputs):
    return G.demand_series(i.dense_weekly()).select("item_code", S.tsb(F.col("v"), 0.1, 0.1).alias("forecast"))


@query(
    "imapa",
    "SELECT item_code, CAST(imapa_window AS INTEGER) AS imapa_window, R(forecast) AS forecast FROM imapa",
    need="imapa",
)
def imapa(i: Inputs):
    fitted = G.demand_series(i.dense_weekly()).select("item_code", S.imapa(F.col("v")).alias("fit"))
    return fitted.select("item_code", F.col("fit.window").alias("imapa_window"), "fit.forecast")


@query(
    "seasonal_mode",
    "SELECT item_code, R(r) AS r, season_mode FROM season",
    need="season",
)
def seasonal_mode(i: Inputs):
    rows = G.demand_series(i.dense_weekly())
    return rows.select("item_code", S.season_correlation(F.col("v"))["r"].alias("r"), S.seasonal_mode(F.col("v")).alias("season_mode"))


def _seasonal(i: Inputs, mode: str):
    rows = G.demand_series(i.dense_weekly("S"))
    return rows.select("item_code", F.inline(F.array(holt_winters_column(F.col("v"), 0.3, 0.1, 0.1, mode))))


@query(
    "holt_winters_add",
    "SELECT item_code, R(forecast) AS forecast, direction FROM hwfit WHERE mode = 'add'",
    need="hwfit",
)
def holt_winters_add(i: Inputs):
    return _seasonal(i, "add")


@query(
    "holt_winters_mul",
    "SELECT item_code, R(forecast) AS forecast, direction FROM hwfit WHERE mode = 'mul'",
    need="hwfit",
    digits=4,
)
def holt_winters_mul(i: Inputs):
    return _seasonal(i, "mul")


def measured(forecasts: str, dense: str, extra: str = "") -> str:
    """Interval and error measures around (item_code, method, forecast, trend, imapa_window)."""
    return f"""
    SELECT f.item_code, pattern, method, R(f.forecast) AS forecast, trend, CAST(imapa_window AS INTEGER) AS imapa_window{extra},
           R(greatest(0, f.forecast - 1.65 * std_out * sqrt(1 + 1.0 / points))) AS lower,
           R(f.forecast + 1.65 * std_out * sqrt(1 + 1.0 / points)) AS upper,
           R(mae) AS mae, R(sqrt(mse)) AS rmse, R(f.forecast - mean_out) AS bias, points
    FROM ({forecasts}) f
    JOIN (SELECT x.item_code, avg(abs(x.forecast - d.week_out)) AS mae, avg(power(x.forecast - d.week_out, 2)) AS mse
          FROM ({forecasts}) x JOIN {dense} d USING (item_code) GROUP BY 1) e USING (item_code)
    JOIN pat p USING (item_code)"""


_SHOWN = ("item_code", "pattern", "method", "forecast", "trend", "imapa_window", "lower", "upper", "mae", "rmse", "bias", "points")


@query(
    "forecast_demand",
    measured("SELECT * FROM longf", "dense").replace("JOIN pat p", "JOIN pattern p"),
    need="longf",
    digits=4,
)
def forecast_demand(i: Inputs):
    return G.forecast_demand(i.sparse_weekly(), calendar=i.calendar()).select(*_SHOWN)


# Short horizons of the supplier grain reach Holt (12 weeks) and SES (6 weeks).
def short_stats(weeks: int) -> str:
    return f"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT item_code, t, {weeks} AS n, week_out FROM dense WHERE item_code LIKE 'S%' AND t < {weeks}),
    pat AS MATERIALIZED (SELECT *, CASE WHEN nonzero < 3 THEN 'intermittent' WHEN adi <= 1.32 AND cv2 <= 0.49 THEN 'smooth'
                       WHEN adi <= 1.32 THEN 'erratic' WHEN cv2 <= 0.49 THEN 'lumpy' ELSE 'intermittent' END AS pattern
        FROM (SELECT item_code, avg(week_out) AS mean_out, stddev_samp(week_out) AS std_out, count(*) AS points,
                     arg_max(week_out, t) AS last_out, count(*) FILTER (WHERE week_out > 0) AS nonzero,
                     count(*)::DOUBLE / nullif(count(*) FILTER (WHERE week_out > 0), 0) AS adi,
                     (stddev_pop(week_out) FILTER (WHERE week_out > 0) / avg(week_out) FILTER (WHERE week_out > 0)) ^ 2 AS cv2,
                     avg(week_out) FILTER (WHERE t < {weeks} // 2) AS early, avg(week_out) FILTER (WHERE t >= {weeks} // 2) AS late
              FROM d GROUP BY 1)),
    ts AS ({tsb_sql("d", "0.1", "0.1")}), im_all AS ({imapa_sql("d")}),
    im AS (SELECT item_code, arg_min(w, (round(rmse, 12), w)) AS imapa_window, arg_min(forecast, (round(rmse, 12), w)) AS forecast
           FROM im_all GROUP BY 1),
    """


def short_forecasts(weeks: int) -> str:
    tail = (
        f"""SELECT item_code, 'holt', forecast, {DIRECTION}, NULL FROM ho JOIN pat USING (item_code) WHERE pattern IN ('smooth', 'erratic')"""
        if weeks >= 8
        else """SELECT item_code, 'ses', 0.3 * last_out + 0.7 * mean_out,
        CASE WHEN late > early * 1.15 THEN 'up' WHEN late < early * 0.85 THEN 'down' ELSE 'flat' END, NULL
        FROM pat WHERE pattern IN ('smooth', 'erratic')"""
    )
    return f"""
    SELECT p.item_code, 'tsb' AS method, coalesce(ts.forecast, 0) AS forecast, 'intermittent' AS trend, NULL AS imapa_window
    FROM pat p LEFT JOIN ts USING (item_code) WHERE pattern = 'intermittent'
    UNION ALL
    SELECT p.item_code, 'imapa', coalesce(i.forecast, 0), 'lumpy', CASE WHEN i.forecast > 0 THEN imapa_window END
    FROM pat p LEFT JOIN im i USING (item_code) WHERE pattern = 'lumpy'
    UNION ALL {tail}"""


def short_sql(weeks: int) -> str:
    holt = f"ho AS ({holt_sql('d', weeks, 'i = 6 AND j = 2')}), " if weeks >= 8 else ""
    body = measured("SELECT * FROM shortf", "d")
    return f"SELECT * FROM ({short_stats(weeks)} {holt} shortf AS ({short_forecasts(weeks)}) {body})"


@query("forecast_holt_horizon", short_sql(12), need="dense holtw", digits=7)
def forecast_holt_horizon(i: Inputs):
    return G.forecast_demand(i.dense_weekly("S", weeks=12)).select(*_SHOWN)


@query("forecast_ses_horizon", short_sql(6), need="dense", digits=7)
def forecast_ses_horizon(i: Inputs):
    return G.forecast_demand(i.dense_weekly("S", weeks=6)).select(*_SHOWN)


# Lifecycle states and tuned parameters: alpha .5, beta .2 for every third supplier.
def tuned(i: Inputs):
    return i.summary("S").filter(item_key() % 3 == 0).select(
        "item_code", F.lit(0.5).alias("alpha"), F.lit(0.2).alias("beta")
    )


TUNED = f"""SELECT * FROM ({short_stats(12)}
    ho AS ({holt_sql('d', 12, '(i = 6 AND j = 2) OR (i = 10 AND j = 4)')}),
    ts2 AS ({tsb_sql('d', '0.5', '0.2')}),
    key AS (SELECT item_code, lifecycle, CAST(substr(item_code, 2) AS BIGINT) % 3 = 0 AS tuned FROM master)
    SELECT p.item_code, lifecycle,
      CASE WHEN lifecycle = 'obsolete' THEN 'obsolete' WHEN lifecycle = 'phase_out' THEN 'clearance' WHEN pattern = 'intermittent' THEN 'tsb'
           WHEN pattern = 'lumpy' THEN 'imapa' ELSE 'holt' END AS method,
      R(CASE WHEN lifecycle IN ('obsolete', 'phase_out') THEN 0
           WHEN pattern = 'intermittent' THEN coalesce(CASE WHEN tuned THEN ts2.forecast ELSE ts.forecast END, 0)
           WHEN pattern = 'lumpy' THEN coalesce(im.forecast, 0) ELSE ho.forecast END) AS forecast,
      CASE WHEN tuned THEN 0.5::DOUBLE WHEN pattern = 'intermittent' AND lifecycle NOT IN ('obsolete', 'phase_out') THEN 0.1::DOUBLE ELSE 0.3::DOUBLE END AS alpha
    FROM pat p JOIN key USING (item_code) LEFT JOIN ts USING (item_code) LEFT JOIN ts2 USING (item_code) LEFT JOIN im USING (item_code)
    LEFT JOIN ho ON ho.item_code = p.item_code AND (ho.i = 10) = tuned)"""


@query("forecast_lifecycle_tuned", TUNED, need="dense holtw master", digits=7)
def forecast_lifecycle_tuned(i: Inputs):
    rows = G.forecast_demand(i.dense_weekly("S", weeks=12), lifecycle=i.master("S"), tuned=tuned(i))
    return rows.select("item_code", "lifecycle", "method", "forecast", "alpha")


@query(
    "lifecycle_override",
    """SELECT item_code, lifecycle, CASE lifecycle WHEN 'obsolete' THEN 'obsolete' WHEN 'phase_out' THEN 'clearance' END AS method
    FROM master""",
    need="master",
)
def lifecycle_override(i: Inputs):
    return i.master().select("item_code", "lifecycle", G.lifecycle_override(F.col("lifecycle"), F.lit(357)).alias("method"))


@query(
    "prediction_interval",
    """SELECT item_code, R(greatest(0, mean_out - 1.65 * std_out * sqrt(1 + 1.0 / points))) AS lower,
    R(mean_out + 1.65 * std_out * sqrt(1 + 1.0 / points)) AS upper FROM stats""",
    need="stats",
)
def prediction_interval(i: Inputs):
    rows = G.demand_stats(i.dense_weekly())
    bounds = G.prediction_interval(F.col("mean_out"), F.col("std_out"), F.col("points"))
    return rows.withColumns(bounds).select("item_code", "lower", "upper")


@query(
    "forecast_metrics",
    """SELECT d.item_code, R(avg(abs(f - week_out))) AS mae, R(sqrt(avg(power(f - week_out, 2)))) AS rmse, R(avg(f - week_out)) AS bias
    FROM dense d JOIN (SELECT item_code, 0.3 * last_out + 0.7 * mean_out AS f FROM stats) s USING (item_code) GROUP BY 1""",
    need="dense stats",
)
def forecast_metrics(i: Inputs):
    rows = G.demand_profile(i.sparse_weekly(), i.calendar())
    value = S.ses(F.col("mean_out"), F.col("last_out"), 0.3)
    rows = rows.withColumns(G.forecast_metrics(F.col("v"), value, F.col("mean_out"), F.col("var_out"), F.col("points")))
    return rows.select("item_code", "mae", "rmse", "bias")


@query(
    "half_split_trend",
    """SELECT item_code, CASE WHEN late > early * 1.15 THEN 'up' WHEN late < early * 0.85 THEN 'down' ELSE 'flat' END AS trend
    FROM (SELECT item_code, avg(week_out) FILTER (WHERE t < n // 2) AS early, avg(week_out) FILTER (WHERE t >= n // 2) AS late
          FROM dense GROUP BY 1)""",
    need="dense",
)
def half_split_trend(i: Inputs):
    return G.demand_series(i.dense_weekly()).select("item_code", S.half_trend(F.col("v")).alias("trend"))


@query(
    "forecast_summary",
    """SELECT count(*) AS total_items, count(*) FILTER (WHERE points >= 8) AS sufficient_items,
    count(*) FILTER (WHERE points < 3) AS insufficient_items, 'default' AS parameter_source
    FROM (SELECT item_code, count(*) AS points FROM sparse WHERE item_code LIKE 'P%' GROUP BY 1)""",
    need="sparse",
)
def forecast_summary(i: Inputs):
    return G.forecast_summary(G.forecast_demand(i.sparse_weekly("P")))


# --- tuning -----------------------------------------------------------------------
def best_of(forecasts: str, keys: str, shown: str) -> str:
    """Grid point closest to the mean, ties to the smallest parameters."""
    return f"""SELECT item_code, pattern, {shown}, R(sqrt(var_out + power(f.forecast - mean_out, 2))) AS rmse, points
    FROM (SELECT *, row_number() OVER (PARTITION BY item_code ORDER BY round(abs(forecast - mean_out), 9), {keys}) AS place
          FROM ({forecasts}) JOIN pattern USING (item_code)) f WHERE place = 1"""


@query(
    "tune_ses",
    best_of(f"SELECT item_code, i, forecast FROM ({holt_sql('dense', 357, 'j = 0')})", "i", "i / 20.0::DOUBLE AS alpha"),
    need="dense holtw pattern",
)
def tune_ses(i: Inputs):
    return H.tune_ses(i.sparse_weekly(), calendar=i.calendar())


@query(
    "tune_holt",
    best_of(
        f"SELECT item_code, i, j, forecast FROM ({holt_sql('dense', 357, 'j > 0')})",
        "i, j",
        "i / 20.0::DOUBLE AS alpha, j / 20.0::DOUBLE AS beta",
    ),
    need="dense holtw pattern",
)
def tune_holt(i: Inputs):
    return H.tune_holt(i.sparse_weekly(), calendar=i.calendar())


TSB_GRID = """
    SELECT item_code, i, j, (z_rest + z_first * power(1 - i / 20.0::DOUBLE, hits - 1)) * (p_rest + power(1 - j / 20.0::DOUBLE, n - 1) / (first_t + 1)) AS forecast
    FROM (SELECT item_code, i, max(n) AS n, max(hits) AS hits, min(t) AS first_t, arg_min(week_out, t) AS z_first,
                 sum(CASE WHEN hit > 1 THEN (i / 20.0::DOUBLE) * power(1 - i / 20.0::DOUBLE, hits - hit) * week_out ELSE 0 END) AS z_rest
          FROM hits, (SELECT unnest(generate_series(1, 8)) AS i) GROUP BY 1, 2)
    JOIN (SELECT item_code, j, sum(CASE WHEN t >= 1 THEN (j / 20.0::DOUBLE) * power(1 - j / 20.0::DOUBLE, n - 1 - t) ELSE 0 END) AS p_rest
          FROM hits, (SELECT unnest(generate_series(1, 8)) AS j) GROUP BY 1, 2) USING (item_code)"""


@query(
    "tune_tsb",
    best_of(TSB_GRID, "i, j", "i / 20.0::DOUBLE AS alpha, j / 20.0::DOUBLE AS beta"),
    need="hits pattern",
)
def tune_tsb(i: Inputs):
    return H.tune_tsb(i.sparse_weekly(), calendar=i.calendar())


@query(
    "tune_imapa",
    best_of("SELECT item_code, w, forecast FROM imapa_all", "w", 'CAST(w AS INTEGER) AS "window"'),
    need="imapa_all pattern",
)
def tune_imapa(i: Inputs):
    return H.tune_imapa(i.sparse_weekly(), calendar=i.calendar())


HW_BEST = "SELECT item_code, p.a AS alpha, p.b AS beta, p.g AS gamma, sqrt(var_out + power(p.f - mean_out, 2)) AS rmse FROM hwbest JOIN pattern USING (item_code)"


@query(
    "tune_holt_winters",
    f"SELECT item_code, pattern, alpha, beta, gamma, R(h.rmse) AS rmse, points FROM ({HW_BEST}) h JOIN pattern USING (item_code)",
    need="hwbest pattern",
    digits=4,
)
def tune_holt_winters(i: Inputs):
    return H.tune_holt_winters(i.sparse_weekly(), calendar=i.calendar())


# The router over the whole grids: every model that occurs at 357 weeks.
_MODEL = """CASE WHEN lifecycle = 'obsolete' THEN 'obsolete' WHEN lifecycle = 'phase_out' THEN 'clearance' WHEN p.pattern = 'intermittent' THEN 'tsb'
    WHEN p.pattern = 'lumpy' THEN 'imapa' ELSE 'holt_winters' END"""
_TSB_BEST = best_of(TSB_GRID, "i, j", "i / 20.0::DOUBLE AS alpha, j / 20.0::DOUBLE AS beta")
_WINDOW = best_of("SELECT item_code, w, forecast FROM imapa_all", "w", "CAST(w AS INTEGER) AS win")
TUNED = f"""SELECT item_code, lifecycle, pattern, model, CASE model WHEN 'holt_winters' THEN season_mode END AS season_mode,
    CASE model WHEN 'tsb' THEN t_alpha WHEN 'holt_winters' THEN h_alpha END AS alpha,
    CASE model WHEN 'tsb' THEN t_beta WHEN 'holt_winters' THEN h_beta END AS beta, CASE model WHEN 'holt_winters' THEN h_gamma END AS gamma,
    CASE model WHEN 'imapa' THEN win END AS "window",
    R(CASE model WHEN 'tsb' THEN t_rmse WHEN 'holt_winters' THEN h_rmse WHEN 'imapa' THEN w_rmse ELSE 0 END) AS rmse, points,
    CASE WHEN model IN ('obsolete', 'clearance') THEN 'skipped by lifecycle' END AS note
    FROM (SELECT p.item_code, lifecycle, p.pattern, p.points, s.season_mode, {_MODEL} AS model, t.alpha AS t_alpha, t.beta AS t_beta, t.rmse AS t_rmse,
                 h.alpha AS h_alpha, h.beta AS h_beta, h.gamma AS h_gamma, h.rmse AS h_rmse, w.win, w.rmse AS w_rmse
          FROM pattern p JOIN master m ON m.item_code = p.item_code JOIN season s ON s.item_code = p.item_code LEFT JOIN ({_TSB_BEST}) t ON t.item_code = p.item_code
          LEFT JOIN ({_WINDOW}) w ON w.item_code = p.item_code LEFT JOIN ({HW_BEST}) h ON h.item_code = p.item_code)"""


@query("tune_router", f"SELECT * EXCLUDE (season_mode, points) FROM ({TUNED})", need="pattern master hits imapa_all hwbest season", digits=4)
def tune_router(i: Inputs):
    return H.tune(i.sparse_weekly(), lifecycle=i.master(), calendar=i.calendar()).drop("season_mode", "points")


@query("tune", TUNED, need="pattern master hits imapa_all hwbest season", digits=4)
def tune(i: Inputs):
    return H.tune(i.sparse_weekly(), lifecycle=i.master(), calendar=i.calendar())
