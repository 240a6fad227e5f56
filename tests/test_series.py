"""Recurrences against plain Python loops and hand-computed values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from granary.functions import series as S
from granary.functions.seasonal import grid, grid_search, holt_winters
from granary.operators import forecast as G, tuning as H


def weekly_rows(spark, series, first_week=202001):
    rows = [(item, first_week + t, float(x)) for item, values in series.items() for t, x in enumerate(values)]
    return spark.createDataFrame(rows, "item_code string, week_key int, week_out double")


def as_map(df, *fields):
    return {r["item_code"]: tuple(r[f] for f in fields) if len(fields) > 1 else r[fields[0]] for r in df.collect()}


def loop_holt(v, a, b):
    level, trend = v[0], v[1] - v[0]
    for x in v[1:]:
        before = level
        level = a * x + (1 - a) * (level + trend)
        trend = b * (level - before) + (1 - b) * trend
    return level + trend


def loop_tsb(v, a, b):
    first = next((t for t, x in enumerate(v) if x > 0), None)
    if first is None:
        return 0.0
    z, p = v[first], 1 / (first + 1)
    for x in v[1:]:
        p = b * (x > 0) + (1 - b) * p
        z = a * x + (1 - a) * z if x > 0 else z
    return z * p


def loop_imapa(v, windows=(1, 2, 4)):
    best = (math.inf, None, 0.0)
    for w in windows:
        blocks = [sum(v[k : k + w]) for k in range(0, len(v) - w + 1, w)]
        if len(blocks) < 3:
            continue
        level, errors = blocks[0], []
        for x in blocks[1:]:
            errors.append((level - x) ** 2)
            level = 0.1 * x + 0.9 * level
        rmse = math.sqrt(sum(errors) / len(errors))
        if rmse < best[0]:
            best = (rmse, w, level / w)
    return best


def loop_seasonal(v, a, b, g, mode, m):
    mul = mode == "mul"
    pair = [(v[i] + v[i + m]) / 2 for i in range(m)]
    s = [(v[i] / pair[i] if pair[i] > 0 else 1.0) if mul else v[i] - pair[i] for i in range(m)]
    level, trend = sum(v[:m]) / m, (sum(v[m : 2 * m]) - sum(v[:m])) / (m * m)
    for t in range(m, len(v)):
        before, old = level, s[t - m]
        base = (v[t] / old if abs(old) > 1e-10 else v[t]) if mul else v[t] - old
        level = a * base + (1 - a) * (level + trend)
        trend = b * (level - before) + (1 - b) * trend
        if mul:
            s.append(g * (v[t] / level) + (1 - g) * old if abs(level) > 1e-10 else old)
        else:
            s.append(g * (v[t] - level) + (1 - g) * old)
    last = s[len(v) - m]
    return max(0.0, (level + trend) * last if mul else level + trend + last)


@pytest.fixture(scope="module")
def series():
    rng = random.Random(7)
    return {
        "hand": [10, 12, 11, 15, 14],
        "zeros": [0] * 12,
        "constant": [5] * 20,
        "late": [0, 0, 5, 0, 0, 7],
        "one": [3],
        "two": [3, 6],
        "sparse": [rng.choice([0, 0, 0, 0, rng.randint(1, 900)]) for _ in range(156)],
        "noisy": [max(0.0, rng.gauss(500, 200)) for _ in range(60)],
    }


def test_recurrences(spark, series):
    rows = G.demand_series(weekly_rows(spark, series)).select(
        "item_code",
        S.holt(F.col("v"), 0.3, 0.1).alias("holt"),
        S.tsb(F.col("v"), 0.1, 0.2).alias("tsb"),
        S.imapa(F.col("v")).alias("imapa"),
        S.half_trend(F.col("v")).alias("trend"),
    )
    got = {r["item_code"]: r for r in rows.collect()}
    assert got["hand"]["holt"]["forecast"] == pytest.approx(17.863889)
    for name, v in series.items():
        if len(v) >= 3:
            assert got[name]["holt"]["forecast"] == pytest.approx(loop_holt(v, 0.3, 0.1))
        else:
            assert got[name]["holt"]["direction"] == "insufficient"
        assert got[name]["tsb"] == pytest.approx(loop_tsb(v, 0.1, 0.2))
        rmse, window, forecast = loop_imapa(v)
        if window is None:
            assert got[name]["imapa"] is None
        else:
            assert got[name]["imapa"]["window"] == window
            assert got[name]["imapa"]["forecast"] == pytest.approx(forecast)
            assert got[name]["imapa"]["rmse"] == pytest.approx(rmse)
    assert got["two"]["trend"] == "insufficient" and got["constant"]["trend"] == "flat"


def test_batches_of_intermittent_series_give_the_same(spark, series, monkeypatch):
    from granary.functions import seasonal as N

    monkeypatch.setattr(N, "_BUDGET", 200)  # several groups of one length
    given = series | {f"like{k}": [float((t * k) % 7 < 2) * k for t in range(20)] for k in range(1, 25)} | {"nan": [1.0, math.nan, 0.0, 2.0, 0.0, 3.0]}
    v, none = F.col("v"), F.lit(None).cast("array<double>")
    rows = G.demand_series(weekly_rows(spark, given)).withColumns({"alpha": F.length("item_code") / 20, "beta": F.lit(0.2)})
    rows = rows.withColumns(
        {
            "tsb": S.tsb(v, F.col("alpha"), F.col("beta")), "imapa": S.imapa(v, 8),
            "tsb_fit": N.tsb_fit(v, F.col("alpha"), F.col("beta")), "imapa_fit": N.imapa_fit(v, S.imapa_windows(8)),
            "none": N.imapa_fit(none, [1]),
        }
    )
    rows = rows.withColumns({f"{m}_mae": S.mean_absolute_error(v, F.col(f"{m}_fit.forecast")) for m in ("tsb", "imapa")})
    for r in rows.collect():
        if r.item_code == "nan":
            assert math.isnan(r.tsb) and math.isnan(r.imapa.forecast) and r.imapa.window == 1 == r.imapa_fit.window
            assert r.tsb_fit.forecast is None and r.imapa_fit.forecast is None
            continue
        assert (r.tsb, r.tsb_mae) == (r.tsb_fit.forecast, r.tsb_fit.mae), r.item_code
        window, forecast = (r.imapa.window, r.imapa.forecast) if r.imapa else (0, 0.0)
        assert (window, forecast, r.imapa_mae) == (r.imapa_fit.window, r.imapa_fit.forecast, r.imapa_fit.mae), r.item_code
        assert r.none.window == 0


def test_a_forecast_has_no_interpreted_loop_for_intermittent_series(spark, series):
    forecasts = G.forecast_demand(weekly_rows(spark, series))
    plan = forecasts._jdf.queryExecution().optimizedPlan().toString()
    assert "sse" not in plan and "chance" not in plan


@pytest.mark.parametrize("mode", ["add", "mul"])
def test_holt_winters(spark, mode):
    m = 4
    rng = random.Random(3)
    series = {
        "season": [(10 + t * 0.2) * (1 + 0.4 * math.sin(t % m)) for t in range(3 * m)],
        "random": [rng.choice([0.0, rng.uniform(1, 50)]) for _ in range(5 * m)],
        "zeros": [0.0] * (2 * m),
        "short": [1.0] * (2 * m - 1),
    }
    rows = G.demand_series(weekly_rows(spark, series))
    got = as_map(
        rows.select("item_code", holt_winters(F.col("v"), 0.3, 0.1, 0.2, mode, m).alias("fit")).select("item_code", "fit.*"),
        "forecast", "direction",
    )
    for name in ("season", "random", "zeros"):
        assert got[name][0] == pytest.approx(loop_seasonal(series[name], 0.3, 0.1, 0.2, mode, m))
    assert got["short"] == (0.0, "insufficient")


def test_seasonal_mode_and_p_value(spark):
    season = 4
    shape = [1.0, 3.0, 2.0, 4.0]
    growing = [x * (1 + c) for c in range(6) for x in shape]
    level_only = [x + 10 * c + (0.1 if c % 2 else 0.0) * x for c in range(6) for x in shape]
    zeros = [0.0 if t % 2 else x for t, x in enumerate(growing)]
    data = {"grow": growing, "add": level_only, "zeros": zeros, "flat": [5.0] * 24, "short": growing[:8]}
    rows = G.demand_series(weekly_rows(spark, data))
    got = as_map(rows.select("item_code", S.seasonal_mode(F.col("v"), season).alias("mode")), "mode")
    assert got == {"grow": "mul", "add": "add", "zeros": "add", "flat": "add", "short": "add"}
    # critical values of the Pearson table at two-sided .05
    table = {3: 0.9969, 4: 0.9500, 5: 0.8783, 6: 0.8114, 7: 0.7545, 8: 0.7067, 9: 0.6664, 10: 0.6319, 27: 0.3809}
    rows = spark.createDataFrame(list(table.items()), "n int, r double")
    for row in rows.select("n", S.pearson_p(F.col("r"), F.col("n")).alias("p")).collect():
        assert row["p"] == pytest.approx(0.05, abs=2e-4), row


def test_pattern_limits(spark):
    # ADI exactly 1.32 counts as frequent: 33 weeks with 25 demands
    exact = [10.0] * 25 + [0.0] * 8
    data = {"exact": exact, "above": exact + [0.0], "few": [1.0, 2.0, 0.0, 0.0], "erratic": [1.0, 100.0] * 5, "wild": [0.0, 1.0, 0.0, 100.0] * 4}
    got = as_map(G.demand_pattern(weekly_rows(spark, data)), "pattern")
    assert got == {"exact": "smooth", "above": "lumpy", "few": "intermittent", "erratic": "erratic", "wild": "intermittent"}


def test_router_lengths(spark):
    data = {f"n{n}": [10.0 + t % 3 for t in range(n)] for n in (3, 7, 8, 103, 104, 156)}
    data["few"] = [5.0, 6.0]
    rows = G.forecast_demand(weekly_rows(spark, data, first_week=1))
    got = as_map(rows, "method", "forecast")
    assert {k: v[0] for k, v in got.items()} == {
        "n3": "ses", "n7": "ses", "n8": "holt", "n103": "holt", "n104": "holt_winters", "n156": "holt_winters", "few": "tsb",
    }
    assert got["n3"][1] == pytest.approx(0.3 * 12 + 0.7 * 11)
    assert got["n104"][1] == pytest.approx(loop_seasonal(data["n104"], 0.3, 0.1, 0.1, "add", 52))


def test_tuned_values_stay_with_their_item(spark):
    data = {"a": [10, 12, 11, 15, 14, 16, 13, 15], "b": [20, 21, 25, 22, 23, 24, 26, 25]}
    tuned = spark.createDataFrame([("a", 0.9, 0.5)], "item_code string, alpha double, beta double")
    got = as_map(G.forecast_demand(weekly_rows(spark, data), tuned=tuned), "forecast")
    assert got["a"] == pytest.approx(loop_holt(data["a"], 0.9, 0.5))
    assert got["b"] == pytest.approx(loop_holt(data["b"], 0.3, 0.1))


def test_calendar_equals_zero_rows(spark):
    rng = random.Random(5)
    rows = []
    for item in ("a", "b", "c"):
        for week in rng.sample(range(30), 12):
            rows.append((item, week, 0.0, float(rng.randint(1, 50))))
    df = spark.createDataFrame(rows, "item_code string, w int, week_in double, week_out double")
    df = df.withColumn("week_start", F.date_add(F.lit("2020-12-07").cast("date"), F.col("w") * 7))
    df = df.withColumn("week_key", G.week_key(F.col("week_start"))).drop("w")
    first, last = F.lit("2020-12-07").cast("date"), F.lit("2021-06-28").cast("date")
    dense = G.demand_profile(G.densify(df, first, last))
    sparse = G.demand_profile(df, G.Calendar(first, last))
    fields = ("v", "mean_out", "std_out", "var_out", "points", "last_out", "pattern", "demand_arrow", "std_nonzero")
    a, b = as_map(dense, *fields), as_map(sparse, *fields)
    assert a.keys() == b.keys()
    for item in a:
        assert len(a[item][0]) == 30 and a[item][0] == b[item][0]
        for x, y in zip(a[item][1:], b[item][1:]):
            assert x == y if isinstance(x, str) else x == pytest.approx(y)


@pytest.mark.parametrize("kind", ["ses", "holt", "tsb", "holt_winters"])
def test_grids_against_brute_force(spark, kind):
    m, steps = 4, 4
    rng = random.Random(11)
    data = {f"i{k}": [rng.choice([0.0, rng.uniform(1, 60)]) for _ in range(14)] for k in range(6)}
    points = list(grid(steps))
    rows = G.demand_series(weekly_rows(spark, data))
    found = rows.select("item_code", grid_search(kind, steps, m)(F.col("v"), F.lit("add")).alias("b")).select("item_code", "b.*")
    got = {r["item_code"]: r for r in found.collect()}
    for item, v in data.items():
        mean = sum(v) / len(v)
        if kind == "ses":
            tried = [((a,), loop_holt(v, a, 0.0)) for a in points]
        elif kind == "holt":
            tried = [((a, b), loop_holt(v, a, b)) for a in points for b in points]
        elif kind == "tsb":
            tried = [((a, b), loop_tsb(v, a, b)) for a in points for b in points]
        else:
            tried = [((a, b, g), loop_seasonal(v, a, b, g, "add", m)) for a in points for b in points for g in points]
        best, forecast = min(tried, key=lambda e: (round(abs(e[1] - mean), 9), e[0]))
        names = ("alpha", "beta", "gamma")[: len(best)]
        assert tuple(got[item][n] for n in names) == pytest.approx(best)
        assert got[item]["rmse"] == pytest.approx(math.sqrt(sum((forecast - x) ** 2 for x in v) / len(v)))


def test_tune_routes_and_notes(spark):
    data = {"lumpy": [0.0, 0.0, 10.0, 0.0] * 6, "holt": [10.0, 11.0, 12.0, 13.0] * 5, "tiny": [1.0, 2.0], "gone": [5.0] * 10}
    life = spark.createDataFrame([("gone", "obsolete")], "item_code string, lifecycle string")
    got = as_map(H.tune(weekly_rows(spark, data), life, steps=3), "model", "note")
    assert got["lumpy"] == ("imapa", None) and got["holt"] == ("holt", None)
    assert got["gone"] == ("obsolete", "skipped by lifecycle")
    assert got["tiny"][0] == "tsb"  # fewer than three demands are intermittent
    forced = as_map(H.tune(weekly_rows(spark, data), method="holt-winters", steps=2), "model")
    assert set(forced.values()) == {"holt_winters"}
    with pytest.raises(ValueError):
        H.tune(weekly_rows(spark, data), method="other")
