"""Shared CTEs of the DuckDB side: the same inputs as fixtures.py, written in SQL."""

from __future__ import annotations

import re


def tsb_sql(source: str, alpha: str, beta: str) -> str:
    """TSB forecast per item of ``source`` (item_code, t, n, week_out)."""
    return f"""
        SELECT item_code, (z_rest + z_first * power(1 - {alpha}, hits - 1))
               * (p_rest + power(1 - {beta}, n - 1) / (first_t + 1)) AS forecast
        FROM (SELECT item_code, max(n) AS n, max(hits) AS hits, min(t) AS first_t, arg_min(week_out, t) AS z_first,
                     sum(CASE WHEN hit > 1 THEN {alpha} * power(1 - {alpha}, hits - hit) * week_out ELSE 0 END) AS z_rest,
                     sum(CASE WHEN t >= 1 THEN {beta} * power(1 - {beta}, n - 1 - t) ELSE 0 END) AS p_rest
              FROM (SELECT item_code, t, n, week_out, row_number() OVER (PARTITION BY item_code ORDER BY t) AS hit,
                           count(*) OVER (PARTITION BY item_code) AS hits
                    FROM {source} WHERE week_out > 0) GROUP BY 1)"""


def imapa_sql(source: str, windows: tuple[int, ...] = (1, 2, 4)) -> str:
    """RMSE and forecast per item and aggregation window."""
    parts = [
        f"""SELECT item_code, {w} AS w, sqrt(avg(power(prev - b, 2)) FILTER (WHERE k > 0)) AS rmse, arg_max(level, k) / {w} AS forecast
        FROM (SELECT *, lag(level) OVER (PARTITION BY item_code ORDER BY k) AS prev
              FROM (SELECT item_code, k, b, power(0.9, k) * sum(CASE WHEN k = 0 THEN b ELSE 0.1 * b / power(0.9, k) END)
                           OVER (PARTITION BY item_code ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level
                    FROM (SELECT item_code, CAST(t // {w} AS INTEGER) AS k, sum(week_out) AS b FROM {source}
                          WHERE t < (n // {w}) * {w} GROUP BY 1, 2)))
        GROUP BY 1 HAVING count(*) >= 3"""
        for w in windows
    ]
    return " UNION ALL ".join(parts)


def holt_sql(source: str, n: int, where: str) -> str:
    """Holt forecast and trend per item for the grid points chosen by ``where``; n weeks."""
    return f"""
        SELECT item_code, i, j,
               sum(CASE WHEN t = 0 THEN week_out * (w0.f1 - w0.f2) WHEN t = 1 THEN week_out * (w0.f2 + a * (h.f1 + b * h.f2))
                        ELSE week_out * a * (h.f1 + b * h.f2) END) AS forecast,
               sum(CASE WHEN t = 0 THEN week_out * (w0.g1 - w0.g2) WHEN t = 1 THEN week_out * (w0.g2 + a * (h.g1 + b * h.g2))
                        ELSE week_out * a * (h.g1 + b * h.g2) END) AS trend
        FROM (SELECT *, i / 20.0::DOUBLE AS a, j / 20.0::DOUBLE AS b FROM holtw WHERE {where}) h
        JOIN (SELECT i, j, f1, f2, g1, g2 FROM holtw WHERE k = {n - 1}) w0 USING (i, j)
        JOIN {source} d ON d.t = {n - 1} - h.k
        GROUP BY 1, 2, 3"""


CTES = {
    "lines": """
        SELECT 'P' || l_partkey AS item_code, CAST(l_shipdate AS DATE) AS d, l_quantity AS q,
               CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS qin, l_extendedprice AS price FROM lineitem
        UNION ALL
        SELECT 'S' || l_suppkey, CAST(l_shipdate AS DATE), l_quantity,
               CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END, l_extendedprice FROM lineitem""",
    "sparse": """
        SELECT item_code, CAST(date_trunc('week', d) AS DATE) AS week_start, sum(qin) AS week_in, sum(q) AS week_out
        FROM lines GROUP BY 1, 2""",
    "cal": """
        SELECT CAST(w AS DATE) AS week_start, CAST(isoyear(w) * 100 + weekofyear(w) AS INTEGER) AS week_key,
               row_number() OVER (ORDER BY w) - 1 AS t, count(*) OVER () AS n
        FROM (SELECT unnest(generate_series(date_trunc('week', min(l_shipdate)), date_trunc('week', max(l_shipdate)), INTERVAL 7 DAY)) AS w
              FROM lineitem)""",
    "items": "SELECT DISTINCT item_code FROM lines",
    "dense": """
        SELECT i.item_code, c.week_start, c.week_key, c.t, c.n,
               coalesce(s.week_in, 0) AS week_in, coalesce(s.week_out, 0) AS week_out
        FROM items i CROSS JOIN cal c LEFT JOIN sparse s ON s.item_code = i.item_code AND s.week_start = c.week_start""",
    "summary": """
        SELECT f.item_code, out_qty - in_qty + coalesce(p_size, 100) AS opening_qty, in_qty, out_qty,
               CAST(coalesce(p_size, 100) AS DOUBLE) AS closing_qty, p_retailprice AS unit_price, out_amount,
               CAST(substr(f.item_code, 2) AS BIGINT) AS k
        FROM (SELECT item_code, sum(qin) AS in_qty, sum(q) AS out_qty, sum(CAST(price AS DECIMAL(18,2))) AS out_amount
              FROM lines GROUP BY 1) f
        LEFT JOIN part ON f.item_code = 'P' || p_partkey""",
    "weekly": """
        SELECT d.*, s.opening_qty + sum(d.week_in - d.week_out) OVER (PARTITION BY d.item_code ORDER BY d.t
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS week_balance
        FROM dense d JOIN summary s USING (item_code)""",
    "master": """
        SELECT item_code, CASE WHEN k % 50 = 0 THEN 'launch' WHEN k % 50 = 1 THEN 'phase_out'
                               WHEN k % 100 = 2 THEN 'obsolete' ELSE 'active' END AS lifecycle,
               [180, 270, 365, 540, 730][k % 5 + 1] AS shelf_life_days,
               DATE '2001-11-05' - CAST(k % 700 AS INTEGER) AS production_date
        FROM summary""",
    "classes": """
        SELECT item_code, substr('ABC', k % 3 + 1, 1) || substr('XYZ', (k // 3) % 3 + 1, 1) AS combo
        FROM summary WHERE k % 11 <> 0""",
    "given": """
        SELECT item_code, out_qty / 300 AS forecast,
               CASE WHEN item_code LIKE 'P%' THEN 'tsb' ELSE 'holt_winters' END AS method
        FROM summary WHERE k % 4 <> 0""",
    "deliveries": """
        SELECT CAST(l_suppkey AS VARCHAR) AS supplier, 'P' || l_partkey AS item_code,
               CAST(o_orderdate AS DATE) + CAST(1000 * (l_suppkey % 3) AS INTEGER) AS planned_date,
               CAST(l_shipdate AS DATE) AS actual_date,
               l_quantity * (1 - l_discount * (1 + l_suppkey % 3)) AS qualified_qty,
               l_quantity AS delivered_qty, l_quantity AS out_qty, l_suppkey
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "delivery": """
        SELECT supplier, avg(delay) AS avg_delay, stddev_samp(delay) AS std_delay, count(*) AS deliveries,
               CAST(count(*) FILTER (WHERE delay <= 0) AS DOUBLE) / count(*) AS on_time_share
        FROM (SELECT supplier, date_diff('day', planned_date, actual_date) AS delay FROM deliveries) GROUP BY 1""",
    "scorecard": """
        SELECT *, CASE WHEN on_time_share >= 0.9 THEN 'low' WHEN on_time_share >= 0.7 THEN 'medium' ELSE 'high' END AS delivery_risk
        FROM delivery""",
    "quality": """
        SELECT *, CASE WHEN quality_share >= 0.95 THEN 'low' WHEN quality_share >= 0.85 THEN 'medium' ELSE 'high' END AS quality_risk
        FROM (SELECT supplier, CAST(sum(CAST(qualified_qty AS DECIMAL(18,4))) AS DOUBLE) AS qualified_qty,
                     CAST(sum(CAST(delivered_qty AS DECIMAL(18,4))) AS DOUBLE) AS delivered_qty, count(*) AS batches,
                     CASE WHEN sum(delivered_qty) > 0 THEN CAST(sum(CAST(qualified_qty AS DECIMAL(18,4))) AS DOUBLE)
                          / sum(delivered_qty) ELSE 0 END AS quality_share
              FROM deliveries GROUP BY 1)""",
    "dependence": """
        SELECT *, CASE WHEN item_share >= 0.3 THEN 'high' WHEN item_share >= 0.1 THEN 'medium' ELSE 'low' END AS dependency_risk
        FROM (SELECT supplier, count(DISTINCT item_code) AS items, sum(out_qty) AS total_out,
                     CAST(count(DISTINCT item_code) AS DOUBLE) / (SELECT count(DISTINCT item_code) FROM deliveries) AS item_share
              FROM deliveries GROUP BY 1)""",
    "demand": """
        SELECT 'P' || p_partkey AS item_code, p_size * 10.0 AS demand_qty FROM part WHERE p_partkey % 3 <> 0
        UNION ALL SELECT 'X' || n_nationkey, 75.0 FROM nation WHERE n_nationkey BETWEEN 1 AND 5""",
    # parts with their goods in transit: p_size for every fifth part
    "stock": """
        SELECT item_code, opening_qty, closing_qty AS on_hand_qty,
               CASE WHEN k % 5 = 0 THEN CAST(k % 40 AS DOUBLE) ELSE 0.0 END AS in_transit_qty
        FROM summary WHERE item_code LIKE 'P%'""",
    "matched": """
        SELECT *, CASE WHEN gap_qty <= 0 THEN 'sufficient' WHEN gap_ratio < 0.10 THEN 'tight' ELSE 'short' END AS gap_status
        FROM (SELECT *, CASE WHEN demand_qty > 0 THEN gap_qty / demand_qty ELSE 0 END AS gap_ratio
              FROM (SELECT coalesce(d.item_code, s.item_code) AS item_code, d.item_code IS NOT NULL AS has_demand,
                           CAST(coalesce(d.demand_qty, 0) AS DOUBLE) AS demand_qty, s.opening_qty,
                           coalesce(s.on_hand_qty, 0) AS on_hand_qty, coalesce(s.in_transit_qty, 0) AS in_transit_qty,
                           coalesce(s.on_hand_qty + s.in_transit_qty, 0) AS total_supply,
                           CAST(coalesce(d.demand_qty, 0) AS DOUBLE) - coalesce(s.on_hand_qty + s.in_transit_qty, 0) AS gap_qty
                    FROM demand d FULL JOIN stock s ON d.item_code = s.item_code))""",
    "abc": """
        SELECT item_code, total_out, total_out / whole AS share, running / whole AS cum_share,
               CASE WHEN running / whole <= 0.7 THEN 'A' WHEN running / whole <= 0.9 THEN 'B' ELSE 'C' END AS abc_class
        FROM (SELECT item_code, out_qty AS total_out, sum(out_qty) OVER () AS whole,
                     sum(out_qty) OVER (ORDER BY out_qty DESC, item_code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
              FROM summary WHERE item_code LIKE 'P%')""",
    "buckets": """
        SELECT item_code || '-week' AS item_code, date_trunc('week', d) AS b, sum(q) AS week_out FROM lines
        WHERE item_code LIKE 'S%' AND d < DATE '2001-10-01' GROUP BY 1, 2
        UNION ALL SELECT item_code || '-month', date_trunc('month', d), sum(q) FROM lines
        WHERE item_code LIKE 'S%' AND d < DATE '2001-10-01' GROUP BY 1, 2
        UNION ALL SELECT item_code || '-quarter', date_trunc('quarter', d), sum(q) FROM lines
        WHERE item_code LIKE 'S%' AND d < DATE '2001-10-01' GROUP BY 1, 2""",
    "xyz": """
        SELECT *, CASE WHEN points < 3 THEN 'insufficient' WHEN cv <= 0.3 THEN 'X' WHEN cv <= 0.8 THEN 'Y' ELSE 'Z' END AS xyz_class
        FROM (SELECT item_code, stddev_samp(week_out) AS std_out, avg(week_out) AS mean_out, sum(week_out) AS total_out,
                     count(*) AS points, CASE WHEN avg(week_out) > 0 THEN stddev_samp(week_out) / avg(week_out) END AS cv
              FROM buckets GROUP BY 1)""",
    "stats": """
        SELECT item_code, avg(week_out) AS mean_out, coalesce(stddev_samp(week_out), 0) AS std_out, sum(week_out) AS total_out,
               count(*) AS points, arg_max(week_out, week_key) AS last_out, var_pop(week_out) AS var_out,
               count(*) FILTER (WHERE week_out > 0) AS nonzero,
               avg(week_out) FILTER (WHERE week_out > 0) AS nonzero_mean,
               stddev_pop(week_out) FILTER (WHERE week_out > 0) AS nonzero_std
        FROM dense GROUP BY 1""",
    "pattern": """
        SELECT *, CASE WHEN nonzero < 3 THEN 'intermittent' WHEN adi <= 1.32 AND cv2 <= 0.49 THEN 'smooth'
                       WHEN adi <= 1.32 THEN 'erratic' WHEN cv2 <= 0.49 THEN 'lumpy' ELSE 'intermittent' END AS pattern
        FROM (SELECT *, CAST(points AS DOUBLE) / nullif(nonzero, 0) AS adi, (nonzero_std / nonzero_mean) ^ 2 AS cv2 FROM stats)""",
}

# --- recurrences, written as weighted sums instead of step-by-step loops --------------------
# n weeks, t = 0 .. n-1. Exponential smoothing weighs the value k weeks back with (1-a)^k, and
# Holt with a row vector times the k-th power of a 2x2 matrix: (f1, f2) for level + trend and
# (g1, g2) for the trend alone, on the grid a = i/20, b = j/20.
CTES["holtw"] = """
        SELECT i, j, 0 AS k, CAST(1 AS DOUBLE) AS f1, CAST(1 AS DOUBLE) AS f2, CAST(0 AS DOUBLE) AS g1, CAST(1 AS DOUBLE) AS g2
        FROM (SELECT unnest(generate_series(1, 19)) AS i), (SELECT unnest(generate_series(0, 19)) AS j)
        UNION ALL
        SELECT i, j, k + 1, f1 * (1 - i/20.0::DOUBLE) - f2 * (i/20.0::DOUBLE) * (j/20.0::DOUBLE),
               f1 * (1 - i/20.0::DOUBLE) + f2 * (1 - (i/20.0::DOUBLE) * (j/20.0::DOUBLE)),
               g1 * (1 - i/20.0::DOUBLE) - g2 * (i/20.0::DOUBLE) * (j/20.0::DOUBLE),
               g1 * (1 - i/20.0::DOUBLE) + g2 * (1 - (i/20.0::DOUBLE) * (j/20.0::DOUBLE))
        FROM holtw WHERE k < 356"""
CTES["tsb"] = tsb_sql("dense", "0.1", "0.1")
CTES["imapa_all"] = imapa_sql("dense")
CTES["imapa"] = """
        SELECT item_code, arg_min(w, (round(rmse, 12), w)) AS imapa_window, arg_min(forecast, (round(rmse, 12), w)) AS forecast
        FROM imapa_all GROUP BY 1"""
CTES["season"] = """
        SELECT s.item_code, c.r, CASE WHEN zero_share <= 0.3 AND r > 0.8114 THEN 'mul' ELSE 'add' END AS season_mode
        FROM (SELECT item_code, avg(CASE WHEN week_out = 0 THEN 1.0 ELSE 0 END) AS zero_share FROM dense GROUP BY 1) s
        LEFT JOIN (SELECT item_code, corr(amp, lev) AS r
              FROM (SELECT item_code, t // 52 AS c, max(week_out) - min(week_out) AS amp, avg(week_out) AS lev
                    FROM dense WHERE t < (n // 52) * 52 GROUP BY 1, 2)
              GROUP BY 1 HAVING stddev_pop(amp) > 0 AND stddev_pop(lev) > 0) c USING (item_code)"""
# Supplier items only: their series as lists, then one recursion step per week.
CTES["lists"] = """
        SELECT item_code, list(CAST(week_out AS DOUBLE) ORDER BY t) AS v, CAST(max(n) AS INTEGER) AS n
        FROM dense WHERE item_code LIKE 'S%' GROUP BY 1"""
CTES["hwstart"] = """
        SELECT item_code, v, n, mode, a, b, g, CAST(52 AS INTEGER) AS t, list_sum(v[1:52]) / 52 AS l,
               (list_sum(v[53:104]) - list_sum(v[1:52])) / (52 * 52) AS tr,
               CASE WHEN mode = 'add'
                    THEN list_transform(generate_series(1, 52), lambda x: v[x] - (v[x] + v[x + 52]) / 2)
                    ELSE list_transform(generate_series(1, 52), lambda x: CASE WHEN v[x] + v[x + 52] > 0 THEN v[x] / ((v[x] + v[x + 52]) / 2) ELSE 1.0 END)
               END AS s
        FROM lists, hwgrid"""
CTES["hw"] = """
        SELECT item_code, v, n, mode, a, b, g, t, l, tr, s FROM hwstart
        UNION ALL
        SELECT item_code, v, n, mode, a, b, g, t + 1, nl, ntr,
               list_append(s[2:52], CASE WHEN mode = 'add' THEN g * (v[t + 1] - nl) + (1 - g) * s[1]
                                         WHEN abs(nl) > 1e-10 THEN g * (v[t + 1] / nl) + (1 - g) * s[1] ELSE s[1] END)
        FROM (SELECT *, b * (nl - l) + (1 - b) * tr AS ntr
              FROM (SELECT *, a * CASE WHEN mode = 'add' THEN v[t + 1] - s[1] WHEN abs(s[1]) > 1e-10 THEN v[t + 1] / s[1]
                                       ELSE v[t + 1] END + (1 - a) * (l + tr) AS nl
                    FROM hw WHERE t < n))"""
CTES["hwfit"] = """
        SELECT item_code, mode, a, b, g, greatest(0, CASE WHEN mode = 'add' THEN l + tr + s[1] ELSE (l + tr) * s[1] END) AS forecast,
               CASE WHEN tr > 0.05 * l THEN 'up' WHEN tr < -0.05 * l THEN 'down' ELSE 'flat' END AS direction
        FROM hw WHERE t = n"""
CTES["hwgrid"] = """
        SELECT mode, a, b, g FROM (VALUES ('add'), ('mul')) m(mode), (VALUES (0.3::DOUBLE, 0.1::DOUBLE, 0.1::DOUBLE)) p(a, b, g)"""

CTES["hits"] = """
        SELECT item_code, t, n, week_out, row_number() OVER (PARTITION BY item_code ORDER BY t) AS hit,
               count(*) OVER (PARTITION BY item_code) AS hits FROM dense WHERE week_out > 0"""
CTES["longf"] = """
        SELECT p.item_code, 'tsb' AS method, coalesce(tsb.forecast, 0) AS forecast, 'intermittent' AS trend, NULL AS imapa_window
        FROM pattern p LEFT JOIN tsb USING (item_code) WHERE pattern = 'intermittent'
        UNION ALL
        SELECT p.item_code, 'imapa', i.forecast, 'lumpy', imapa_window FROM pattern p JOIN imapa i USING (item_code) WHERE pattern = 'lumpy'
        UNION ALL
        SELECT p.item_code, 'holt_winters', h.forecast, h.direction, NULL FROM pattern p JOIN season s USING (item_code)
        JOIN hwfit h ON h.item_code = p.item_code AND h.mode = s.season_mode WHERE pattern IN ('smooth', 'erratic')"""
# The whole grid a = i/20, b = j/20, g = k/20. The additive forecast is a weighted sum of the series, with weights by
# running the recurrence backwards over 357 weeks; the multiplicative one is stepped through per item and point.
CTES["hwpoints"] = """
        SELECT i / 20.0::DOUBLE AS a, j / 20.0::DOUBLE AS b, k / 20.0::DOUBLE AS g
        FROM (SELECT unnest(generate_series(1, 19)) AS i), (SELECT unnest(generate_series(1, 19)) AS j), (SELECT unnest(generate_series(1, 19)) AS k)"""
CTES["hwback"] = """
        SELECT a, b, g, list_reduce(generate_series(1, 357 - 52), lambda r, x: {
                   'l': (1 - a) * (r.l + b * r.t - g * r.s[1]) - b * r.t, 't': (1 - a) * (r.l + b * r.t - g * r.s[1]) + (1 - b) * r.t,
                   's': list_append(r.s[2:52], (1 - g) * r.s[1] - a * (r.l + b * r.t - g * r.s[1])),
                   'w': list_append(r.w, a * (r.l + b * r.t - g * r.s[1]) + g * r.s[1])},
               {'l': 1.0::DOUBLE, 't': 1.0::DOUBLE, 's': list_transform(generate_series(1, 52), lambda x: CASE WHEN x = 52 THEN 1.0 ELSE 0.0 END::DOUBLE), 'w': []::DOUBLE[]}) AS r
        FROM hwpoints"""
CTES["hwweights"] = """
        SELECT a, b, g, list_transform(generate_series(0, 356), lambda t: CASE
                   WHEN t < 52 THEN r.l / 52 - r.t / (52 * 52) + r.s[52 - t] / 2
                   WHEN t < 104 THEN r.w[357 - t] + r.t / (52 * 52) - r.s[104 - t] / 2 ELSE r.w[357 - t] END) AS w
        FROM hwback"""
CTES["serieslists"] = """
        SELECT item_code, season_mode AS mode, v FROM (SELECT item_code, list(CAST(week_out AS DOUBLE) ORDER BY t) AS v FROM dense GROUP BY 1) JOIN season USING (item_code)"""
CTES["hwall"] = """
        SELECT item_code, a, b, g, greatest(0, list_inner_product(v, w)) AS forecast FROM serieslists, hwweights WHERE mode = 'add'
        UNION ALL
        SELECT item_code, a, b, g, greatest(0, (r.l + r.t) * r.s[1])
        FROM (SELECT item_code, a, b, g, list_reduce(v[53:357], lambda r, x: list_transform([a * CASE WHEN abs(r.s[1]) > 1e-10 THEN x / r.s[1] ELSE x END + (1 - a) * (r.l + r.t)],
                       lambda nl: {'l': nl, 't': b * (nl - r.l) + (1 - b) * r.t,
                                   's': list_append(r.s[2:52], CASE WHEN abs(nl) > 1e-10 THEN g * (x / nl) + (1 - g) * r.s[1] ELSE r.s[1] END)})[1],
                     {'l': list_sum(v[1:52]) / 52, 't': (list_sum(v[53:104]) - list_sum(v[1:52])) / (52 * 52),
                      's': list_transform(generate_series(1, 52), lambda y: CASE WHEN v[y] + v[y + 52] > 0 THEN v[y] / ((v[y] + v[y + 52]) / 2) ELSE 1.0 END)}) AS r
              FROM serieslists, hwpoints WHERE mode = 'mul')"""
CTES["hwbest"] = """
        SELECT item_code, arg_min({'a': a, 'b': b, 'g': g, 'f': forecast}, (round(abs(forecast - mean_out), 9), a, b, g)) AS p
        FROM hwall JOIN pattern USING (item_code) GROUP BY 1"""

# --- planning chain ------------------------------------------------------------------------
CTES["spread"] = """
        SELECT item_code, avg(week_out) AS mean_out, coalesce(stddev_samp(week_out), 0) AS std_all,
               coalesce(stddev_samp(week_out) FILTER (WHERE week_out > 0), 0) AS std_nonzero,
               arg_max(week_balance, week_key) AS balance
        FROM weekly GROUP BY 1"""


def plan_sql(std: str = "std_all", variable: str = "0", lead: int = 1) -> str:
    """The inventory plan of fixtures ``classes``, ``given`` and ``master``."""
    return f"""
        WITH base AS (
          SELECT s.*, coalesce(c.combo, 'BX') AS combo, coalesce(g.forecast, s.mean_out) AS forecast, g.method,
                 m.lifecycle, m.shelf_life_days, m.production_date, {std} AS std_out
          FROM spread s LEFT JOIN classes c USING (item_code) LEFT JOIN given g USING (item_code) LEFT JOIN master m USING (item_code)),
        levels AS (
          SELECT b.*, l.service_level AS class_level, l.policy, l.period,
                 CASE l.service_level WHEN 0.99 THEN 2.33 WHEN 0.97 THEN 1.88 WHEN 0.95 THEN 1.65 WHEN 0.90 THEN 1.28 ELSE 1.04 END::DOUBLE AS z,
                 CASE WHEN b.forecast > 0 THEN sqrt(2 * 52 * b.forecast * 100 / 0.2) ELSE 0 END AS eoq
          FROM base b JOIN (VALUES ('AX', 0.99, 'p', 1), ('AY', 0.97, 'p', 1), ('AZ', 0.95, 'o', NULL), ('BX', 0.97, 'p', 1), ('BY', 0.95, 'p', 2),
                 ('BZ', 0.90, 'o', NULL), ('CX', 0.95, 'q', NULL), ('CY', 0.90, 'q', NULL), ('CZ', 0.85, 'o', NULL)) l(combo, service_level, policy, period)
            USING (combo)),
        safe AS (
          SELECT *, CASE WHEN shelf_life_days > 0 AND mean_out > 0 THEN least(ss0, mean_out * (shelf_life_days / 7.0::DOUBLE) * 0.8) ELSE ss0 END AS ss1
          FROM (SELECT *, CASE WHEN {variable} > 0 AND mean_out > 0
                               THEN z * sqrt({lead} * std_out * std_out + mean_out * mean_out * power({variable}, 2))
                               ELSE z * std_out * sqrt({lead}) END AS ss0 FROM levels)),
        rop AS (SELECT *, CASE WHEN policy <> 'o' THEN forecast * {lead} + ss1 END AS rop1 FROM safe),
        top AS (
          SELECT *, CASE WHEN shelf_life_days > 0 AND mean_out > 0 THEN least(max0, mean_out * (shelf_life_days / 7.0::DOUBLE) * 0.6) ELSE max0 END AS max1
          FROM (SELECT *, CASE WHEN policy = 'p' THEN forecast * (period + {lead}) + ss1 ELSE coalesce(rop1, 0) + eoq END AS max0 FROM rop)),
        cycle AS (
          SELECT *, CASE WHEN max1 > 0 THEN balance / max1 * 100 ELSE 0 END AS stock_level_pct,
                 CASE lifecycle WHEN 'launch' THEN greatest(ss1, 2 * mean_out) WHEN 'active' THEN ss1 ELSE 0 END AS safety_stock,
                 CASE lifecycle WHEN 'launch' THEN 0.99 ELSE class_level END::DOUBLE AS service_level,
                 CASE lifecycle WHEN 'launch' THEN forecast * {lead} + greatest(ss1, 2 * mean_out) WHEN 'active' THEN rop1 END AS reorder_point,
                 CASE lifecycle WHEN 'phase_out' THEN balance ELSE max1 END AS max_stock
          FROM top)
        SELECT *, CASE WHEN reorder_point IS NOT NULL AND balance <= safety_stock THEN 'shortage_risk'
                       WHEN reorder_point IS NOT NULL AND balance <= reorder_point THEN 'reorder'
                       WHEN balance >= max_stock THEN 'overstock' ELSE 'normal' END AS status,
               (safety_stock + max_stock) / 2 * 0.2 AS holding_cost,
               CASE WHEN eoq > 0 THEN forecast * 52 / eoq ELSE 0 END * 100 AS ordering_cost
        FROM cycle"""


CTES["plan"] = plan_sql()
CTES["arrows"] = """
        SELECT item_code, CASE WHEN a > b * 1.15 THEN '↑' WHEN a < b * 0.85 THEN '↓' ELSE '→' END AS demand_arrow
        FROM (SELECT item_code, max(week_out) FILTER (WHERE t = n - 1) AS a, max(week_out) FILTER (WHERE t = n - 2) AS b FROM dense GROUP BY 1)"""
# in transit: an own quantity for every fifth part, a supplier quantity for every third supplier
CTES["transit"] = """
        SELECT s.item_code, p.supplier,
               coalesce(nullif(CASE WHEN k % 5 = 0 THEN CAST(k % 10 AS DOUBLE) END, 0), CASE WHEN sup % 3 = 0 THEN CAST(sup % 7 AS DOUBLE) + 1 END, 0) AS in_transit_qty
        FROM summary s LEFT JOIN prefer p USING (item_code)"""
CTES["prefer"] = """
        SELECT item_code, CAST(sup AS VARCHAR) AS supplier, sup
        FROM (SELECT 'P' || l_partkey AS item_code, min(l_suppkey) AS sup FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY 1)"""
CTES["alerts"] = """
        WITH base AS (
          SELECT p.*, t.supplier, t.in_transit_qty, a.demand_arrow, substr(combo, 1, 1) AS abc_class,
                 CASE WHEN mean_out > 0 THEN (balance + in_transit_qty) / mean_out WHEN balance + in_transit_qty > 0 THEN 1e9 ELSE 0 END AS weeks_left,
                 CASE WHEN shelf_life_days > 0 AND balance > 0 THEN shelf_life_days - (DATE '2001-11-05' - production_date) END AS days_left
          FROM plan p JOIN transit t USING (item_code) JOIN arrows a USING (item_code)),
        dated AS (
          SELECT *, CASE WHEN mean_out > 0 AND weeks_left > 0 THEN DATE '2001-11-05' + CAST(floor(weeks_left * 7) AS INTEGER) END AS stockout_date,
                 CASE WHEN mean_out > 0 AND weeks_left > 0 THEN DATE '2001-11-05' + CAST(floor(greatest(0, weeks_left - 1) * 7) AS INTEGER) END AS order_by_date,
                 CASE WHEN days_left <= 30 THEN 'high' WHEN days_left <= shelf_life_days * 0.3 THEN 'medium' END AS severity
          FROM base)
        SELECT item_code, abc_class, combo, lifecycle, supplier, in_transit_qty, weeks_left, stockout_date, order_by_date, demand_arrow, days_left, eoq,
               balance, safety_stock, reorder_point, 'shortage' AS alert_type, CASE abc_class WHEN 'A' THEN 'urgent' WHEN 'B' THEN 'important' ELSE 'normal' END AS urgency,
               safety_stock - balance AS quantity, greatest(0, coalesce(reorder_point, 0) - balance - in_transit_qty) AS buy_qty, 'buy' AS action
        FROM dated WHERE lifecycle IN ('active', 'launch') AND status = 'shortage_risk'
        UNION ALL
        SELECT item_code, abc_class, combo, lifecycle, supplier, in_transit_qty, weeks_left, stockout_date, order_by_date, demand_arrow, days_left, eoq,
               balance, safety_stock, reorder_point, 'reorder', CASE abc_class WHEN 'A' THEN 'this_week' WHEN 'B' THEN 'this_month' ELSE 'this_quarter' END,
               greatest(0, coalesce(reorder_point, 0) - balance + safety_stock - in_transit_qty),
               greatest(0, coalesce(reorder_point, 0) - balance + safety_stock - in_transit_qty), 'buy'
        FROM dated WHERE lifecycle IN ('active', 'launch') AND status = 'reorder'
        UNION ALL
        SELECT item_code, abc_class, combo, lifecycle, supplier, in_transit_qty, weeks_left, stockout_date, order_by_date, demand_arrow, days_left, eoq,
               balance, safety_stock, reorder_point, 'overstock', NULL, balance - max_stock, NULL,
               CASE abc_class WHEN 'A' THEN 'return_to_supplier' WHEN 'B' THEN 'promote' ELSE 'keep' END
        FROM dated WHERE lifecycle IN ('active', 'launch') AND status = 'overstock'
        UNION ALL
        SELECT item_code, abc_class, combo, lifecycle, supplier, in_transit_qty, weeks_left, stockout_date, NULL, demand_arrow, days_left, eoq,
               balance, safety_stock, reorder_point, 'clearance', NULL, balance, NULL, 'clear stock, stop buying'
        FROM dated WHERE lifecycle = 'phase_out' AND balance > 0
        UNION ALL
        SELECT item_code, abc_class, combo, lifecycle, supplier, in_transit_qty, weeks_left, stockout_date, order_by_date, demand_arrow, days_left, eoq,
               balance, safety_stock, reorder_point, 'expiry', severity, days_left, NULL,
               CASE severity WHEN 'high' THEN 'promote, discount or scrap' ELSE 'use first, adjust plan' END
        FROM dated WHERE severity IS NOT NULL"""


def purchases_sql(formula: str = "full") -> str:
    net = "CASE WHEN demand_qty IS NULL THEN buy_qty ELSE full_qty END" if formula == "net" else "full_qty"
    return f"""
        SELECT *, greatest(needed_qty, 20) AS order_qty,
               CASE WHEN eoq > 0 AND needed_qty > 0 AND needed_qty < eoq * 0.5 THEN 1 ELSE 0 END + CASE WHEN needed_qty < 20 THEN 1 ELSE 0 END AS warnings,
               CASE abc_class WHEN 'A' THEN 100 WHEN 'B' THEN 50 ELSE 10 END + CASE alert_type WHEN 'shortage' THEN 200 ELSE 100 END AS priority,
               DATE '2001-11-05' + CAST(7 * CASE urgency WHEN 'urgent' THEN 0 WHEN 'this_week' THEN 1 WHEN 'this_month' THEN 4
                 WHEN 'this_quarter' THEN greatest(1, 12 - (dayofyear(DATE '2001-11-05') // 30) % 3) ELSE 1 END AS INTEGER) AS order_date
        FROM (SELECT *, {net} AS needed_qty
              FROM (SELECT a.*, d.demand_qty, greatest(0, coalesce(d.demand_qty, a.buy_qty)
                       + CASE WHEN alert_type = 'shortage' THEN safety_stock ELSE 0 END - balance - in_transit_qty) AS full_qty
                    FROM alerts a LEFT JOIN demand d USING (item_code) WHERE alert_type IN ('shortage', 'reorder')))"""


CTES["purchases"] = purchases_sql()


def closure(names: list[str]) -> list[str]:
    """The named CTEs and all they use, each after the ones it reads."""
    wanted: set[str] = set()
    queue = list(names)
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            words = set(re.findall(r"\w+", CTES[name])) - {name}
            queue += [w for w in CTES if w in words]
    ordered: list[str] = []

    def place(name: str) -> None:
        if name not in ordered:
            for word in CTES:
                if word in wanted and word != name and re.search(rf"\b{word}\b", CTES[name]):
                    place(word)
            ordered.append(name)

    for name in CTES:
        if name in wanted:
            place(name)
    return ordered
