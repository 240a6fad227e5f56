"""Overview, classification: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import Inputs
from checks.registry import query
from granary.operators import classify as C, overview as O


@query(
    "inventory_totals",
    "SELECT sum(opening_qty) AS total_opening, sum(closing_qty) AS total_closing, count(DISTINCT item_code) AS unique_items FROM summary",
    need="summary",
)
def inventory_totals(i: Inputs):
    return O.inventory_totals(i.summary())


@query(
    "stock_by_item",
    "SELECT item_code, sum(opening_qty) AS total_opening, sum(closing_qty) AS total_closing FROM summary GROUP BY 1",
    need="summary",
)
def stock_by_item(i: Inputs):
    return O.stock_by_item(i.summary())


@query(
    "top_stock",
    """SELECT item_code, sum(opening_qty) AS total_opening, sum(closing_qty) AS total_closing FROM summary
    GROUP BY 1 ORDER BY total_opening DESC, item_code LIMIT 10""",
    need="summary",
)
def top_stock(i: Inputs):
    return O.top_stock(i.summary())


@query(
    "last_stock",
    """SELECT item_code, sum(opening_qty) AS total_opening, sum(closing_qty) AS total_closing FROM summary
    GROUP BY 1 ORDER BY total_opening, item_code DESC LIMIT 10""",
    need="summary",
)
def last_stock(i: Inputs):
    return O.last_stock(i.summary())


@query(
    "flow_totals",
    """SELECT total_in, total_out, total_in - total_out AS net_change,
    CASE WHEN total_in > total_out THEN 'up' WHEN total_in < total_out THEN 'down' ELSE 'flat' END AS flow_direction
    FROM (SELECT sum(in_qty) AS total_in, sum(out_qty) AS total_out FROM summary)""",
    need="summary",
)
def flow_totals(i: Inputs):
    return O.flow_totals(i.summary())


@query(
    "top_in",
    "SELECT item_code, in_qty AS total_in, out_qty AS total_out FROM summary ORDER BY in_qty DESC, item_code LIMIT 10",
    need="summary",
)
def top_in(i: Inputs):
    return O.top_in(i.summary())


@query(
    "top_out",
    "SELECT item_code, in_qty AS total_in, out_qty AS total_out FROM summary ORDER BY out_qty DESC, item_code LIMIT 10",
    need="summary",
)
def top_out(i: Inputs):
    return O.top_out(i.summary())


TURNED = """
SELECT *, CASE WHEN turnover_rate > 0 THEN 91 / turnover_rate END AS turnover_days,
       CASE WHEN turnover_rate > 0 THEN 13 / turnover_rate END AS turnover_weeks,
       CASE WHEN avg_week_out > 0 THEN closing_qty / avg_week_out * 7 END AS days_on_hand,
       coalesce(13 / nullif(turnover_rate, 0), 1e300) > 12 AS slow_moving
FROM (SELECT s.*, b.*, CASE WHEN b.avg_week_balance > 0 THEN b.total_week_out / b.avg_week_balance ELSE 0 END AS turnover_rate
      FROM summary s LEFT JOIN (SELECT item_code AS code, avg(week_balance) AS avg_week_balance, sum(week_out) AS total_week_out,
                                       avg(week_out) AS avg_week_out FROM weekly GROUP BY 1) b ON b.code = s.item_code)
"""
_TURN = ("item_code", "closing_qty", "avg_week_balance", "total_week_out", "avg_week_out", "turnover_rate",
         "turnover_days", "turnover_weeks", "days_on_hand", "slow_moving")


def turned(i: Inputs):
    return O.turnover(i.summary(), i.weekly())


@query(
    "turnover",
    f"""SELECT item_code, closing_qty, R(avg_week_balance) AS avg_week_balance, total_week_out, R(avg_week_out) AS avg_week_out,
    R(turnover_rate) AS turnover_rate, R(turnover_days) AS turnover_days, R(turnover_weeks) AS turnover_weeks,
    R(days_on_hand) AS days_on_hand, slow_moving FROM ({TURNED})""",
    need="summary weekly",
)
def turnover(i: Inputs):
    return turned(i).select(*_TURN)


@query(
    "slow_moving",
    f"SELECT item_code, R(turnover_weeks) AS turnover_weeks FROM ({TURNED}) WHERE slow_moving",
    need="summary weekly",
)
def slow_moving(i: Inputs):
    return O.slow_moving(turned(i)).select("item_code", "turnover_weeks")


@query(
    "days_on_hand",
    f"SELECT item_code, R(days_on_hand) AS days_on_hand FROM ({TURNED})",
    need="summary weekly",
)
def days_on_hand(i: Inputs):
    return turned(i).select("item_code", "days_on_hand")


@query(
    "turnover_kpis",
    f"""SELECT R(avg(turnover_rate) FILTER (WHERE turnover_rate > 0)) AS avg_turnover_rate,
    count(*) FILTER (WHERE slow_moving) AS slow_count, sum(closing_qty) AS total_closing,
    coalesce(sum(closing_qty) FILTER (WHERE slow_moving), 0.0) AS slow_closing,
    R(coalesce(sum(closing_qty) FILTER (WHERE slow_moving), 0) / sum(closing_qty) * 100) AS slow_share_pct FROM ({TURNED})""",
    need="summary weekly",
)
def turnover_kpis(i: Inputs):
    return O.turnover_kpis(turned(i))


@query(
    "capital_estimate",
    """SELECT 'completed' AS status, total_opening, total_closing, R(total_closing * 0.02) AS holding_cost,
    R(total_closing * 0.05) AS stockout_cost, R(amount) AS closing_amount, R(amount * 0.02) AS holding_cost_amount,
    R(amount * 0.05) AS stockout_cost_amount
    FROM (SELECT sum(opening_qty) AS total_opening, sum(closing_qty) AS total_closing,
                 CAST(sum(CAST(closing_qty * unit_price AS DECIMAL(18,2))) AS DOUBLE) AS amount
          FROM summary WHERE item_code LIKE 'P%')""",
    need="summary",
    digits=3,
)
def capital_estimate(i: Inputs):
    return O.capital_estimate(i.summary("P"))


FLOW = """SELECT item_code, in_qty AS total_in, out_qty AS total_out, opening_qty AS first_opening, closing_qty AS last_closing,
    in_qty - out_qty AS net_flow, CASE WHEN out_qty = 0 AND opening_qty > 0 THEN 'idle' WHEN out_qty > in_qty THEN 'consuming'
    WHEN in_qty > out_qty THEN 'accumulating' ELSE 'balanced' END AS flow_state FROM summary"""


@query("product_flow", FLOW, need="summary")
def product_flow(i: Inputs):
    return O.product_flow(i.summary())


# Orders as a ledger of several rows per item: part flows by half-year, so first and last differ.
HALVES = """SELECT item_code, year(d) * 10 + (month(d) - 1) // 6 AS half, sum(qin) AS in_qty,
    sum(CASE WHEN month(d) % 2 = 0 THEN q ELSE 0 END) AS out_qty, sum(q) AS opening_qty, max(q) AS closing_qty
    FROM lines WHERE item_code LIKE 'P%' GROUP BY 1, 2"""
HALF_FLOW = f"""SELECT *, total_in - total_out AS net_flow, CASE WHEN total_out = 0 AND first_opening > 0 THEN 'idle'
    WHEN total_out > total_in THEN 'consuming' WHEN total_in > total_out THEN 'accumulating' ELSE 'balanced' END AS flow_state
    FROM (SELECT item_code, sum(in_qty) AS total_in, sum(out_qty) AS total_out, arg_min(opening_qty, half) AS first_opening,
                 arg_max(closing_qty, half) AS last_closing FROM ({HALVES}) GROUP BY 1)"""


def halves(i: Inputs):
    rows = i.daily("P")
    half = F.year("date") * 10 + F.floor((F.month("date") - 1) / 6)
    return rows.groupBy("item_code", half.alias("half")).agg(
        F.sum("in_qty").alias("in_qty"),
        F.sum(F.when(F.month("date") % 2 == 0, F.col("out_qty")).otherwise(0.0)).alias("out_qty"),
        F.sum("out_qty").alias("opening_qty"),
        F.max("out_qty").alias("closing_qty"),
    )


@query("product_flow_ordered", HALF_FLOW, need="lines")
def product_flow_ordered(i: Inputs):
    return O.product_flow(halves(i), order="half")


@query(
    "flow_distribution",
    f"SELECT flow_state, count(*) AS items FROM ({HALF_FLOW}) GROUP BY 1",
    need="lines",
)
def flow_distribution(i: Inputs):
    return O.flow_distribution(O.product_flow(halves(i), order="half"))


@query(
    "abc_classify",
    "SELECT item_code, total_out, R(share) AS share, R(cum_share) AS cum_share, abc_class FROM abc",
    need="abc",
    digits=9,
)
def abc_classify(i: Inputs):
    return C.abc_classify(i.summary("P").drop("out_amount"))


@query(
    "abc_classify_amount",
    """SELECT item_code, total_out, total_amount, R(share) AS share, R(cum_share) AS cum_share,
    CASE WHEN cum_share <= 0.7 THEN 'A' WHEN cum_share <= 0.9 THEN 'B' ELSE 'C' END AS abc_class
    FROM (SELECT item_code, out_qty AS total_out, CAST(out_amount AS DOUBLE) AS total_amount,
                 CAST(out_amount AS DOUBLE) / CAST(sum(out_amount) OVER () AS DOUBLE) AS share,
                 CAST(sum(out_amount) OVER (ORDER BY out_amount DESC, item_code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
                 / CAST(sum(out_amount) OVER () AS DOUBLE) AS cum_share FROM summary WHERE item_code LIKE 'S%')""",
    need="summary",
    digits=9,
)
def abc_classify_amount(i: Inputs):
    rows = C.abc_classify(i.summary("S"))
    return rows.withColumn("total_amount", F.col("total_amount").cast("double"))


@query("abc_distribution", "SELECT abc_class, count(*) AS items FROM abc GROUP BY 1", need="abc")
def abc_distribution(i: Inputs):
    return C.abc_distribution(C.abc_classify(i.summary("P").drop("out_amount")))


@query(
    "xyz_classify",
    """SELECT item_code, R(std_out) AS std_out, R(mean_out) AS mean_out, total_out, points, R(cv) AS cv, xyz_class FROM xyz""",
    need="xyz",
)
def xyz_classify(i: Inputs):
    return C.xyz_classify(i.bucketed()).drop("x_limit", "y_limit")


@query(
    "xyz_classify_weekly",
    """SELECT item_code, R(std_out) AS std_out, R(mean_out) AS mean_out, total_out, points,
    R(CASE WHEN mean_out > 0 THEN std_out / mean_out END) AS cv,
    CASE WHEN std_out / mean_out <= 1.0 THEN 'X' WHEN std_out / mean_out <= 4.0 THEN 'Y' ELSE 'Z' END AS xyz_class,
    1.0::DOUBLE AS x_limit, 4.0::DOUBLE AS y_limit FROM stats""",
    need="stats",
)
def xyz_classify_weekly(i: Inputs):
    return C.xyz_classify(i.dense_weekly(), 1.0, 4.0)


@query("xyz_distribution", "SELECT xyz_class, count(*) AS items FROM xyz GROUP BY 1", need="xyz")
def xyz_distribution(i: Inputs):
    return C.xyz_distribution(C.xyz_classify(i.bucketed()))


# Parts in half-year buckets give all three XYZ classes next to all flow states.
HALF_XYZ = f"""SELECT item_code, CASE WHEN count(*) < 3 THEN 'insufficient' WHEN stddev_samp(opening_qty) / avg(opening_qty) <= 0.6 THEN 'X'
    WHEN stddev_samp(opening_qty) / avg(opening_qty) <= 0.8 THEN 'Y' ELSE 'Z' END AS xyz_class FROM ({HALVES}) GROUP BY 1"""


def half_xyz(i: Inputs):
    weekly = halves(i).withColumnRenamed("opening_qty", "week_out")
    return C.xyz_classify(weekly, 0.6, 0.8).select("item_code", "xyz_class")


@query(
    "lifecycle_hints",
    f"""SELECT x.item_code, xyz_class, flow_state,
    CASE WHEN xyz_class = 'Z' AND flow_state IN ('consuming', 'accumulating') THEN 'review whether to keep or buy by order'
         WHEN flow_state = 'idle' THEN 'possibly dead stock, check'
         WHEN xyz_class = 'Z' AND flow_state = 'balanced' THEN 'volatile but balanced, review more often' END AS hint
    FROM ({HALF_XYZ}) x LEFT JOIN ({HALF_FLOW}) f USING (item_code)""",
    need="lines",
)
def lifecycle_hints(i: Inputs):
    return C.lifecycle_hints(half_xyz(i), O.product_flow(halves(i), order="half"))


MATRIX = f"""SELECT x.item_code, coalesce(abc_class, 'C') AS abc_class, xyz_class, coalesce(abc_class, 'C') || xyz_class AS combo
    FROM ({HALF_XYZ}) x LEFT JOIN (SELECT * FROM abc WHERE CAST(substr(item_code, 2) AS BIGINT) % 7 <> 0) a USING (item_code)"""


def matrix_items(i: Inputs):
    abc = C.abc_classify(i.summary("P").drop("out_amount")).filter("cast(substring(item_code, 2) as bigint) % 7 <> 0")
    return C.abc_xyz_items(abc, half_xyz(i))


@query("abc_xyz_matrix", f"SELECT combo, count(*) AS items FROM ({MATRIX}) GROUP BY 1", need="lines abc")
def abc_xyz_matrix(i: Inputs):
    return C.abc_xyz_matrix(matrix_items(i))


@query(
    "abc_xyz_grid",
    f"""SELECT abc_class, count(*) FILTER (WHERE xyz_class = 'X') AS "X", count(*) FILTER (WHERE xyz_class = 'Y') AS "Y",
    count(*) FILTER (WHERE xyz_class = 'Z') AS "Z" FROM ({MATRIX}) GROUP BY 1""",
    need="lines abc",
)
def abc_xyz_grid(i: Inputs):
    return C.abc_xyz_grid(matrix_items(i))


STRATEGY = """(VALUES ('AX','99%','daily','low'),('AY','97%','weekly','medium'),('AZ','95%','fortnightly','high or by order'),
 ('BX','97%','weekly','low'),('BY','95%','fortnightly','medium'),('BZ','90%','monthly','high or by order'),
 ('CX','95%','monthly','low'),('CY','90%','monthly','medium'),('CZ','85%','quarterly','by order or drop'))
 t(combo, service_level, count_frequency, stock_rule)"""


@query(
    "control_strategy",
    f"""SELECT m.*, coalesce(service_level, 'N/A') AS service_level, coalesce(count_frequency, 'N/A') AS count_frequency,
    coalesce(stock_rule, 'ask an administrator') AS stock_rule FROM ({MATRIX}) m LEFT JOIN {STRATEGY} USING (combo)""",
    need="lines abc",
)
def control_strategy(i: Inputs):
    return C.control_strategy(matrix_items(i)).drop("replenishment", "remark")


@query(
    "classification_map",
    f"""SELECT coalesce(a.item_code, x.item_code) AS item_code, coalesce(abc_class, 'B') || coalesce(xyz_class, 'Y') AS combo
    FROM (SELECT * FROM abc WHERE CAST(substr(item_code, 2) AS BIGINT) % 7 <> 0) a
    FULL JOIN (SELECT * FROM ({HALF_XYZ}) WHERE CAST(substr(item_code, 2) AS BIGINT) % 5 <> 0) x ON a.item_code = x.item_code""",
    need="lines abc",
)
def classification_map(i: Inputs):
    abc = C.abc_classify(i.summary("P").drop("out_amount")).filter("cast(substring(item_code, 2) as bigint) % 7 <> 0")
    xyz = half_xyz(i).filter("cast(substring(item_code, 2) as bigint) % 5 <> 0")
    return C.classification_map(abc=abc, xyz=xyz)
