"""Limits, ties, skew and plan shapes of the relational operators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from granary.functions import ordering
from granary.functions.ordering import running_total
from granary.operators import (
    alerts as J,
    classify as C,
    kpi as K,
    matching as M,
    overview as O,
    planning as P,
    purchasing as B,
    suppliers as E,
)


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_running_total_with_hot_ties(spark):
    rng = random.Random(1)
    rows = [(f"i{n:04d}", 7.0 if n % 3 else float(rng.randint(0, 500))) for n in range(2000)]
    df = frame(spark, rows, "item_code string, q double")
    got = running_total(df, [(F.col("q"), True), (F.col("item_code"), False)], "q", "run", "rank", slices=7).collect()
    expected, total = {}, 0.0
    for rank, (item, q) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), start=1):
        total += q
        expected[item] = (total, rank)
    assert {r["item_code"]: (r["run"], r["rank"]) for r in got} == expected


def test_running_total_of_few_rows_and_nulls(spark):
    keys = [(F.col("q"), True), (F.col("item_code"), False)]
    assert running_total(frame(spark, [], "item_code string, q double"), keys, "q", "run", "rank", "all", slices=7).count() == 0
    rows = [("b", None), ("a", 2.0), (None, 2.0), ("c", -1.0)]
    got = running_total(frame(spark, rows, "item_code string, q double"), keys, "q", "run", "rank", slices=3).collect()
    assert {r["item_code"]: (r["rank"], r["run"]) for r in got} == {None: (1, 2.0), "a": (2, 4.0), "c": (3, 3.0), "b": (4, 3.0)}


def test_slices_are_even_and_cost_no_job_while_planned(spark):
    rows = [(f"i{n:05d}", 7.0 if n % 3 else float(n)) for n in range(20000)]
    df = frame(spark, rows, "item_code string, q double")
    keys = [(F.col("q"), True), (F.col("item_code"), False)]
    spark.sparkContext.setJobGroup("slices", "slices")
    tracker = spark.sparkContext.statusTracker()
    ranked = running_total(df, keys, "q", "run", "rank", slices=16)
    classes = C.abc_classify(df.withColumnRenamed("q", "out_qty"))
    assert list(tracker.getJobIdsForGroup("slices")) == []
    assert classes.count() == ranked.count() == 20000
    spark.sparkContext.setJobGroup("", "")
    keyed = df.withColumn(ordering._KEY, ordering.sort_key(keys))
    sizes = ordering._sliced(keyed, 16).groupBy(ordering._SLICE).count().collect()
    assert len(sizes) == 16 and max(n for _, n in sizes) < 2 * 20000 / 16


def test_abc_limits_are_inclusive(spark):
    # shares 70 %, 20 %, 10 %: cumulative exactly .70 and .90
    df = frame(spark, [("a", 70.0), ("b", 20.0), ("c", 10.0)], "item_code string, out_qty double")
    assert {r["item_code"]: r["abc_class"] for r in C.abc_classify(df).collect()} == {"a": "A", "b": "B", "c": "C"}
    nothing = frame(spark, [("a", 0.0)], "item_code string, out_qty double")
    assert C.abc_classify(nothing).first()["abc_class"] == "C"


def test_xyz_limits(spark):
    rows = [("x", v) for v in (7.0, 10.0, 13.0)] + [("one", 5.0), ("none", 0.0), ("none", 0.0), ("none", 0.0)]
    got = {r["item_code"]: r for r in C.xyz_classify(frame(spark, rows, "item_code string, week_out double")).collect()}
    assert got["x"]["cv"] == 0.3 and got["x"]["xyz_class"] == "X"
    assert got["one"]["xyz_class"] == "insufficient"
    assert got["none"]["xyz_class"] == "Z" and got["none"]["cv"] == float("inf")
    combos = C.control_strategy(frame(spark, [("i", "AX"), ("j", "Ainsufficient")], "item_code string, combo string"))
    assert [r["service_level"] for r in combos.orderBy("item_code").collect()] == ["99%", "N/A"]


def test_turnover_guards(spark):
    summary = frame(spark, [("a", 10.0, 0.0, 0.0, 10.0), ("b", 1.0, 2.0, 3.0, 0.0)], "item_code string, opening_qty double, in_qty double, out_qty double, closing_qty double")
    weekly = frame(spark, [("a", 10.0, 0.0), ("b", 0.0, 3.0)], "item_code string, week_balance double, week_out double")
    got = {r["item_code"]: r for r in O.turnover(summary, weekly).collect()}
    assert got["a"]["turnover_rate"] == 0 and got["a"]["turnover_weeks"] == float("inf") and got["a"]["slow_moving"]
    assert got["b"]["turnover_rate"] == 0 and got["b"]["days_on_hand"] == 0
    assert O.capital_estimate(summary).first()["status"] == "skipped"


def test_supplier_limits(spark):
    rows = [("s90", f"2021-01-{d:02d}", "2021-01-10") for d in [10] * 9 + [11]]
    rows += [("s70", f"2021-01-{d:02d}", "2021-01-10") for d in [10] * 7 + [11] * 3]
    rows += [("late", None, "2021-01-10"), ("late", "bad", "2021-01-10")]
    df = frame(spark, rows, "supplier string, actual_date string, planned_date string")
    got = {r["supplier"]: r for r in E.delivery_risk(E.delivery_performance(df)).collect()}
    assert {k: v["delivery_risk"] for k, v in got.items()} == {"s90": "low", "s70": "medium", "late": "high"}
    assert got["late"]["on_time_share"] == 0 and got["late"]["deliveries"] == 2
    none = E.quality_performance(frame(spark, [("s", 0.0, 0.0)], "supplier string, qualified_qty double, delivered_qty double"))
    assert none.first()["quality_share"] == 0
    status = {r["dimension"]: r["status"] for r in E.supplier_dimensions(df).collect()}
    assert status == {"delivery": "available", "quality": "skipped", "dependency": "skipped"}
    assert E.risk_summary() is None


def test_gap_limits(spark):
    stock = frame(spark, [("tight", 91.0), ("short", 90.0), ("even", 100.0), ("extra", 5.0)], "item_code string, total_supply double")
    stock = stock.select("item_code", F.lit(0.0).alias("opening_qty"), F.col("total_supply").alias("on_hand_qty"), F.lit(0.0).alias("in_transit_qty"), "total_supply")
    demand = frame(spark, [("tight", 100.0), ("short", 100.0), ("even", 100.0), ("new", 1.0)], "item_code string, demand_qty double")
    got = {r["item_code"]: (r["gap_status"], r["has_demand"]) for r in M.match_supply_demand(stock, demand).collect()}
    assert got == {"tight": ("tight", True), "short": ("short", True), "even": ("sufficient", True), "extra": ("sufficient", False), "new": ("short", True)}
    with pytest.raises(ValueError):
        M.normalize_demand(frame(spark, [("a",)], "item_code string"))
    guessed = M.normalize_demand(frame(spark, [("a", "n", 3)], "item_code string, note string, amount int"))
    assert guessed.first()["demand_qty"] == 3.0


def items(spark, rows):
    return frame(spark, rows, "item_code string, balance double, safety_stock double, reorder_point double, max_stock double")


def test_status_limits(spark):
    df = items(spark, [("ss", 5.0, 5.0, 9.0, 20.0), ("rop", 9.0, 5.0, 9.0, 20.0), ("max", 20.0, 5.0, 9.0, 20.0), ("ok", 10.0, 5.0, 9.0, 20.0), ("mto", 1.0, 5.0, None, 20.0)])
    status = P.stock_status(F.col("balance"), F.col("safety_stock"), F.col("reorder_point"), F.col("max_stock"))
    got = {r["item_code"]: r["s"] for r in df.select("item_code", status.alias("s")).collect()}
    assert got == {"ss": "shortage_risk", "rop": "reorder", "max": "overstock", "ok": "normal", "mto": "normal"}


def test_lifecycle_in_plan_and_alerts(spark):
    weekly = [(i, w, 10.0 + w % 3, 40.0) for i in ("act", "new", "old", "out", "sold") for w in range(1, 11)]
    weekly = [(i, w, q, 0.0 if i == "sold" else b) for i, w, q, b in weekly]
    weekly = frame(spark, weekly, "item_code string, week_key int, week_out double, week_balance double")
    summary = frame(
        spark,
        [("act", "active", 30, "2021-01-01"), ("new", "launch", None, None), ("old", "phase_out", 400, "2021-01-01"), ("out", "obsolete", None, None), ("sold", "phase_out", None, None)],
        "item_code string, lifecycle string, shelf_life_days int, production_date string",
    ).withColumn("production_date", F.to_date("production_date"))
    plan = P.plan_inventory(weekly, summary)
    got = {r["item_code"]: r for r in plan.collect()}
    mean = got["act"]["mean_out"]
    assert got["new"]["safety_stock"] == 2 * mean and got["new"]["service_level"] == 0.99 and got["new"]["policy_method"] == "launch"
    assert got["old"]["reorder_point"] is None and got["old"]["max_stock"] == 40 and got["old"]["status"] == "overstock"
    assert got["act"]["max_stock"] <= mean * 30 / 7 * 0.6 + 1e-9
    assert len(got["act"]["future_rop"]) == 4 and got["act"]["future_rop"][0]["reorder_point"] is not None
    alerts = J.generate_alerts(plan, weekly, as_of="2021-02-01").collect()
    kinds = {(r["item_code"], r["alert_type"]) for r in alerts}
    assert ("old", "clearance") in kinds and ("act", "expiry") in kinds
    assert not {k for i, k in kinds if i == "out"}
    assert ("sold", "overstock") in kinds  # nothing left to clear: judged like any other item
    dates = {r["item_code"]: r for r in alerts if r["alert_type"] != "expiry"}
    assert str(dates["old"]["stockout_date"]) == "2021-02-26" and dates["old"]["order_by_date"] is None


def test_order_dates_and_split(spark):
    df = frame(spark, [("urgent",), ("this_week",), ("this_month",), ("this_quarter",), ("normal",)], "urgency string")
    got = {r["urgency"]: str(r["d"]) for r in df.select("urgency", B.order_date(F.col("urgency"), "2021-03-01").alias("d")).collect()}
    # day 60 of the year: 60 // 30 % 3 = 2, so the quarter rule gives 10 weeks
    assert got == {"urgent": "2021-03-01", "this_week": "2021-03-08", "this_month": "2021-03-29", "this_quarter": "2021-05-10", "normal": "2021-03-08"}
    alone = df.limit(1).select(B.supplier_split(F.lit("A"), F.lit(10.0), None).alias("s")).first()["s"]
    assert [a["supplier"] for a in alone] == ["unassigned"]


def test_kpi_compare_and_actions(spark):
    history = [(r, m, v) for m, vs in {"risk_count": [10, 5, 5, 8, 0, 3], "other": [1] * 6}.items() for r, v in enumerate(vs, start=1)]
    df = frame(spark, [(r, m, float(v)) for r, m, v in history], "run int, metric string, value double")
    trends = [r["trend"] for r in K.kpi_compare(df).orderBy("run").collect()]
    assert trends == ["first_record", "improved", "same", "worse", "improved", "first_record"]
    assert {r["run"] for r in K.kpi_history(df, keep=2).collect()} == {5, 6}
    metrics = frame(spark, [("shortage_count", 3.0), ("overstock_count", 0.0), ("total_alerts", 9.0)], "metric string, value double")
    assert [r["action"] for r in K.next_actions(metrics).collect()] == ["3 shortage alerts: review and order now"]
    assert [r["action"] for r in K.next_actions(metrics.filter("value > 100")).collect()] == [K.NO_ACTION]


def test_no_single_task_windows_or_cross_joins(spark):
    """No operator may gather all rows in one task: only totals go to a single partition."""
    summary = frame(spark, [("a", 1.0, 2.0, 3.0, 4.0)], "item_code string, opening_qty double, in_qty double, out_qty double, closing_qty double")
    from granary.operators.quality import detect_outliers

    abc = plan_text(C.abc_classify(summary))
    assert "CartesianProduct" not in abc and "BroadcastNestedLoopJoin" not in abc
    out = plan_text(detect_outliers(summary))
    assert "Window" not in out and "NestedLoop" not in out
    scorecard = frame(spark, [("s", 0.9, "low")], "supplier string, on_time_share double, delivery_risk string")
    matched = frame(spark, [("a", 5.0, "short")], "item_code string, gap_qty double, gap_status string")
    assert "Join" not in plan_text(M.allocate_shortages(matched, scorecard))


def test_profile_shuffles_the_weekly_table_once(spark):
    from granary.operators.forecast import forecast_demand

    weekly = frame(spark, [("a", 1, 1.0, 2.0)], "item_code string, week_key int, week_out double, week_balance double")
    assert plan_text(forecast_demand(weekly)).count("Exchange hashpartitioning") == 1


def test_two_scorecards_in_one_scan(spark):
    from checks.fixtures import Inputs
    from granary.operators import suppliers as E

    summary = E.risk_summary(cards=E.scorecards(Inputs(spark, "/root/testdata/sf0.001").deliveries()))
    summary.collect()
    plan = plan_text(summary)
    final = plan[: plan.index("== Initial Plan")] if "== Initial Plan" in plan else plan
    assert final.count("lineitem.parquet") == 1


def test_last_two_weeks_are_limited_before_the_shuffle(spark):
    from granary.operators import alerts as J

    rows = [("hot", f"1995-{w:03d}", float(w)) for w in range(500)] + [("a", "1", 10.0), ("a", "2", 5.0), ("b", "1", 3.0), ("c", None, 1.0)]
    df = frame(spark, rows, "item_code string, week_key string, week_out double").repartition(3)
    found = J.demand_arrow(df)
    assert {r["item_code"]: r["demand_arrow"] for r in found.collect()} == {"hot": "→", "a": "↓", "b": "→", "c": "→"}
    plan = plan_text(found)
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")  # printed top down: the limit stands below the exchange


def test_a_run_counts_once(spark, tmp_path):
    from granary.operators import kpi as K

    path = str(tmp_path / "kpis")
    run = lambda n, v: frame(spark, [(n, "m", v)], "run int, metric string, value double")
    K.append_kpis(run(1, 1.0), path)
    K.append_kpis(run(2, 2.0), path)
    K.append_kpis(run(1, 1.0), path)
    frame(spark, [(3, "m", 9.0, "left by a job that failed")], "run int, metric string, value double, batch string").write.mode("append").parquet(f"{path}/rows")
    assert sorted(map(tuple, K.read_kpis(spark, path).collect())) == [(1, "m", 1.0), (2, "m", 2.0)]


def test_dense_balance_is_the_running_balance_of_dense_weeks(spark):
    import datetime

    from granary.operators import forecast as G, ingest as N

    monday = datetime.date(2021, 12, 6)
    week = lambda n: monday + datetime.timedelta(7 * n)
    moves = [("a", week(0), 1.0, 2.5), ("a", week(3), 4.0, 0.5), ("b", week(2), 0.25, 9.0), ("b", week(8), 1.0, 1.0), ("late", week(9), 1.0, 3.0),
             ("two", week(1), 5.0, 2.0), ("two", week(4), 1.0, 7.0), (None, week(2), 1.0, 0.0), ("last", week(6), None, 3.0)]
    weekly = spark.createDataFrame(moves, "item_code string, week_start date, week_in double, week_out double")
    opening = spark.createDataFrame([("a", 10.0), ("b", None), ("late", 7.0), ("two", 3.0), ("two", 3.0), ("x", 1.0)], "item_code string, opening_qty double")
    first, last = F.lit(week(0)), F.lit(week(6))
    want = N.running_balance(G.densify(weekly, first, last), opening)
    got = N.dense_balance(weekly, opening, first, last)
    assert got.columns == want.columns
    plain = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert plain(got) == plain(want) and len(plain(got)) == 7 * 7
    # no dense row is sorted: above the weeks there is neither a sort nor a window
    above = got._jdf.queryExecution().optimizedPlan().toString().partition("Generate explode")[0]
    assert "Window" not in above and "Sort" not in above
    assert "Window" in want._jdf.queryExecution().optimizedPlan().toString().partition("Generate explode")[0]


def test_balances_are_added_up_before_the_opening_stock_is_joined(spark):
    from granary.operators import ingest as N

    moves = [("a", 3, 0.0, 1.0), ("a", 1, 5.0, 2.0), ("a", 2, None, 4.0), ("two", 2, 1.0, 4.0), ("two", 1, 3.0, 0.5), ("new", 1, 2.0, 0.0), (None, 1, 1.0, 0.0)]
    weekly = frame(spark, moves, "item_code string, week_key int, week_in double, week_out double")
    opening = frame(spark, [("a", 10.0), ("two", 1.0), ("two", 1.0), ("x", 4.0), (None, 9.0)], "item_code string, opening_qty double")
    got = N.running_balance(weekly, opening)
    assert got.columns == [*weekly.columns, "week_balance"]
    rows = sorted((r.item_code or "", r.week_key, r.week_balance) for r in got.collect())
    # both opening rows of "two" have their weeks, and the flows of both are added
    assert rows == [
        ("", 1, 1.0), ("a", 1, 13.0), ("a", 2, 13.0), ("a", 3, 12.0), ("new", 1, 2.0),
        ("two", 1, 3.5), ("two", 1, 6.0), ("two", 2, 0.0), ("two", 2, 3.0),
    ]
    # the join comes on top of the windows, so that the weekly rows are sorted once
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")


def test_the_chain_adds_line_items_up_to_a_summary_once(spark):
    from checks.fixtures import Inputs

    i = Inputs(spark, "nowhere")  # has no table to read
    kept = frame(spark, [("P5", 1.0)], "item_code string, out_qty double")
    i.kept["PS"] = kept
    assert i.summary() is kept
    assert [r.item_code for r in i.master().collect()] == [r.item_code for r in i.item_transit().collect()] == ["P5"]


def test_slices_are_found_by_halving(spark):
    from granary.functions.ordering import _up_to

    rows = frame(spark, [(k, b) for k in (-1, 0, 3, 4, 9, 99) for b in ([], [0], [0, 3, 4, 9], list(range(199)))], "k int, b array<int>")
    for r in rows.withColumn("n", _up_to("b", F.col("k"), 200)).collect():
        assert r["n"] == sum(x <= r["k"] for x in r["b"]), r


def test_weeks_of_many_items_are_not_one_task(spark):
    from granary.operators import alerts as J, forecast as G

    weeks = [datetime.date(2001, 1, 1) + datetime.timedelta(7 * w) for w in range(30)]
    moves = [(f"P{k}", weeks[k % 30], 0.0, 1.0) for k in range(300)]
    dense = G.densify(frame(spark, moves, "item_code string, week_start date, week_in double, week_out double"))
    # a task holds one of 200 shares of the items however small their moves are
    assert dense.rdd.getNumPartitions() >= 200
    assert J.demand_arrow(dense).count() == 300
