"""Hand-made ledger files: encodings, marks, ragged lines, fills, total rows, year end."""

import json

import pytest
from pyspark.sql import functions as F

from granary.operators import ingest as N, quality as Q
from granary.plans.chain import ingest_ledgers
from granary.sources import ledger as L, tables as T

DAYS = ["12/29", "12/30", "12/31", "1/1", "1/2", "1/3", "1/4", "1/5", "1/6", "1/7"]
DATES = ["库存明细", "", "", "12/28", "本月累计", "", ""] + [x for d in DAYS for x in (d, d, d)]
ACTIONS = ["物料分类", "物料编码", "物料名称", "库存", "入库", "出库", "结存"] + ["入库", "出库", "结存"] * len(DAYS)


def line(kind, code, opening, daily_in=1, daily_out=2):
    balance, cells, total = opening, [], 0
    for _ in DAYS:
        balance += daily_in - daily_out
        cells += [daily_in, daily_out, balance]
    total = len(DAYS)
    return [kind, code, "名称", opening, daily_in * total, daily_out * total, balance] + cells


def ledger_text():
    rows = [DATES, ACTIONS, line("原料", "G1", 100), line("", " G2 ", 200), line("原料", "", 300, 5, 5), line("原料", "G4", 50)]
    rows[5][3] = "abc"  # not a number
    rows.append(line("原料", "G5", 70) + ["extra", "cells"])  # longer than the header
    rows.append(["原料", "G6", "名称", 10, 0, 0, 10])  # shorter
    rows.append(["合计", "", "", 1, 2, 3, 4] + [9] * (3 * len(DAYS)))
    return "\n".join(",".join(str(c) for c in row) for row in rows) + "\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("ledgers")
    (base / "a.csv").write_bytes(ledger_text().encode("utf-8"))
    (base / "b.csv").write_bytes(ledger_text().encode("gbk"))
    (base / "c.csv").write_bytes("﻿".encode() + ledger_text().encode("utf-8"))
    (base / "d.csv").write_bytes(ledger_text().replace("名称", "caf\xe9 ").replace("原料", "x").encode("utf-8"))
    return base


def name(column="file"):
    return F.element_at(F.split(column, "/"), -1)


def test_encodings(spark, folder, tmp_path):
    (tmp_path / "latin.csv").write_bytes("caf\xe9,1\n".encode("latin-1") + b"\xff\xff,2\n")
    got = {r[0]: r[1] for r in L.probe_encoding(spark, [str(folder), str(tmp_path)]).select(name(), "encoding").collect()}
    assert got == {"a.csv": "utf-8", "b.csv": "gbk", "c.csv": "utf-8", "d.csv": "utf-8", "latin.csv": "latin-1"}


def test_layout(spark, folder):
    rows = L.number_rows(L.read_ledgers(spark, str(folder)))
    layouts = L.parse_ledger_layout(rows, reference_year=2020).collect()
    assert len(layouts) == 4
    for layout in layouts:
        assert (layout["opening_at"], layout["month_to_date_at"]) == (3, 4)
        days = [b["day"] for b in layout["blocks"]]
        # the year turns inside the file
        assert (str(days[0]), str(days[3]), str(days[-1])) == ("2020-12-29", "2021-01-01", "2021-01-07")
        assert [b["at"] for b in layout["blocks"]] == list(range(7, 37, 3))
        assert layout["fields"].asDict() == {"item_code": 1, "opening_qty": 3, "in_qty": 4, "out_qty": 5, "closing_qty": 6}


def test_date_labels(spark, tmp_path):
    text = "t,,,8/31,本月累计,,,2021-09-01 00:00:00,,,2021-09-02,,,﻿9/3,,,note,x,y\n" + ",".join(ACTIONS[:19]) + "\n"
    (tmp_path / "x.csv").write_text(text, encoding="utf-8")
    rows = L.number_rows(L.read_ledger_csv(spark, str(tmp_path)))
    layout = L.parse_ledger_layout(rows, reference_year=2021).first()
    assert [str(b["day"]) for b in layout["blocks"]] == ["2021-09-01", "2021-09-02", "2021-09-03"]
    (tmp_path / "x.csv").write_text("a,b\nc,d\n", encoding="utf-8")
    rows = L.number_rows(L.read_ledger_csv(spark, str(tmp_path)))
    problems = [r["problem"] for r in L.layout_problems(L.parse_ledger_layout(rows)).collect()]
    assert "no daily columns" in problems and "no column for item_code" in problems


def test_ingest(spark, folder, tmp_path):
    master = spark.createDataFrame(
        [("G1", "新品上市", "180", "2021-01-01", "x"), ("G4", "已淘汰", None, "bad", "y")],
        "`物料编码` string, `生命周期状态` string, `保质期天数` string, `生产日期` string, other string",
    )
    done = ingest_ledgers(spark, str(folder / "b.csv"), f"rows-{tmp_path.name}", reference_year=2020, master=master)
    summary = {r["item_code"]: r for r in done.summary.collect()}
    # the code of line three is filled from the line above, so it is a second G2 line and dropped
    assert sorted(summary) == ["G1", "G2", "G4", "G5", "G6"]
    assert summary["G2"]["opening_qty"] == 200 and summary["G4"]["opening_qty"] is None
    assert summary["G1"]["lifecycle"] == "launch" and summary["G1"]["shelf_life_days"] == 180
    assert summary["G4"]["lifecycle"] == "obsolete" and summary["G4"]["production_date"] is None
    errors = [(r["item_code"], r["column"], r["row_no"]) for r in done.errors.collect()]
    assert errors == [("G4", "opening_qty", 5)]
    # the total line has no code of its own; it must not count as a line of G6
    assert [(r["row_no"], r["reason"]) for r in done.excluded.collect()] == [(8, "total row")]
    assert summary["G6"]["in_qty"] == 0
    weekly = {(r["item_code"], r["week_key"]): r for r in done.weekly.collect()}
    # 2020-12-29..2021-01-03 is ISO week 53 of 2020, 2021-01-04.. is week 1 of 2021
    assert weekly[("G1", 202053)]["week_out"] == 12 and weekly[("G1", 202101)]["week_out"] == 8
    assert weekly[("G1", 202101)]["week_balance"] == 90
    assert weekly[("G2", 202053)]["week_in"] == 6 + 30
    assert weekly[("G6", 202053)]["week_in"] == 0
    window = done.window.first()
    assert (window["available_weeks"], window["first_week_days"], window["first_week_complete"]) == (2, 6, False)
    wrong = {(r["item_code"], r["check_name"]) for r in done.mismatches.collect()}
    assert ("G2", "inflow") in wrong and ("G1", "inflow") not in wrong
    assert done.problems.count() == 0


def test_forward_fill_crosses_chunks(spark):
    rows = [("f", c, c * 10 + r, (c, r), None if (c, r) in {(0, 0), (1, 0), (2, 0), (2, 1)} else f"{c}{r}") for c in range(4) for r in range(2)]
    df = spark.createDataFrame([(f, c, i, v) for f, c, i, _, v in rows], "file string, chunk int, row_id int, v string")
    got = [r["v"] for r in N.forward_fill(df, ["v"]).orderBy("row_id").collect()]
    assert got == [None, "01", "01", "11", "11", "11", "30", "31"]


def test_split_files_keep_their_order(spark, tmp_path):
    rows = [DATES, ACTIONS] + [line("原料", f"G{n}" if n % 3 == 0 else "", n) for n in range(3000)]
    (tmp_path / "big.csv").write_text("\n".join(",".join(str(c) for c in r) for r in rows), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        numbered = L.number_rows(L.read_ledger_csv(spark, str(tmp_path), width=len(ACTIONS)))
        assert numbered.select("chunk").distinct().count() > 5
        got = L.extract_summary(numbered, L.parse_ledger_layout(numbered)).orderBy("row_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["opening_qty"] for r in got] == [float(n) for n in range(3000)]
    assert [r["item_code"] for r in got] == [f"G{n - n % 3}" for n in range(3000)]
    assert [r["row_no"] for r in got] == list(range(2, 3002))


def test_total_rows_and_null_cells(spark):
    df = spark.createDataFrame(
        [("G1", None, 1.0), ("合计", 1.0, 1.0), ("  ", 1.0, 1.0), ("G2", 2.0, None), ("区域小计", 1.0, 2.0)],
        "item_code string, opening_qty double, in_qty double",
    )
    assert sorted(r["item_code"] for r in N.exclude_total_rows(df).collect()) == ["G1", "G2"]
    assert sorted(r["reason"] for r in N.excluded_rows(df).collect()) == ["blank item code", "total row", "total row"]


def test_standardize(spark):
    df = spark.createDataFrame([("a", 1, 2, 3, 4)], ["物料_编码", "期初库存", "入库 数量", "发货数量", "z"])
    renamed, report = N.standardize_columns(df, {"closing_qty": "z"})
    assert renamed.columns == ["item_code", "opening_qty", "in_qty", "out_qty", "closing_qty"]
    levels = {r["field"]: (r["level"], r["status"]) for r in report.collect()}
    assert levels["item_code"] == ("exact", "success") and levels["out_qty"][0] == "alias" and levels["closing_qty"][0] == "manual"
    _, report = N.standardize_columns(df.select("z"))
    assert {r["status"] for r in report.collect()} == {"failed"}


def test_demand_sources(spark, tmp_path):
    data = [{"物料编码": "0001", "需求量": 5000}, {"物料编码": "0002", "需求量": 3500.5}]
    expected = [("0001", 5000.0), ("0002", 3500.5)]
    text = json.dumps(data, ensure_ascii=False)
    (tmp_path / "d.json").write_text(text, encoding="utf-8")
    (tmp_path / "d.csv").write_bytes("物料号,数\n0001,5000\n0002,3500.5\n".encode("gbk"))
    for source in (text, str(tmp_path / "d.json"), str(tmp_path / "d.csv")):
        assert sorted(map(tuple, T.read_demand(spark, source).collect())) == expected, source
    with pytest.raises(ValueError):
        T.read_demand(spark, '[{"x": 1}]')


def test_report_sink_has_no_infinity(spark, tmp_path):
    df = spark.createDataFrame([("a", float("inf")), ("b", 1.0), ("c", float("nan"))], "item_code string, days double")
    path = str(tmp_path / "report")
    T.write_report({"one": df}, path)
    T.write_report({"two": df}, path, append=True)
    got = {r["item_code"]: r.asDict().get("days") for r in T.read_report(spark, path, "one").collect()}
    assert got == {"a": None, "b": 1.0, "c": None}
    assert T.read_report(spark, path, "two").count() == 3
    assert T.concat_diagonal([]) is None


def test_header_rows_and_profile(spark, folder):
    rows = L.number_rows(L.read_ledger_csv(spark, str(folder / "a.csv")))
    found = Q.detect_header_rows(rows).first()
    assert found["header_rows"] == [1] and found["multi_header"]
    df = spark.createDataFrame([("1", "2021-01-01", "x", None), ("2.5", "2021-01-02", "1", None)], "a string, b string, c string, d string")
    kinds = {r["column"]: r["type"] for r in Q.profile_table(df).collect()}
    assert kinds == {"a": "numeric", "b": "date", "c": "text", "d": "unknown"}


def test_outliers_skip_constant_and_short_columns(spark):
    rows = [(f"i{n}", 1.0, float(n % 3), 5.0, None) for n in range(50)] + [("far", 1.0, 900.0, 5.0, 3.0)]
    df = spark.createDataFrame(rows, "item_code string, opening_qty double, in_qty double, out_qty double, closing_qty double")
    assert [(r["item_code"], r["column"]) for r in Q.detect_outliers(df).collect()] == [("far", "in_qty")]


def test_forward_fill_shuffles_only_chunks_with_nulls(spark):
    keys = [("f", 0), ("f", 1), ("f", 2), (None, 0), (None, 1), ("g", None)]
    rows = [(f, c, 10 * k + r, None if r == 1 and (f, c) not in (("f", 0), ("f", 2)) else f"{k}{r}") for k, (f, c) in enumerate(keys) for r in range(3)]
    df = spark.createDataFrame(rows, "file string, chunk int, row_id int, v string").withColumn("wide", F.repeat(F.lit("x"), 10))
    out = N.forward_fill(df, ["v"])
    assert out.columns == df.columns
    assert {r.row_id: r.v for r in out.collect()} == {i: f"{i // 10}0" if v is None else v for _, _, i, v in rows}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan
