"""File names of any kind, lines of any width, numbers of any size, and workers outside the repository."""

import datetime
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import PySparkException

from granary.operators import alerts as J, overview as O, suppliers as E
from granary.sources import ledger as L

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", ["原料库存明细表.csv", "a b.csv", "50%.csv", "x#1.csv", "p+q.csv", "100%25 done.csv"])
def test_any_file_name(spark, tmp_path, name):
    folder = tmp_path / "库存 表#1"
    folder.mkdir()
    (folder / name).write_bytes("物料,数量\n甲,1\n".encode("gbk"))
    rows = L.read_ledgers(spark, str(folder)).collect()
    assert [r["cells"] for r in sorted(rows, key=lambda r: r["row_id"])] == [["物料", "数量"], ["甲", "1"]]
    assert {r["file"].rpartition("/")[2] for r in rows} == {name}


def test_narrow_title_cuts_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title\n"a,1",b,c,d,e,f,g\n1,2,3,4,5,6,7\n')
    (tmp_path / "b.csv").write_text("only\n")
    (tmp_path / "note.txt").write_text("no ledger\n")
    rows = {tuple(x for x in r["cells"] if x is not None) for r in L.read_ledgers(spark, str(tmp_path)).collect()}
    assert rows == {("title",), ("a,1", "b", "c", "d", "e", "f", "g"), tuple("1234567"), ("only",)}
    cut = {len(r["cells"]) for r in L.read_ledgers(spark, str(tmp_path), width=3).collect()}
    assert cut == {3}


def test_cover_beyond_the_calendar(spark):
    rows = [("long", 1e9, 0.0, 1.0), ("longer", 10.0, 0.0, 1e-6), ("week", 1.0, 0.0, 1.0), ("none", 5.0, 0.0, 0.0), ("out", 0.0, 0.0, 1.0)]
    plan = spark.createDataFrame(rows, "item_code string, balance double, in_transit_qty double, mean_out double")
    got = {r["item_code"]: r for r in J.stockout_projection(plan, "2001-01-01", 4).collect()}
    assert [got[i]["projection_note"] for i in ("long", "longer", "week")] == ["beyond the calendar"] * 2 + ["projected"]
    assert got["long"]["stockout_date"] is None and got["longer"]["order_by_date"] is None
    assert got["week"]["stockout_date"] == datetime.date(2001, 1, 8)
    assert got["none"]["stockout_date"] is None and got["out"]["stockout_date"] is None


@pytest.mark.parametrize("kind", ["double", "string", "decimal(38,6)"])
def test_quality_of_any_size(spark, kind):
    rows = [("big", "500000000000000", "1000000000000000"), ("big", "1", "1"), ("small", "0.00001", "0.00002"), ("text", "x", None)]
    df = spark.createDataFrame(rows, "supplier string, qualified_qty string, delivered_qty string")
    if kind != "string":
        df = df.selectExpr("supplier", *[f"try_cast({c} AS {kind}) AS {c}" for c in ("qualified_qty", "delivered_qty")])
    got = {r["supplier"]: r["quality_share"] for r in E.quality_performance(df).collect()}
    assert got["big"] == pytest.approx(0.5) and got["small"] == pytest.approx(0.5) and got["text"] == 0.0


def test_flow_asks_for_an_order(spark):
    schema = "item_code string, opening_qty double, in_qty double, out_qty double, closing_qty double, day int"
    one = spark.createDataFrame([("a", 5.0, 0.0, 0.0, 5.0, 1)], schema)
    assert O.product_flow(one).collect()[0]["flow_state"] == "idle"
    two = one.unionByName(spark.createDataFrame([("a", 1.0, 2.0, 1.0, 2.0, 0)], schema))
    with pytest.raises(PySparkException, match="give an order"):
        O.product_flow(two).collect()
    row = O.product_flow(two, "day").collect()[0]
    assert (row["first_opening"], row["last_closing"]) == (1.0, 5.0)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_workers_find_the_package_elsewhere(tmp_path):
    """The repository is on the driver's path only; workers get the package that the session ships."""
    code = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from granary import build_session
from granary.session import provide_folder
spark = build_session("elsewhere", master="local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
provide_folder(spark)
from __spark_entry__ import queries
for name in ("forecast_demand", "tune_holt"):
    assert queries()[name](spark, "/root/testdata/sf0.001").count() > 0
spark.stop()
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.stdout.strip().endswith("done"), run.stderr[-2000:]
