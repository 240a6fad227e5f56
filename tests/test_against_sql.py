"""Registered queries against their DuckDB SQL at the smallest scale factor.

All of them run with GRANARY_ALL=1 (some minutes); without it, one or two per module.
"""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
SOME = ["abc_classify", "control_strategy", "forecast_demand", "purchase_plan", "risk_summary", "allocate_shortages", "weekly_rollup", "tune_holt"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def names():
    if not os.environ.get("GRANARY_ALL"):
        return SOME
    # names without a session: the registry is filled at import
    from __spark_entry__ import queries

    return list(queries())


@pytest.mark.parametrize("name", names())
def test_query(spark, name):
    from __spark_entry__ import oracle_sql, queries
    from checks.compare import check, connect

    assert name in queries()
    con = connect(FOLDER)
    result = check(spark, con, FOLDER, name)
    assert result == "" or name not in oracle_sql(), result


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
