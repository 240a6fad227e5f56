"""Named queries with the DuckDB SQL each result is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from checks.fixtures import Inputs
from granary.session import provide_folder, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6, need: str = ""):
    """Register ``fn(inputs) -> DataFrame`` under ``name``.

    Doubles are rounded the same way on both sides, because sums of doubles depend on the order
    of their terms. ``need`` names the shared CTEs the SQL is built on.
    """

    def keep(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            provide_folder(spark)
            ship(spark)
            return tidy(fn(Inputs(spark, folder)), digits)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_ctes(sql, need, digits)
        return fn

    return keep


def tidy(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded, with infinity as null and no negative zero."""
    limit = F.lit(float("inf"))
    rounded = {}
    for field in df.schema:
        if isinstance(field.dataType, DoubleType):
            value = F.col(f"`{field.name}`")
            rounded[field.name] = F.when(F.abs(value) < limit, F.round(value, digits) + F.lit(0.0))
    return df.withColumns(rounded) if rounded else df


def with_ctes(sql: str, need: str, digits: int) -> str:
    """SQL with its CTEs in front; ``R(x)`` rounds like ``tidy``."""
    from checks.sqlparts import CTES, closure

    parts = [f"{name} AS ({CTES[name]})" for name in closure(need.split())]
    text = ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + sql.strip()
    return expand(text, digits)


def expand(text: str, digits: int) -> str:
    """Replace every R(expr) by a rounded expression."""
    out, at = [], 0
    while True:
        start = _find_macro(text, at)
        if start < 0:
            return "".join(out) + text[at:]
        depth, end = 1, start + 2
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        inner = text[start + 2 : end - 1]
        out.append(text[at:start])
        out.append(f"(CASE WHEN isfinite(CAST({inner} AS DOUBLE)) THEN round(CAST({inner} AS DOUBLE), {digits}) + 0.0 END)")
        at = end


def _find_macro(text: str, at: int) -> int:
    while True:
        start = text.find("R(", at)
        if start < 0 or not (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
            return start
        at = start + 2
