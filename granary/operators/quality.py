"""Quality of a table: balance check, outliers, profile and header detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from granary.functions.numeric import filled
from granary.operators.ingest import normal_name
from granary.schema import COLUMN_ALIASES, ITEM, QUANTITIES, SPARSE_SHARE, STANDARD_NAMES, TOLERANCE, Z_SCORE


def check_balance(summary: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows whose closing stock is not opening + in - out; nulls count as zero."""
    expected = filled("opening_qty") + filled("in_qty") - filled("out_qty")
    return (
        summary.withColumn("expected_qty", expected)
        .withColumn("difference", F.abs(F.col("expected_qty") - filled("closing_qty")))
        .filter(F.col("difference") > tolerance)
        .select(
            ITEM, *[filled(c).alias(c) for c in QUANTITIES], "expected_qty", "difference"
        )
    )


def detect_outliers(summary: DataFrame, z: float = Z_SCORE, columns: tuple[str, ...] = QUANTITIES) -> DataFrame:
    """Values more than ``z`` deviations from the mean of their column.

    Columns with fewer than three values or no spread are skipped. The statistics are one row,
    read as a scalar subquery; no window gathers a whole column.
    """
    stats = summary.agg(
        F.struct(
            *[
                F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.count(c).alias("n")).alias(c)
                for c in columns
            ]
        ).alias("stats")
    ).scalar()
    rows = summary.select(ITEM, *columns, stats.alias("stats"))

    def scored(name: str) -> Column:
        s = F.col(f"stats.{name}")
        score = F.when(
            (s["n"] >= 3) & (s["std"] > 0), F.try_divide(F.abs(F.col(name) - s["mean"]), s["std"])
        )
        return F.struct(F.lit(name).alias("column"), F.col(name).alias("value"), score.alias("z_score"))

    return rows.select(ITEM, F.inline(F.array(*[scored(c) for c in columns]))).filter(F.col("z_score") > z)


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: rows, nulls, null share and inferred type of its texts.

    One aggregate over the full table, turned into rows afterwards.
    """
    measures = [F.count(F.lit(1)).alias("rows")]
    for at, name in enumerate(df.columns):
        text = F.col(f"`{name}`").cast("string")
        known = text.isNotNull()
        measures += [
            F.count(text).alias(f"known_{at}"),
            F.count_if(known & text.try_cast("double").isNull()).alias(f"no_number_{at}"),
            F.count_if(known & text.try_cast("date").isNull()).alias(f"no_date_{at}"),
        ]
    counted = df.agg(*measures)

    def described(at: int, name: str) -> Column:
        known = F.col(f"known_{at}")
        kind = (
            F.when(known == 0, "unknown")
            .when(F.col(f"no_number_{at}") == 0, "numeric")
            .when(F.col(f"no_date_{at}") == 0, "date")
            .otherwise("text")
        )
        nulls = F.col("rows") - known
        return F.struct(
            F.lit(name).alias("column"),
            F.lit(at).alias("position"),
            F.col("rows").alias("rows"),
            nulls.alias("nulls"),
            kind.alias("type"),
        )

    rows = counted.select(F.inline(F.array(*[described(i, c) for i, c in enumerate(df.columns)])))
    return rows.withColumn("null_share", F.coalesce(F.try_divide("nulls", "rows"), F.lit(0.0)))


def table_shape(profile: DataFrame) -> DataFrame:
    """One row over ``profile_table``: size, null cells, and sparse (hints at merged cells)."""
    shape = profile.agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.sum("nulls").alias("null_cells")
    )
    return shape.withColumn("sparse", F.col("null_cells") > F.col("rows") * F.col("columns") * SPARSE_SHARE)


def _standard_names() -> dict[str, list[str]]:
    names = {field: [normal_name(source)] for source, field in STANDARD_NAMES.items()}
    for field, aliases in COLUMN_ALIASES.items():
        names[field] += [normal_name(a) for a in aliases]
    return names


def header_scores(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Standard fields named in each row, filled cells and numeric cells of it."""
    tidy = F.transform(
        F.filter(cells, lambda c: c.isNotNull() & (c != "")),
        lambda c: F.lower(F.regexp_replace(c, "[ _]", "")),
    )
    texts = F.filter(cells, lambda c: F.trim(c) != "")
    named = F.lit(0)
    for options in _standard_names().values():
        hit = F.arrays_overlap(F.col("__tidy"), F.array(*[F.lit(o) for o in options]))
        named = named + F.when(hit, 1).otherwise(0)
    return (
        rows.withColumn("__tidy", tidy)
        .withColumn("fields_named", named)
        .withColumn("filled_cells", F.size(texts))
        .withColumn("numeric_cells", F.size(F.filter(texts, lambda c: c.try_cast("double").isNotNull())))
        .drop("__tidy")
    )


def detect_header_rows(rows: DataFrame, first: int = 10) -> DataFrame:
    """Per file: possible header rows among the first ten and whether the header has several.

    ``rows`` has file, row_no (0-based) and cells (array of texts). A row naming at least three
    standard fields is a header; a mostly textual row before a single header makes it a
    multi-row header.
    """
    head = header_scores(rows.filter(F.col("row_no") < first))
    per_file = head.groupBy("file").agg(
        F.array_sort(F.collect_list(F.when(F.col("fields_named") >= 3, F.col("row_no")))).alias("header_rows"),
        F.array_sort(
            F.collect_list(
                F.when(
                    (F.col("filled_cells") > 0) & (F.col("numeric_cells") < F.col("filled_cells") * 0.5),
                    F.col("row_no"),
                )
            )
        ).alias("text_rows"),
    )
    only = F.get("header_rows", F.lit(0))
    titled = F.exists("text_rows", lambda r: r < only)
    return per_file.select(
        "file",
        "header_rows",
        ((F.size("header_rows") > 1) | ((F.size("header_rows") == 1) & titled)).alias("multi_header"),
    )
