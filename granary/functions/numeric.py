"""Small column helpers: guarded division, literal lookups, missing columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ratio(numerator: Column, denominator: Column, otherwise: Column | float | None = 0.0) -> Column:
    """``numerator / denominator`` where the denominator is positive, else ``otherwise``."""
    return F.when(denominator > 0, F.try_divide(numerator, denominator)).otherwise(
        otherwise if isinstance(otherwise, Column) else F.lit(otherwise).cast("double")
    )


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of ``key`` in a literal map; the tables are constants of a few rows, so no join."""
    pairs = [F.lit(part) for entry in table.items() for part in entry]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def filled(column: str | Column) -> Column:
    """A quantity with null read as zero."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0.0))


def total(column: str | Column) -> Column:
    """Sum that is zero, not null, when every value is null."""
    return F.coalesce(F.sum(column), F.lit(0.0))


def column_or(df: DataFrame, name: str, default, data_type: str) -> Column:
    """``name`` of ``df`` if the schema has it, else a typed constant."""
    return F.col(name) if name in df.columns else F.lit(default).cast(data_type)


def first_match(pairs: list[tuple[Column, object]], otherwise=None) -> Column:
    """First value whose condition holds, as one CASE expression."""
    chain = F
    for condition, value in pairs:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later steps read as plain columns, computed once per row.

    They come out of a one-row generator, which the optimizer does not merge into the
    projections above it. Python functions need this: an argument with nested lambdas is not
    recognised as a call to run in Python.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
