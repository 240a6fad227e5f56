"""Order-dependent results without putting all rows into one task.

A window without ``partitionBy`` moves everything to a single task. Here the order key is cut into slices at bounds from a
sketch: each slice adds up on its own, and the totals of the earlier slices (one row per slice) are added as an offset.

The sketch keeps the rows with the smallest hashes of their whole order key (k minimum values). Its size is fixed, it merges in
any grouping, and the same rows give the same sketch, so it is a scalar subquery that is evaluated once per action: no sample
by position, no checkpoint, and no job while the plan is built. Because keys are kept whole, ties on the first column are cut
by the next ones, and a value that a third of all rows share fills a third of the slices. Bounds say only where to
cut: any of them give the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from granary.functions.numeric import settle

_SLICE = "__slice"
_KEY = "__key"
_TOTAL = "__offset_total"
_COUNT = "__offset_count"
SKETCH_ROWS = 2048
MOST_SLICES = 200


def sort_key(order: list[tuple[Column, bool]]) -> Column:
    """A struct whose ascending order is the wanted one: (column, descending) pairs, numbers only where descending.

    Nulls come first in an ascending column and last in a descending one, as in Spark.
    """
    fields = []
    for n, (column, descending) in enumerate(order):
        fields += [(column.isNull() if descending else column.isNotNull()).cast("int").alias(f"n{n}"), (-column if descending else column).alias(f"k{n}")]
    return F.struct(*fields)


def _bounds(keyed: DataFrame, slices: int) -> DataFrame:
    """One row: the keys, ascending, at which ``slices`` slices of about the same size begin."""
    smallest = keyed.select(_KEY).orderBy(F.xxhash64(_KEY), _KEY).limit(SKETCH_ROWS)
    kept = smallest.agg(F.array_sort(F.collect_list(_KEY)).alias("kept"))
    at = F.transform(F.sequence(F.lit(1), F.lit(slices)), lambda i: (i * F.size("kept") / slices).cast("int"))
    # as many as there are slices less one; an empty table has none
    inner = F.filter(F.slice(at, 1, slices - 1) if slices > 1 else F.array().cast("array<int>"), lambda i: i < F.size("kept"))
    return kept.select(F.array_distinct(F.transform(inner, lambda i: F.get("kept", i))).alias("bounds"))


def _sliced(keyed: DataFrame, slices: int) -> DataFrame:
    """``keyed`` with the number of the slice of each row."""
    # settled: inside the lambda the key would be built again for every bound it is compared with
    bounded = settle(keyed, {_KEY: F.col(_KEY), "__bounds": _bounds(keyed, slices).scalar()})
    return bounded.withColumn(_SLICE, _up_to("__bounds", F.col(_KEY), slices)).drop("__bounds")


def _up_to(bounds: str, key: Column, most: int) -> Column:
    """How many of at most ``most`` ascending ``bounds`` are not above ``key``, by halving steps."""
    steps = F.array(*[F.lit(1 << n) for n in reversed(range(most.bit_length()))])

    def step(found, n):
        return F.when(F.get(F.col(bounds), found + n - 1) <= key, found + n).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)


def running_total(
    df: DataFrame,
    order: list[tuple[Column, bool]],
    value: str | None = None,
    total_name: str | None = None,
    rank_name: str | None = None,
    grand_name: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add a running sum of ``value`` (and its grand total) and/or a 1-based rank in a total order.

    ``order`` lists (column, descending) and has to be a total order (end it with a key), or ties land in any order.
    """
    spark = df.sparkSession
    slices = max(1, min(slices or int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_SLICES))
    keyed = df.withColumn(_KEY, sort_key(order))
    sliced = _sliced(keyed, slices)
    measures = [F.count(F.lit(1)).alias(_COUNT)]
    if value:
        measures.append(F.sum(value).alias(_TOTAL))
    earlier = W.orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    offsets = sliced.groupBy(_SLICE).agg(*measures)  # at most `slices` rows
    grand = [F.sum(_TOTAL).over(W.partitionBy()).alias(grand_name)] if grand_name else []
    offsets = offsets.select(
        _SLICE,
        *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in offsets.columns[1:]],
        *grand,
    )
    inside = W.partitionBy(_SLICE).orderBy(_KEY)
    result = sliced
    if value:
        result = result.withColumn(total_name, F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    if rank_name:
        result = result.withColumn(rank_name, F.row_number().over(inside))
    result = result.join(F.broadcast(offsets), _SLICE)
    if value:
        result = result.withColumn(total_name, F.col(total_name) + F.col(_TOTAL))
    if rank_name:
        result = result.withColumn(rank_name, (F.col(rank_name) + F.col(_COUNT)).cast("bigint"))
    return result.drop(_SLICE, _KEY, _TOTAL, _COUNT)
