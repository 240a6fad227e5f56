"""Parquet, demand and master sources; table and report sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType

from granary.operators.ingest import lifecycle_columns
from granary.operators.matching import normalize_demand
from granary.sources.ledger import place
from granary.sources.records import json_elements

_DEMAND_JSON = "array<map<string,string>>"


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet table; ``columns`` narrows the scan where the plan does not already."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_demand(spark: SparkSession, source: str, encoding: str = "gbk", multiline: bool = True) -> DataFrame:
    """(item_code, demand_qty) from a CSV, a JSON array file, or an inline JSON array.

    A JSON array is read in splits like any other text: pieces end at "}", and elements that a split or a brace inside a
    string cuts are put together again. ``multiline=False`` is for JSON lines.
    """
    text = source.strip()
    if text.startswith(("[", "{")):
        return normalize_demand(_columns(spark.range(1).select(F.explode(F.from_json(F.lit(text), _DEMAND_JSON)).alias("entry"))))
    if text.endswith(".json"):
        if not multiline:
            return normalize_demand(spark.read.json(text))
        return normalize_demand(_columns(json_elements(spark.read.text(text, lineSep="}").select("value", *place()))))
    if encoding.lower() not in ("utf-8", "utf8"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return normalize_demand(_numbers(spark.read.csv(text, header=True, encoding=encoding)))


def _columns(rows: DataFrame) -> DataFrame:
    """Maps as columns: one aggregate finds the keys (the columns of the table) and which of them hold numbers only."""
    broken = rows.where("entry IS NULL").count()
    if broken:
        raise ValueError(f"{broken} elements are no flat objects")
    number = F.col("value").isNull() | F.col("value").try_cast("double").isNotNull()
    keys = rows.select(F.explode("entry").alias("key", "value")).groupBy("key").agg(F.bool_and(number).alias("numeric")).orderBy("key").collect()
    cell = lambda k: F.col("entry")[k.key]
    return rows.select(*[(cell(k).try_cast("double") if k.numeric and not _is_code(k.key) else cell(k)).alias(k.key) for k in keys])


def _numbers(df: DataFrame) -> DataFrame:
    """Text columns holding only numbers as doubles, found with one aggregate."""
    checks = [F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast("double").isNotNull()).alias(c) for c in df.columns]
    numeric = df.agg(*checks).first()
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in df.columns if numeric[c] and not _is_code(c)})


def _is_code(name: str) -> bool:
    from granary.schema import DEMAND_ALIASES, ITEM

    return name in DEMAND_ALIASES[ITEM]


def read_material_master(spark: SparkSession, path: str) -> DataFrame:
    """Lifecycle columns per item from CSV or Parquet; unknown columns are ignored."""
    if path.rstrip("/").endswith(".csv"):
        return lifecycle_columns(spark.read.csv(path, header=True))
    return lifecycle_columns(spark.read.parquet(path))


def concat_diagonal(frames: list[DataFrame]) -> DataFrame | None:
    """All rows under the union of the columns; missing columns are null, no frames give None."""
    if not frames:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def save_by_item(df: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """Catalog table bucketed and sorted by item code.

    Every operator groups or joins by item; on such a table these steps need no shuffle, which
    pays off when one weekly table feeds forecast, plan, alerts and classification.
    """
    order = [c for c in ("week_key",) if c in df.columns]
    writer = df.repartition(buckets, "item_code").write.mode("overwrite").bucketBy(buckets, "item_code")
    writer = writer.sortBy("item_code", *order)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def finite(df: DataFrame) -> DataFrame:
    """Infinity and NaN as null, for sinks that cannot hold them."""
    limit = F.lit(float("inf"))
    return df.withColumns(
        {
            f.name: F.when(~F.isnan(f.name) & (F.abs(f.name) < limit), F.col(f.name))
            for f in df.schema
            if isinstance(f.dataType, (DoubleType, FloatType))
        }
    )


def write_report(sections: dict[str, DataFrame], path: str, append: bool = False) -> None:
    """One JSON directory per section. ``append`` keeps the sections already there.

    Without ``append`` a report that exists is an error; with it, only a section of the same
    name is replaced.
    """
    mode = "overwrite" if append else "errorifexists"
    for name, frame in sections.items():
        finite(frame).write.mode(mode).json(f"{path.rstrip('/')}/{name}")


def read_report(spark: SparkSession, path: str, section: str) -> DataFrame:
    return spark.read.json(f"{path.rstrip('/')}/{section}")
