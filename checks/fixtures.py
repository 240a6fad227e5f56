"""Inventory inputs derived by Spark from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from granary.operators.forecast import Calendar, densify
from granary.operators.ingest import dense_balance, running_balance, weekly_rollup

AS_OF = "2001-11-05"


class Inputs:
    """Lazy frames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.kept: dict[str, DataFrame] = {}  # summaries by grain that a query has written once

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def daily(self, grain: str = "PS") -> DataFrame:
        """Outflow and returned quantity per line, once per grain: P parts, S suppliers."""
        codes = {"P": F.concat(F.lit("P"), "l_partkey"), "S": F.concat(F.lit("S"), "l_suppkey")}
        lines = self.table("lineitem")
        code = F.explode(F.array(*[codes[g] for g in grain])) if len(grain) > 1 else codes[grain]
        return lines.select(
            code.alias("item_code"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0).alias("in_qty"),
            F.col("l_quantity").alias("out_qty"),
        )

    def sparse_weekly(self, grain: str = "PS") -> DataFrame:
        return weekly_rollup(self.daily(grain))

    def calendar(self, weeks: int | None = None) -> Calendar:
        """All weeks of the data, or its first ``weeks`` weeks."""
        span = self.table("lineitem").agg(
            F.struct(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
        ).scalar()
        first, last = F.trunc(span["lo"], "week"), F.trunc(span["hi"], "week")
        if weeks:
            last = F.date_add(first, 7 * (weeks - 1))
        return Calendar(first, last)

    def dense_weekly(self, grain: str = "PS", weeks: int | None = None) -> DataFrame:
        """Every item in every week of the calendar."""
        span = self.calendar(weeks)
        return densify(self.sparse_weekly(grain), span.first, span.last)

    def stock_weekly(self, grain: str = "PS") -> DataFrame:
        """The weeks that moved, with the balance after each."""
        return running_balance(self.sparse_weekly(grain), self.summary(grain))

    def weekly(self, grain: str = "PS") -> DataFrame:
        """Dense weekly table with running balance."""
        span = self.calendar()
        return dense_balance(self.sparse_weekly(grain), self.summary(grain), span.first, span.last)

    def bucketed(self) -> DataFrame:
        """Supplier items in weekly, monthly and quarterly buckets, each its own item."""
        frames = None
        for bucket in ("week", "month", "quarter"):
            part = weekly_rollup(self.daily("S").filter("date < date'2001-10-01'"), bucket)
            part = part.withColumn("item_code", F.concat("item_code", F.lit(f"-{bucket}")))
            frames = part if frames is None else frames.unionByName(part)
        return frames

    def summary(self, grain: str = "PS", unbalanced: bool = False) -> DataFrame:
        """One row per item: flows, stock, price, amount."""
        if grain in self.kept and not unbalanced:
            return self.kept[grain]
        lines = self.table("lineitem").withColumn("amount", F.col("l_extendedprice").cast("decimal(18,2)"))
        codes = {"P": F.concat(F.lit("P"), "l_partkey"), "S": F.concat(F.lit("S"), "l_suppkey")}
        code = F.explode(F.array(*[codes[g] for g in grain])) if len(grain) > 1 else codes[grain]
        flows = lines.select(
            code.alias("item_code"),
            F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0).alias("in_qty"),
            F.col("l_quantity").alias("out_qty"),
            "amount",
        )
        flows = flows.groupBy("item_code").agg(
            F.sum("in_qty").alias("in_qty"), F.sum("out_qty").alias("out_qty"), F.sum("amount").alias("out_amount")
        )
        part = self.table("part").select(
            F.concat(F.lit("P"), "p_partkey").alias("item_code"), "p_size", F.col("p_retailprice").alias("unit_price")
        )
        off = F.when(item_key() % 97 == 0, 1.0).otherwise(0.0) if unbalanced else F.lit(0.0)
        return (
            flows.join(part, "item_code", "left")
            .withColumn(
                "opening_qty",
                F.col("out_qty") - F.col("in_qty") + F.coalesce(F.col("p_size").cast("double"), F.lit(100.0)),
            )
            .withColumn("closing_qty", F.col("opening_qty") + F.col("in_qty") - F.col("out_qty") + off)
            .select("item_code", "opening_qty", "in_qty", "out_qty", "closing_qty", "unit_price", "out_amount")
        )

    def master(self, grain: str = "PS") -> DataFrame:
        """Lifecycle and shelf life by item key."""
        items = self.summary(grain).select("item_code")
        key = item_key()
        state = (
            F.when(key % 50 == 0, "launch").when(key % 50 == 1, "phase_out").when(key % 100 == 2, "obsolete")
            .otherwise("active")
        )
        days = F.get(F.array(*[F.lit(d) for d in (180, 270, 365, 540, 730)]), (key % 5).cast("int"))
        return items.select(
            "item_code",
            state.alias("lifecycle"),
            days.alias("shelf_life_days"),
            F.date_sub(F.lit(AS_OF).cast("date"), (key % 700).cast("int")).alias("production_date"),
        )

    def classes(self, grain: str = "PS") -> DataFrame:
        """A combination per item by its key; every eleventh item has none."""
        key = item_key()
        abc = F.substring(F.lit("ABC"), (key % 3 + 1).cast("int"), F.lit(1))
        xyz = F.substring(F.lit("XYZ"), (F.floor(key / 3) % 3 + 1).cast("int"), F.lit(1))
        rows = self.summary(grain).select("item_code", F.concat(abc, xyz).alias("combo"))
        return rows.filter(key % 11 != 0)

    def given_forecasts(self, grain: str = "PS") -> DataFrame:
        """A simple forecast for three of four items."""
        method = F.when(F.col("item_code").startswith("P"), "tsb").otherwise("holt_winters")
        rows = self.summary(grain).filter(item_key() % 4 != 0)
        return rows.select("item_code", (F.col("out_qty") / 300).alias("forecast"), method.alias("method"))

    def deliveries(self) -> DataFrame:
        """One row per line item with planned and actual date and accepted quantity."""
        lines, orders = self.table("lineitem"), self.table("orders")
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        tier = (F.col("l_suppkey") % 3).cast("int")
        return joined.select(
            F.col("l_suppkey").cast("string").alias("supplier"),
            F.concat(F.lit("P"), "l_partkey").alias("item_code"),
            F.date_add(F.col("o_orderdate").cast("date"), tier * 1000).alias("planned_date"),
            F.col("l_shipdate").cast("date").alias("actual_date"),
            (F.col("l_quantity") * (1 - F.col("l_discount") * (1 + tier))).alias("qualified_qty"),
            F.col("l_quantity").alias("delivered_qty"),
            F.col("l_quantity").alias("out_qty"),
            F.col("l_suppkey"),
        )

    def preferred_suppliers(self) -> DataFrame:
        """Supplier of three of four parts: the one with the smallest key."""
        parts = self.table("lineitem").filter("l_partkey % 4 <> 0")
        picked = parts.groupBy(F.concat(F.lit("P"), "l_partkey").alias("item_code")).agg(F.min("l_suppkey").alias("s"))
        return picked.select("item_code", F.col("s").cast("string").alias("supplier"))

    def item_transit(self) -> DataFrame:
        """Own in-transit quantity of every fifth item."""
        rows = self.summary().filter(item_key() % 5 == 0)
        return rows.select("item_code", (item_key() % 10).cast("double").alias("in_transit_qty"))

    def supplier_transit(self) -> DataFrame:
        """In-transit quantity of every third supplier."""
        rows = self.table("supplier").filter("s_suppkey % 3 = 0")
        return rows.select(
            F.col("s_suppkey").cast("string").alias("supplier"),
            (F.col("s_suppkey") % 7 + 1).cast("double").alias("in_transit_qty"),
        )

    def stock(self) -> DataFrame:
        """Part summary with in-transit quantity for every fifth part."""
        transit = F.when(item_key() % 5 == 0, (item_key() % 40).cast("double")).otherwise(0.0)
        return self.summary("P").withColumn("in_transit_qty", transit)

    def demand(self) -> DataFrame:
        """Demand for two of three parts and for five items nobody supplies."""
        part = self.table("part").filter("p_partkey % 3 <> 0").select(
            F.concat(F.lit("P"), "p_partkey").alias("item_code"), (F.col("p_size") * 10.0).alias("demand_qty")
        )
        extra = self.table("nation").filter("n_nationkey between 1 and 5").select(
            F.concat(F.lit("X"), "n_nationkey").alias("item_code"), F.lit(75.0).alias("demand_qty")
        )
        return part.unionByName(extra)


def item_key() -> Column:
    return F.substring("item_code", 2, 20).cast("bigint")
