"""The same operators over every item and every column, and the paths that the other modules leave out."""

from __future__ import annotations

import calendar
import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from checks.classify_overview import TURNED
from checks.fixtures import Inputs, item_key
from checks.ledgers import FILE_ITEMS, MONTH, YEAR, _scratch, ledger_rows
from checks.planning_chain import HISTORY, history
from checks.registry import query
from granary.operators import classify as C, ingest as N, kpi as K, overview as O, suppliers as E
from granary.schema import CONTROL_STRATEGY, DEFAULT_STRATEGY
from granary.session import shared_folder
from granary.sources import ledger as L, tables as T

ABC = """SELECT item_code, total_out, total_out / whole AS share, running / whole AS cum_share,
    CASE WHEN running / whole <= 0.7 THEN 'A' WHEN running / whole <= 0.9 THEN 'B' ELSE 'C' END AS abc_class
    FROM (SELECT item_code, out_qty AS total_out, sum(out_qty) OVER () AS whole,
                 sum(out_qty) OVER (ORDER BY out_qty DESC, item_code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM summary)"""
# weekly variability of every item over the whole calendar
XYZ = """SELECT item_code, CASE WHEN std_out / mean_out <= 1.0 THEN 'X' WHEN std_out / mean_out <= 4.0 THEN 'Y' ELSE 'Z' END AS xyz_class FROM stats"""
ITEMS = f"""SELECT item_code, abc_class, xyz_class, abc_class || xyz_class AS combo FROM ({ABC}) JOIN ({XYZ}) USING (item_code)"""


def abc_all(i: Inputs) -> DataFrame:
    return C.abc_classify(i.summary().drop("out_amount"))


def items_all(i: Inputs) -> DataFrame:
    return C.abc_xyz_items(abc_all(i), C.xyz_classify(i.dense_weekly(), 1.0, 4.0).select("item_code", "xyz_class"))


@query("abc_classify_all", f"SELECT item_code, total_out, R(share) AS share, R(cum_share) AS cum_share, abc_class FROM ({ABC})", need="summary", digits=9)
def abc_classify_all(i: Inputs):
    return abc_all(i)


@query("abc_distribution_all", f"SELECT abc_class, count(*) AS items FROM ({ABC}) GROUP BY 1", need="summary")
def abc_distribution_all(i: Inputs):
    return C.abc_distribution(abc_all(i))


@query(
    "abc_classify_amount_all",
    """SELECT item_code, total_out, total_amount, R(share) AS share, R(cum_share) AS cum_share,
    CASE WHEN cum_share <= 0.7 THEN 'A' WHEN cum_share <= 0.9 THEN 'B' ELSE 'C' END AS abc_class
    FROM (SELECT item_code, out_qty AS total_out, CAST(out_amount AS DOUBLE) AS total_amount,
                 CAST(out_amount AS DOUBLE) / CAST(sum(out_amount) OVER () AS DOUBLE) AS share,
                 CAST(sum(out_amount) OVER (ORDER BY out_amount DESC, item_code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
                 / CAST(sum(out_amount) OVER () AS DOUBLE) AS cum_share FROM summary)""",
    need="summary",
    digits=9,
)
def abc_classify_amount_all(i: Inputs):
    return C.abc_classify(i.summary()).withColumn("total_amount", F.col("total_amount").cast("double"))


@query("abc_xyz_matrix_all", f"SELECT combo, count(*) AS items FROM ({ITEMS}) GROUP BY 1", need="summary stats")
def abc_xyz_matrix_all(i: Inputs):
    return C.abc_xyz_matrix(items_all(i))


_FIELDS = "service_level, replenishment, count_frequency, stock_rule, remark"
_ROWS = ", ".join("(" + ", ".join(f"'{x}'" for x in (combo, *fields)) + ")" for combo, fields in CONTROL_STRATEGY.items())
_FILLED = ", ".join(f"coalesce({name}, '{x}') AS {name}" for name, x in zip(_FIELDS.split(", "), DEFAULT_STRATEGY, strict=True))


@query(
    "control_strategy_all",
    f"SELECT m.*, {_FILLED} FROM ({ITEMS}) m LEFT JOIN (VALUES {_ROWS}) t(combo, {_FIELDS}) USING (combo)",
    need="summary stats",
)
def control_strategy_all(i: Inputs):
    return C.control_strategy(items_all(i))


@query("classification_map_all", f"SELECT item_code, combo FROM ({ITEMS})", need="summary stats")
def classification_map_all(i: Inputs):
    return C.classification_map(abc=abc_all(i), xyz=C.xyz_classify(i.dense_weekly(), 1.0, 4.0).select("item_code", "xyz_class"))


# Every seventh item holds a large stock that hardly turns.
HEAVY = TURNED.replace("FROM weekly GROUP BY 1", "FROM (SELECT * REPLACE (week_balance + CASE WHEN CAST(substr(item_code, 2) AS BIGINT) % 7 = 0 THEN 1000000 ELSE 0 END AS week_balance) FROM weekly) GROUP BY 1")


@query("slow_moving_heavy", f"SELECT item_code, R(turnover_weeks) AS turnover_weeks, closing_qty FROM ({HEAVY}) WHERE slow_moving", need="summary weekly")
def slow_moving_heavy(i: Inputs):
    heavy = i.weekly().withColumn("week_balance", F.col("week_balance") + F.when(item_key() % 7 == 0, 1e6).otherwise(0.0))
    return O.slow_moving(O.turnover(i.summary(), heavy)).select("item_code", "turnover_weeks", "closing_qty")


@query("read_demand_array", "SELECT item_code, CAST(demand_qty AS DOUBLE) AS demand_qty FROM demand", need="demand")
def read_demand_array(i: Inputs):
    """JSON files that hold one array each."""

    def array(batches):
        rows = [dict(zip(batch.columns, row, strict=True)) for batch in batches for row in batch.itertuples(index=False, name=None)]
        if rows:
            yield pd.DataFrame({"value": [json.dumps(rows, ensure_ascii=False)]})

    def write(path: str) -> None:
        named = i.demand().withColumnsRenamed({"item_code": "物料编码", "demand_qty": "需求数量"})
        named.repartition(8, "物料编码").mapInPandas(array, "value string").write.text(path + "/demand.json")

    return T.read_demand(i.spark, _scratch(i, "demandarray", write) + "/demand.json")


@query(
    "column_match_report",
    """SELECT unnest(['item_code', 'opening_qty', 'in_qty', 'out_qty', 'closing_qty']) AS field,
    unnest(['物料 编码', '期初库存', '本期入库', NULL, 'stock at end']) AS source, unnest(['exact', 'alias', 'alias', 'missing', 'manual']) AS level, 'partial' AS status,
    unnest([count(item_code), count(opening_qty), count(in_qty), 0, count(closing_qty)]) AS filled FROM summary""",
    need="summary",
)
def column_match_report(i: Inputs):
    named = {"item_code": "物料 编码", "opening_qty": "期初库存", "in_qty": "本期入库", "out_qty": "gone", "closing_qty": "stock at end"}
    renamed, report = N.standardize_columns(i.summary().withColumnsRenamed(named), {"closing_qty": "stock at end"})
    fields = ["item_code", "opening_qty", "in_qty", "closing_qty"]
    counts = renamed.agg(*[F.count(c).alias(c) for c in fields]).unpivot([], fields, "field", "filled")
    return report.join(counts, "field", "left").withColumn("filled", F.coalesce("filled", F.lit(0).cast("long")))


@query(
    "supplier_skipped",
    """SELECT unnest(['delivery', 'quality', 'dependency']) AS dimension, unnest(['skipped', 'skipped', 'available']) AS status,
    unnest(['actual_date', 'qualified_qty', '']) AS missing, count(DISTINCT supplier) AS suppliers FROM deliveries""",
    need="deliveries",
)
def supplier_skipped(i: Inputs):
    rows = E.resolve_supplier_columns(i.deliveries().drop("actual_date", "qualified_qty"))
    return E.supplier_dimensions(rows).crossJoin(rows.agg(F.countDistinct("supplier").alias("suppliers")))  # one row


@query(
    "append_kpis",
    f"""SELECT CAST(run AS INTEGER) AS run, metric, R(value) AS value FROM (
        SELECT run * 4 + q AS run, metric, value * (q + 1) AS value FROM ({HISTORY}), (SELECT unnest([0, 1, 2, 3]) AS q))
    WHERE run > (SELECT max(run * 4 + 3) - 10 FROM ({HISTORY}))""",
    need="lines",
)
def append_kpis(i: Inputs):
    """Runs are appended one after the other; the default keeps the latest ten."""
    path = f"{shared_folder(i.spark).rstrip('/')}/kpis-{uuid.uuid4().hex}"
    yearly = history(i)
    for q in range(4):
        runs = yearly.select((F.col("run") * 4 + q).alias("run"), "metric", (F.col("value") * (q + 1)).alias("value"))
        K.append_kpis(runs, path)
        if q % 2:  # appended again: counts once
            K.append_kpis(runs, path)
    return K.kpi_history(K.read_kpis(i.spark, path))


@query(
    "layout_problems",
    """SELECT unnest(['no column for out_qty', 'no column for closing_qty', 'no daily columns']) AS problem, count(*) AS lines
    FROM (SELECT 1 FROM part UNION ALL SELECT 1 FROM part WHERE p_partkey % 59 = 0)""",
)
def layout_problems(i: Inputs):
    """Files that end before the column of outflow, among whole ones."""

    def titled(batches):
        yield pd.DataFrame({"cells": [["stock", None, None, "8/31", "本月累计"], ["物料分类", "物料编码", "物料名称", "库存", "入库"]]})
        for batch in batches:
            yield batch[["cells"]]

    def write(path: str) -> None:
        rows = ledger_rows(i).withColumn("cells", F.slice("cells", 1, 5)).repartitionByRange(4, "k").sortWithinPartitions("k", "r")
        cut = rows.mapInPandas(titled, "cells array<string>")
        cut.select(*[F.col("cells")[n].alias(f"c{n}") for n in range(5)]).write.csv(path)

    numbered = L.number_rows(L.read_ledgers(i.spark, _scratch(i, "narrow", write)))
    problems = L.layout_problems(L.parse_ledger_layout(numbered, reference_year=YEAR))
    lines = numbered.where("row_no > 1").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return problems.join(lines, "file").groupBy("problem").agg(F.sum("n").alias("lines"))


_CHARSETS = ("utf-8", "gbk", "utf-8-sig", "latin-1")  # by month number
# heads and names of the files: words of the charset, every third name in quotes over two lines
_WORDS = {
    False: (["库存明细", "", "", "", "本月累计", "", ""], ["物料分类", "物料编码", "物料名称", "库存", "入库", "出库", "结存"], "名称", '名称 "A"\n第二行, 大'),
    True: (["stocks", "", "", "", "", "", ""], ["type", "code", "désignation", "stock", "entrée", "sortie", "solde"], "clé", 'clé "A"\ndeuxième ligne, grande'),
}


def _month_files(i: Inputs) -> str:
    """Ledgers of every month of ``lineitem``, in two files each, or more where parts are many, that tasks write: in four charsets, with
    quoted line breaks in names, in a folder with a space, a sharp and Chinese letters."""

    def write(path: str) -> None:
        target = f"{path}/库存 #1"

        def save(key, rows: pd.DataFrame) -> pd.DataFrame:
            import pyarrow.fs as pafs

            year, month, part = map(int, key)
            charset = _CHARSETS[month % 4]
            dates, actions, plain, quoted = _WORDS[charset == "latin-1"]
            days = range(1, calendar.monthrange(year, month)[1] + 1)
            lines = [",".join(dates + [x for d in days for x in (f"{year}-{month:02d}-{d:02d}",) * 3]), ",".join(actions + actions[4:] * len(days))]
            for code, moves in zip(rows.item_code, rows.moves, strict=True):
                by_day = {m["day"]: m for m in moves}
                name = '"' + quoted.replace('"', '""') + '"' if int(code[1:]) % 3 == 0 else plain
                cells = ["x", code, name, "0", "0", "0", "0"]
                for d in days:
                    m = by_day.get(d)
                    cells += ["", "", ""] if m is None else [f"{m['i']:.12g}", f"{m['o']:.12g}", "0"]
                lines.append(",".join(cells))
            fs, name = pafs.FileSystem.from_uri(target_uri(target))
            fs.create_dir(name, recursive=True)
            with fs.open_output_stream(f"{name}/明细 {year}-{month} {uuid.uuid4().hex}.csv.gz", compression="gzip") as out:
                out.write(("\n".join(lines) + "\n").encode(charset))
            return pd.DataFrame({"done": [True]})

        # a task holds one file: some fifth of the parts move in a month
        shares = max(2, -(-i.table("part").count() // (4 * FILE_ITEMS)))
        file = {"year": F.year("date"), "month": F.month("date"), "part": F.pmod(F.xxhash64("item_code"), F.lit(shares))}
        # one shuffle, by file; the groups below it are finer
        lines = i.daily("P").withColumns(file).repartition(*file)
        daily = lines.groupBy(*file, "item_code", F.to_date("date").alias("date")).agg(F.sum("in_qty").alias("i"), F.sum("out_qty").alias("o"))
        moves = daily.groupBy(*file, "item_code").agg(F.collect_list(F.struct(F.dayofmonth("date").alias("day"), "i", "o")).alias("moves"))
        moves.groupBy(*file).applyInPandas(save, "done boolean").count()

    return _scratch(i, "months", write) + "/库存 #1"


def _month_rows(i: Inputs) -> DataFrame:
    """Numbered rows of all months; the parsed rows are a table, as in ``ingest_ledgers``."""
    path = _scratch(i, "month-rows", lambda path: T.write_table(L.read_ledgers(i.spark, _month_files(i), names="*.csv.gz"), path))
    return L.number_rows(i.spark.read.parquet(path))


@query(
    "ledgers_of_any_charset",
    """SELECT 'P' || l_partkey AS item_code, CAST(l_shipdate AS DATE) AS date,
              sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS in_qty, sum(l_quantity) AS out_qty FROM lineitem GROUP BY 1, 2""",
)
def ledgers_of_any_charset(i: Inputs):
    """Every line of ``lineitem`` through ledger files in UTF-8, with and without a byte order mark, GBK and latin-1."""
    numbered = _month_rows(i)
    daily = L.unpivot_daily(numbered, L.parse_ledger_layout(numbered))
    return daily.where("out_qty IS NOT NULL").select("item_code", "date", "in_qty", "out_qty")


@query(
    "quoted_ledger_cells",
    """SELECT DISTINCT 'P' || l_partkey AS item_code, year(l_shipdate) AS year, month(l_shipdate) AS month,
              CASE WHEN month(l_shipdate) % 4 = 3 THEN CASE WHEN l_partkey % 3 = 0 THEN 'clé "A"' || chr(10) || 'deuxième ligne, grande' ELSE 'clé' END
                   ELSE CASE WHEN l_partkey % 3 = 0 THEN '名称 "A"' || chr(10) || '第二行, 大' ELSE '名称' END END AS name FROM lineitem""",
)
def quoted_ledger_cells(i: Inputs):
    """The name cells of all months' ledgers, a third of them quoted over two lines."""
    rows = _month_rows(i).where("row_no > 1")
    at = lambda n: F.regexp_extract("file", r"明细 (\d+)-(\d+) ", n).cast("bigint")
    return rows.select(F.get("cells", F.lit(1)).alias("item_code"), at(1).alias("year"), at(2).alias("month"), F.get("cells", F.lit(2)).alias("name"))


def target_uri(path: str) -> str:
    """A path as pyarrow takes it: a local one without a scheme."""
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path
