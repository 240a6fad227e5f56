"""Wide ledger files that Spark writes from the given tables, and the queries that read them."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from checks.fixtures import Inputs, item_key
from checks.registry import query
from granary.operators import ingest as N, quality as Q
from granary.session import shared_folder
from granary.sources import ledger as L, tables as T

YEAR, MONTH, DAYS = 2001, 9, 30
WIDTH = 7 + 3 * DAYS
FILE_ITEMS = 50_000  # a file of some 17 MB, filled and sorted by one task
_WRITTEN: dict[tuple[str, str, str], str] = {}


def _scratch(i: Inputs, kind: str, write) -> str:
    """A folder written once per session and scale factor."""
    key = (i.spark.sparkContext.applicationId, i.folder, kind)
    if key not in _WRITTEN:
        path = f"{shared_folder(i.spark).rstrip('/')}/granary-{kind}-{uuid.uuid4().hex}"
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def ledger_rows(i: Inputs) -> DataFrame:
    """(k, r, cells): one ledger line per part, and for every 59th part a second line that
    leaves its code and closing stock to the line above. Every 41st opening is no number."""
    day = F.dayofmonth("date")
    month = i.daily("P").filter((F.year("date") == YEAR) & (F.month("date") == MONTH))
    moves = month.groupBy("item_code", day.alias("day")).agg(F.sum("in_qty").alias("i"), F.sum("out_qty").alias("o"))
    moves = moves.groupBy("item_code").agg(
        F.map_from_entries(F.collect_list(F.struct("day", F.struct("i", "o")))).alias("moves")
    )
    part = i.table("part").select(
        F.concat(F.lit("P"), "p_partkey").alias("item_code"), F.col("p_partkey").alias("k"), "p_size", "p_brand"
    )
    items = part.join(moves, "item_code", "left").withColumn("opening", F.col("p_size") + 1000.0)

    def flow(d, name):
        return F.coalesce(F.element_at("moves", d)[name], F.lit(0.0))

    days = F.sequence(F.lit(1), F.lit(DAYS))
    flows = F.transform(days, lambda d: F.struct(flow(d, "i").alias("i"), flow(d, "o").alias("o")))
    items = items.withColumn("flows", flows)

    # opening stock and the stock after each day, in one pass
    stock = F.aggregate(
        "flows", F.array("opening"), lambda acc, f: F.concat(acc, F.array(F.element_at(acc, -1) + f["i"] - f["o"]))
    )

    def text(value):
        return value.cast("int").cast("string")

    total = lambda name: F.aggregate("flows", F.lit(0.0), lambda acc, f: acc + f[name])
    triplets = F.flatten(
        F.zip_with("flows", F.slice(stock, 2, DAYS), lambda f, left: F.array(text(f["i"]), text(f["o"]), text(left)))
    )
    head = F.array(
        F.col("p_brand"),
        F.col("item_code"),
        F.lit("part"),
        F.when(F.col("k") % 41 == 0, "n/a").otherwise(text(F.col("opening"))),
        text(total("i")),
        text(total("o")),
        text(F.col("opening") + total("i") - total("o")),
    )
    first = items.select("k", F.lit(1).alias("r"), F.concat(head, triplets).alias("cells"))
    blank = F.lit(None).cast("string")
    second_head = F.array(F.col("p_brand"), blank, F.lit("part"), F.lit("7"), F.lit("1"), F.lit("2"), blank)
    second_days = F.flatten(
        F.transform(
            days,
            lambda d: F.array(
                F.when(d == 1, "1").otherwise("0"), F.when(d == 1, "2").otherwise("0"), F.lit("5")
            ),
        )
    )
    second = items.filter("k % 59 = 0").select("k", F.lit(2).alias("r"), F.concat(second_head, second_days).alias("cells"))
    return first.unionByName(second)


def _with_header(batches):
    labels = [f"{MONTH}/{d}" for d in range(1, DAYS + 1)]
    dates = ["stock", None, None, "8/31", "本月累计", None, None] + [x for label in labels for x in (label, label, label)]
    actions = ["物料分类", "物料编码", "物料名称", "库存", "入库", "出库", "结存"] + ["入库", "出库", "结存"] * DAYS

    def lines(rows):
        return pa.RecordBatch.from_arrays([rows.cast(pa.list_(pa.string()))], ["cells"])

    yield lines(pa.array([dates, actions]))
    for batch in batches:
        yield lines(batch.column("cells"))
    yield lines(pa.array([["合计", "合计", None] + ["0"] * (WIDTH - 3)]))


def ledger_folder(i: Inputs) -> str:
    def write(path: str) -> None:
        files = max(4, -(-i.table("part").count() // FILE_ITEMS))
        parts = ledger_rows(i).repartitionByRange(files, "k").sortWithinPartitions("k", "r")
        lines = parts.mapInArrow(_with_header, "cells array<string>")
        lines.select(*[F.col("cells")[n].alias(f"c{n}") for n in range(WIDTH)]).write.csv(path)

    return _scratch(i, "ledger", write)


def numbered(i: Inputs) -> DataFrame:
    """Numbered ledger rows; the parsed rows are a table, as in ``ingest_ledgers``."""
    path = _scratch(i, "ledger-rows", lambda path: T.write_table(L.read_ledgers(i.spark, ledger_folder(i), width=WIDTH), path))
    return L.number_rows(i.spark.read.parquet(path))


def layouts(i: Inputs) -> DataFrame:
    return L.parse_ledger_layout(numbered(i), reference_year=YEAR)


def raw_summary(i: Inputs) -> DataFrame:
    return L.extract_summary(numbered(i), layouts(i))


def raw_daily(i: Inputs) -> DataFrame:
    return N.exclude_total_rows(L.unpivot_daily(numbered(i), layouts(i)), ["item_code"])


# --- SQL side -------------------------------------------------------------------------
DAY = f"""SELECT k, 1 AS r, 'P' || k AS item_code, DATE '{YEAR}-{MONTH:02d}-01' + CAST(d - 1 AS INTEGER) AS date, in_qty, out_qty,
      p_size + 1000.0::DOUBLE + sum(in_qty - out_qty) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance
    FROM (SELECT p_partkey AS k, p_size, d, coalesce(i, 0) AS in_qty, coalesce(o, 0) AS out_qty
          FROM part CROSS JOIN (SELECT unnest(generate_series(1, {DAYS})) AS d) c
          LEFT JOIN (SELECT l_partkey, day(l_shipdate) AS ld, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS i, sum(l_quantity) AS o
                     FROM lineitem WHERE year(l_shipdate) = {YEAR} AND month(l_shipdate) = {MONTH} GROUP BY 1, 2) m ON l_partkey = p_partkey AND ld = d)
    UNION ALL
    SELECT p_partkey, 2, 'P' || p_partkey, DATE '{YEAR}-{MONTH:02d}-01' + CAST(d - 1 AS INTEGER), CASE WHEN d = 1 THEN 1 ELSE 0 END, CASE WHEN d = 1 THEN 2 ELSE 0 END, 5
    FROM part CROSS JOIN (SELECT unnest(generate_series(1, {DAYS})) AS d) c WHERE p_partkey % 59 = 0"""
SUMMARY = f"""SELECT k, r, 'P' || k AS item_code, CASE WHEN r = 2 THEN 7 WHEN k % 41 = 0 THEN NULL ELSE opening END AS opening_qty, in_qty, out_qty,
      CASE WHEN r = 2 THEN max(closing) OVER (PARTITION BY k) ELSE closing END AS closing_qty
    FROM (SELECT k, r, sum(in_qty) AS in_qty, sum(out_qty) AS out_qty, CASE WHEN r = 1 THEN max(p_size) + 1000.0::DOUBLE END AS opening,
                 CASE WHEN r = 1 THEN arg_max(balance, date) END AS closing
          FROM ({DAY}) x JOIN part ON p_partkey = k GROUP BY k, r)"""
ONE = f"SELECT * FROM ({SUMMARY}) WHERE r = 1"
_QTY = "item_code, opening_qty, in_qty, out_qty, closing_qty"
_COLUMNS = ("item_code", "opening_qty", "in_qty", "out_qty", "closing_qty")


@query(
    "read_ledger_csv",
    f"SELECT p_brand AS category, count(*) + count(*) FILTER (WHERE p_partkey % 59 = 0) AS lines, {WIDTH} AS cells FROM part GROUP BY 1",
)
def read_ledger_csv(i: Inputs):
    rows = L.number_rows(L.read_ledgers(i.spark, ledger_folder(i), width=WIDTH)).filter("row_no >= 2 and cells[0] <> '合计'")
    return rows.groupBy(F.col("cells")[0].alias("category")).agg(
        F.count(F.lit(1)).alias("lines"), F.max(F.size("cells")).alias("cells")
    )


@query("probe_encoding", "SELECT DISTINCT 'utf-8' AS encoding FROM part")
def probe_encoding(i: Inputs):
    return L.probe_encoding(i.spark, ledger_folder(i)).select("encoding").distinct()


@query(
    "ledger_layout",
    f"""SELECT DISTINCT 3 AS opening_at, 4 AS month_to_date_at, {DAYS} AS days, DATE '{YEAR}-{MONTH:02d}-01' AS first_day,
    DATE '{YEAR}-{MONTH:02d}-{DAYS}' AS last_day, 1 AS code_at, 6 AS closing_at FROM part""",
)
def ledger_layout(i: Inputs):
    return (
        layouts(i)
        .select(
            "opening_at",
            "month_to_date_at",
            F.size("blocks").alias("days"),
            F.get("blocks", F.lit(0))["day"].alias("first_day"),
            F.element_at("blocks", -1)["day"].alias("last_day"),
            F.col("fields.item_code").alias("code_at"),
            F.col("fields.closing_qty").alias("closing_at"),
        )
        .distinct()
    )


@query("unpivot_daily", f"SELECT item_code, date, in_qty, out_qty, balance FROM ({DAY})")
def unpivot_daily(i: Inputs):
    return raw_daily(i).drop("file", "row_no")


@query(
    "ledger_files",
    "SELECT CAST(count(*) + count(*) FILTER (WHERE p_partkey % 59 = 0) AS BIGINT) AS lines FROM part",
)
def ledger_files(i: Inputs):
    """Lines of all files of the folder, without the two header rows and the total of each."""
    per_file = numbered(i).groupBy("file").agg((F.max("row_no") - 2).alias("lines"))
    return per_file.agg(F.sum("lines").alias("lines"))


@query("extract_summary", f"SELECT {_QTY} FROM ({SUMMARY})")
def extract_summary(i: Inputs):
    return N.exclude_total_rows(raw_summary(i)).select(*_COLUMNS)


@query(
    "forward_fill",
    f"SELECT item_code, closing_qty, count(*) AS lines FROM ({SUMMARY}) GROUP BY 1, 2",
)
def forward_fill(i: Inputs):
    rows = N.exclude_total_rows(raw_summary(i))
    return rows.groupBy("item_code", "closing_qty").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "numeric_columns",
    f"SELECT count(*) AS lines, count(opening_qty) AS numbers, count(*) - count(opening_qty) AS no_numbers FROM ({SUMMARY})",
)
def numeric_columns(i: Inputs):
    rows = N.exclude_total_rows(raw_summary(i))
    return rows.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("opening_qty").alias("numbers"),
        F.count_if(F.col("opening_qty").isNull()).alias("no_numbers"),
    )


@query("exclude_total_rows", f"SELECT {_QTY} FROM ({SUMMARY}) WHERE item_code NOT LIKE '%99%'")
def exclude_total_rows(i: Inputs):
    rows = N.exclude_total_rows(raw_summary(i), ["item_code"], ("合计", "总计", "小计", "99"))
    return rows.select(*_COLUMNS)


@query(
    "total_lines",
    "SELECT DISTINCT '合计' AS item_code, 'total row' AS reason, count(*) + count(*) FILTER (WHERE p_partkey % 59 = 0) AS kept FROM part",
)
def total_lines(i: Inputs):
    rows = numbered(i)
    kept = L.without_totals(rows).filter("row_no >= 2").agg(F.count(F.lit(1))).scalar()
    return L.total_lines(rows).select("item_code", "reason").distinct().withColumn("kept", kept)


@query("excluded_rows", "SELECT DISTINCT '合计' AS item_code, 'total row' AS reason FROM part")
def excluded_rows(i: Inputs):
    return N.excluded_rows(raw_summary(i)).select("item_code", "reason").distinct()


@query(
    "weekly_rollup",
    f"""SELECT item_code, CAST(isoyear(date) * 100 + weekofyear(date) AS INTEGER) AS week_key, sum(in_qty) AS week_in, sum(out_qty) AS week_out,
    max(last_balance) AS week_balance FROM (SELECT *, CASE WHEN r = 1 AND k % 59 <> 0 THEN last_value(balance) OVER
      (PARTITION BY k, r, isoyear(date) * 100 + weekofyear(date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS last_balance
      FROM ({DAY})) GROUP BY 1, 2""",
)
def weekly_rollup(i: Inputs):
    weekly = N.weekly_rollup(raw_daily(i)).drop("week_start")
    # items with two lines have two balances per day; their last one is not compared
    doubled = item_key() % 59 == 0
    return weekly.withColumn("week_balance", F.when(~doubled, F.col("week_balance")))


@query(
    "weekly_rollup_lines",
    "SELECT item_code, week_start, CAST(isoyear(week_start) * 100 + weekofyear(week_start) AS INTEGER) AS week_key, week_in, week_out FROM sparse",
    need="sparse",
)
def weekly_rollup_lines(i: Inputs):
    return i.sparse_weekly()


@query(
    "weekly_rollup_events",
    """SELECT event_type AS item_code, CAST(isoyear(ts) * 100 + weekofyear(ts) AS INTEGER) AS week_key,
    R(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE)) AS week_out FROM events GROUP BY 1, 2""",
    digits=4,
)
def weekly_rollup_events(i: Inputs):
    daily = i.table("events").select(
        F.col("event_type").alias("item_code"),
        F.col("ts").cast("date").alias("date"),
        F.lit(0.0).alias("in_qty"),
        F.col("value").cast("decimal(18,4)").cast("double").alias("out_qty"),
    )
    return N.weekly_rollup(daily).select("item_code", "week_key", "week_out")


@query(
    "densify",
    """SELECT item_code, count(*) AS weeks, min(week_key) AS first_week, max(week_key) AS last_week, sum(week_in) AS week_in,
    sum(week_out) AS week_out, count(*) FILTER (WHERE week_out = 0) AS empty_weeks FROM dense GROUP BY 1""",
    need="dense",
)
def densify(i: Inputs):
    return i.dense_weekly().groupBy("item_code").agg(
        F.count(F.lit(1)).alias("weeks"),
        F.min("week_key").alias("first_week"),
        F.max("week_key").alias("last_week"),
        F.sum("week_in").alias("week_in"),
        F.sum("week_out").alias("week_out"),
        F.count_if(F.col("week_out") == 0).alias("empty_weeks"),
    )


@query(
    "merge_master",
    "SELECT item_code, closing_qty, lifecycle, CAST(shelf_life_days AS INTEGER) AS shelf_life_days, production_date FROM summary LEFT JOIN (SELECT * FROM master WHERE item_code LIKE 'P%') m USING (item_code)",
    need="summary master",
)
def merge_master(i: Inputs):
    merged = N.merge_master(i.summary(), i.master("P").withColumn("unknown_column", F.lit(1)))
    return merged.select("item_code", "closing_qty", "lifecycle", "shelf_life_days", "production_date")


@query(
    "material_master_csv",
    """SELECT item_code, lifecycle, CAST(shelf_life_days AS INTEGER) AS shelf_life_days, production_date FROM master WHERE item_code LIKE 'P%'""",
    need="master",
)
def material_master_csv(i: Inputs):
    def write(path: str) -> None:
        states = {"launch": "新品上市", "phase_out": "老品下市", "obsolete": "已淘汰", "active": "正常在售"}
        rows = i.master("P").replace(states, subset=["lifecycle"])
        named = {"item_code": "物料编码", "lifecycle": "生命周期状态", "shelf_life_days": "保质期天数", "production_date": "生产日期"}
        rows.withColumnsRenamed(named).write.csv(path + "/master.csv", header=True)

    return T.read_material_master(i.spark, _scratch(i, "master", write) + "/master.csv")


@query(
    "lifecycle_constants",
    "SELECT item_code, 'launch' AS lifecycle, 180 AS shelf_life_days FROM summary",
    need="summary",
)
def lifecycle_constants(i: Inputs):
    rows = N.apply_lifecycle_constants(i.summary(), '{"生命周期状态": "新品上市", "保质期天数": 180}')
    return rows.select("item_code", "lifecycle", "shelf_life_days")


@query(
    "default_lifecycle",
    "SELECT item_code, 'active' AS lifecycle, CAST(NULL AS INTEGER) AS shelf_life_days, CAST(NULL AS DATE) AS launch_date FROM summary",
    need="summary",
)
def default_lifecycle(i: Inputs):
    return N.default_lifecycle(i.summary()).select("item_code", "lifecycle", "shelf_life_days", "launch_date")


@query("dedupe_items", f"SELECT {_QTY} FROM ({ONE})")
def dedupe_items(i: Inputs):
    return N.dedupe_items(N.exclude_total_rows(raw_summary(i))).select(*_COLUMNS)


@query(
    "cross_validate",
    f"""SELECT item_code, check_name, stated, counted, stated - counted AS difference FROM (
      SELECT s.item_code, unnest(['inflow', 'outflow', 'closing']) AS check_name, unnest([s.in_qty, s.out_qty, s.closing_qty]) AS stated,
             unnest([d.in_qty, d.out_qty, s.closing_qty]) AS counted
      FROM ({ONE}) s JOIN (SELECT k, sum(in_qty) AS in_qty, sum(out_qty) AS out_qty FROM ({DAY}) GROUP BY 1) d USING (k))
    WHERE abs(stated - counted) > 0.01""",
)
def cross_validate(i: Inputs):
    """The second line of an item is in the daily table but not in the deduplicated summary."""
    found = N.cross_validate(N.dedupe_items(N.exclude_total_rows(raw_summary(i))), N.weekly_rollup(raw_daily(i)))
    # the closing balance of an item with two lines is not defined (two rows per day)
    return found.filter("check_name <> 'closing' or cast(substring(item_code, 2) as bigint) % 59 <> 0")


@query(
    "week_window",
    """SELECT available_weeks, CAST(13 AS INTEGER) AS expected_weeks, CAST(first_week AS INTEGER) AS first_week, CAST(last_week AS INTEGER) AS last_week,
    first_days AS first_week_days, last_days AS last_week_days, available_weeks < 13 AS too_few_weeks, first_days >= 7 AS first_week_complete, last_days >= 7 AS last_week_complete
    FROM (SELECT count(*) AS available_weeks, min(w) AS first_week, max(w) AS last_week, arg_min(days, w) AS first_days, arg_max(days, w) AS last_days
          FROM (SELECT w, max(days) AS days FROM (SELECT item_code, isoyear(d) * 100 + weekofyear(d) AS w, count(DISTINCT d) AS days FROM lines GROUP BY 1, 2) GROUP BY 1))""",
    need="lines",
)
def week_window(i: Inputs):
    return N.week_window(i.daily())


@query(
    "week_window_ledger",
    f"""SELECT count(DISTINCT weekofyear(date)) AS available_weeks, CAST(min(isoyear(date) * 100 + weekofyear(date)) AS INTEGER) AS first_week,
    count(DISTINCT date) FILTER (WHERE weekofyear(date) = 35) AS first_week_days, true AS too_few_weeks FROM ({DAY})""",
)
def week_window_ledger(i: Inputs):
    return N.week_window(raw_daily(i)).select("available_weeks", "first_week", "first_week_days", "too_few_weeks")


@query(
    "extraction_errors",
    f"""SELECT item_code, 'opening_qty' AS "column", 'not a number' AS reason FROM ({SUMMARY}) WHERE opening_qty IS NULL""",
)
def extraction_errors(i: Inputs):
    return N.extraction_errors(N.exclude_total_rows(raw_summary(i))).select("item_code", "column", "reason")


@query(
    "standardize_columns",
    "SELECT sum(opening_qty) AS opening_qty, sum(in_qty) AS in_qty, sum(out_qty) AS out_qty, sum(closing_qty) AS closing_qty, count(item_code) AS items FROM summary",
    need="summary",
)
def standardize_columns(i: Inputs):
    named = {"item_code": "物料 编码", "opening_qty": "期初库存", "in_qty": "本期入库", "out_qty": "领用数量", "closing_qty": "stock at end"}
    renamed, _ = N.standardize_columns(i.summary().withColumnsRenamed(named), {"closing_qty": "stock at end"})
    return renamed.agg(
        *[F.sum(c).alias(c) for c in ("opening_qty", "in_qty", "out_qty", "closing_qty")], F.count("item_code").alias("items")
    )


# --- quality --------------------------------------------------------------------------
@query(
    "check_balance",
    """SELECT item_code, opening_qty, in_qty, out_qty, closing_qty + 1 AS closing_qty, opening_qty + in_qty - out_qty AS expected_qty, 1.0::DOUBLE AS difference
    FROM summary WHERE k % 97 = 0""",
    need="summary",
)
def check_balance(i: Inputs):
    return Q.check_balance(i.summary(unbalanced=True))


OUTLIERS = """SELECT item_code, "column", value, R(abs(value - m) / s) AS z_score FROM (
    SELECT item_code, unnest(['opening_qty', 'in_qty', 'out_qty', 'closing_qty']) AS "column", unnest([opening_qty, in_qty, out_qty, closing_qty]) AS value FROM summary)
    JOIN (SELECT unnest(['opening_qty', 'in_qty', 'out_qty', 'closing_qty']) AS "column",
                 unnest([avg(opening_qty), avg(in_qty), avg(out_qty), avg(closing_qty)]) AS m,
                 unnest([stddev_samp(opening_qty), stddev_samp(in_qty), stddev_samp(out_qty), stddev_samp(closing_qty)]) AS s FROM summary) USING ("column")
    WHERE abs(value - m) / s > 3"""


@query("detect_outliers", OUTLIERS, need="summary")
def detect_outliers(i: Inputs):
    return Q.detect_outliers(i.summary())


PROFILED = """SELECT 'item_code' AS "column", 0 AS position, count(*) AS rows, 0 AS nulls, 'text' AS type, 0.0::DOUBLE AS null_share FROM summary
    UNION ALL SELECT 'closing_qty', 1, count(*), 0, 'numeric', 0.0 FROM summary
    UNION ALL SELECT 'unit_price', 2, count(*), count(*) - count(unit_price), 'numeric', R((count(*) - count(unit_price)) * 1.0 / count(*)) FROM summary
    UNION ALL SELECT 'production_date', 3, count(*), 0, 'date', 0.0 FROM summary
    UNION ALL SELECT 'nothing', 4, count(*), count(*), 'unknown', 1.0 FROM summary"""


def profiled(i: Inputs) -> DataFrame:
    rows = i.summary().join(i.master().select("item_code", "production_date"), "item_code")
    rows = rows.select("item_code", "closing_qty", "unit_price", "production_date", F.lit(None).cast("string").alias("nothing"))
    return Q.profile_table(rows)


@query("profile_table", PROFILED, need="summary")
def profile_table(i: Inputs):
    return profiled(i)


@query(
    "table_shape",
    """SELECT count(*) AS rows, CAST(5 AS BIGINT) AS columns, CAST(count(*) + count(*) - count(unit_price) AS BIGINT) AS null_cells, true AS sparse FROM summary""",
    need="summary",
)
def table_shape(i: Inputs):
    return Q.table_shape(profiled(i))


@query("detect_header_rows", "SELECT DISTINCT 1 AS header_row, true AS multi_header FROM part")
def detect_header_rows(i: Inputs):
    found = Q.detect_header_rows(numbered(i))
    rows = found.select(F.explode("header_rows").alias("header_row"), "multi_header").distinct()
    return rows.withColumn("header_row", F.col("header_row").cast("int"))


# --- other sources and sinks ----------------------------------------------------------
@query("parquet_scan", "SELECT count(*) AS parts, sum(p_size) AS sizes FROM part")
def parquet_scan(i: Inputs):
    part = T.read_table(i.spark, f"{i.folder}/part.parquet", ["p_partkey", "p_size"])
    return part.agg(F.count("p_partkey").alias("parts"), F.sum("p_size").alias("sizes"))


@query("read_demand_csv", "SELECT item_code, CAST(demand_qty AS DOUBLE) AS demand_qty FROM demand", need="demand")
def read_demand_csv(i: Inputs):
    def write(path: str) -> None:
        i.demand().withColumnsRenamed({"item_code": "物料号", "demand_qty": "需求数量"}).write.csv(
            path, header=True, encoding="UTF-8"
        )

    return T.read_demand(i.spark, _scratch(i, "demand", write), encoding="utf-8")


@query("read_demand_json", "SELECT item_code, CAST(demand_qty AS DOUBLE) AS demand_qty FROM demand", need="demand")
def read_demand_json(i: Inputs):
    def write(path: str) -> None:
        i.demand().withColumnsRenamed({"demand_qty": "demand"}).write.json(path + "/demand.json")

    return T.read_demand(i.spark, _scratch(i, "demandjson", write) + "/demand.json", multiline=False)


@query(
    "concat_diagonal",
    """SELECT item_code, closing_qty, NULL::DOUBLE AS demand_qty FROM summary UNION ALL SELECT item_code, NULL, CAST(demand_qty AS DOUBLE) FROM demand""",
    need="summary demand",
)
def concat_diagonal(i: Inputs):
    return T.concat_diagonal([i.summary().select("item_code", "closing_qty"), i.demand()])


@query(
    "parquet_sink",
    "SELECT item_code, week_key, week_in, week_out, week_balance FROM weekly WHERE week_out > 0",
    need="weekly",
)
def parquet_sink(i: Inputs):
    path = _scratch(i, "weekly", lambda p: T.write_table(i.weekly(), p))
    weekly = T.read_table(i.spark, path, ["item_code", "week_key", "week_in", "week_out", "week_balance"])
    return weekly.filter("week_out > 0")


@query(
    "report_sink",
    """SELECT 'totals' AS section, count(*) AS items FROM (SELECT DISTINCT item_code FROM summary) UNION ALL SELECT 'stock', count(*) FROM summary""",
    need="summary",
)
def report_sink(i: Inputs):
    from granary.operators.overview import inventory_totals, stock_by_item

    def write(path: str) -> None:
        T.write_report({"totals": inventory_totals(i.summary())}, path)
        T.write_report({"stock": stock_by_item(i.summary())}, path, append=True)

    path = _scratch(i, "report", write)
    totals = T.read_report(i.spark, path, "totals").select(F.lit("totals").alias("section"), F.col("unique_items").alias("items"))
    stock = T.read_report(i.spark, path, "stock").agg(F.count("item_code").alias("items"))
    return totals.unionByName(stock.select(F.lit("stock").alias("section"), "items"))
