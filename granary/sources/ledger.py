"""Wide stock ledgers: header-less CSV with two header rows and one column triplet per day.

Rows are kept as (file, chunk, row_id, cells): ``chunk`` is the byte offset of the scan split and
``row_id`` grows inside it, so the order of a file survives any later shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from granary.functions.numeric import settle
from granary.operators.ingest import forward_fill, lenient_double
from granary.schema import ITEM, LEDGER_LABELS, MONTH_TO_DATE, OPENING_LABEL, QUANTITIES, TOTAL_WORDS
from granary.sources.records import cells, whole_records

_UNICODE = ("utf-8", "utf8", "utf-8-sig")


def place() -> tuple[Column, ...]:
    # the reader gives paths as URIs; "+" is no space there
    return (
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def _lines(spark: SparkSession, paths: list[str] | str, names: str = "*.csv") -> DataFrame:
    """Lines of all ``*.csv`` files as they stand there, with their place; the same files for every reader."""
    return spark.read.text(paths, pathGlobFilter=names).select("value", *place())


def _cells(lines: DataFrame, width: int | None) -> DataFrame:
    """Decoded records parsed into arrays of cells, of exactly ``width`` where it is given."""
    text = F.regexp_replace(F.rtrim(F.col("value"), F.lit("\r")), "^\ufeff", "")
    # settled: the filter and each reading of the record would decode it again
    decoded = settle(lines, {"text": text})
    # a blank line is no CSV record, as in Spark's own reader
    kept = decoded.where(F.trim("text") != "")
    return kept.select("file", "chunk", "row_id", cells(F.col("text"), width).alias("cells"))


def read_ledger_csv(
    spark: SparkSession, paths: list[str] | str, encoding: str = "utf-8", width: int | None = None
) -> DataFrame:
    """Ledger rows of all files in one charset; quoted cells may hold line breaks. Rows are cut or filled only where a
    ``width`` is given."""
    lines = whole_records(_lines(spark, paths))
    if encoding not in _UNICODE:
        lines = lines.withColumn("value", _decoded(spark, encoding))
    return _cells(lines, width)


def _decoded(spark: SparkSession, encoding: str) -> Column:
    """Charsets outside Spark's short list, and replacing what cannot be decoded, need settings that are put on the session."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
    return F.decode(F.col("value").cast("binary"), encoding)


def _per_file(spark: SparkSession, lines: DataFrame) -> DataFrame:
    unicode = F.is_valid_utf8("value")
    # what GBK cannot read does not come back as the same bytes
    gbk = F.encode(_decoded(spark, "GBK"), "GBK") == F.col("value").cast("binary")
    per_file = lines.groupBy("file").agg(F.bool_and(unicode).alias("utf8"), F.bool_and(F.when(~unicode, gbk).otherwise(True)).alias("gbk"))
    return per_file.select("file", F.when(F.col("utf8"), "utf-8").when(F.col("gbk"), "gbk").otherwise("latin-1").alias("encoding"))


def probe_encoding(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, encoding): the first of utf-8, gbk and latin-1 that reads every line of the file.

    Lines arrive as raw bytes; those that are no UTF-8 are decoded and encoded again. GB2312 is part of GBK
    and a byte order mark is valid UTF-8, so three answers cover the five candidates.
    """
    return _per_file(spark, _lines(spark, paths))


def read_ledgers(spark: SparkSession, paths: list[str] | str, width: int | None = None, names: str = "*.csv") -> DataFrame:
    """Ledger rows of files in mixed encodings, in one plan: each record is decoded by what its file turned out to be.

    No path goes through the driver, so any name will do, and no job runs while the plan is built. One row per file is
    broadcast, so that no record is shuffled for its charset. Files are those with the ``names``; ``*.csv.gz`` are read as well,
    each by one task.
    """
    lines = _lines(spark, paths, names)
    known = whole_records(lines).join(F.broadcast(_per_file(spark, lines)), "file")
    gbk, latin = _decoded(spark, "GBK"), _decoded(spark, "ISO-8859-1")
    decoded = F.when(F.col("encoding") == "gbk", gbk).when(F.col("encoding") == "latin-1", latin).otherwise(F.col("value"))
    return _cells(known.withColumn("value", decoded), width)


def number_rows(rows: DataFrame) -> DataFrame:
    """Add ``row_no``, the 0-based record of the file, from one count per scan split.

    Where ids of a split have gaps (blank lines, glued records) its rows are counted by a window over the split.
    """
    splits = rows.groupBy("file", "chunk").agg(F.min("row_id").alias("__first"), F.max("row_id").alias("__last"), F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select(
        "file", "chunk", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"), (F.col("__last") - F.col("__first") + 1 != F.col("__n")).alias("__gaps")
    )
    placed = rows.join(F.broadcast(starts), ["file", "chunk"])  # one row per scan split
    even = placed.where("NOT __gaps").withColumn("row_no", F.col("row_id") - F.col("__first") + F.col("__base"))
    nth = F.row_number().over(W.partitionBy("file", "chunk").orderBy("row_id"))
    counted = placed.where("__gaps").withColumn("row_no", (nth - 1 + F.col("__base")).cast("bigint"))
    return even.unionByName(counted).drop("__first", "__base", "__gaps")


def _date_label(cell: Column) -> Column:
    """Struct(text, year, month, day) of a header cell; month and day are null for other labels."""
    text = F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), "\ufeff", ""))
    short = F.when(text.rlike(r"^\d{1,2}/\d{1,2}$"), F.split(text, "/"))
    full = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}( \d{1,2}:\d{2}:\d{2})?$"), text.try_cast("date"))
    return F.struct(
        text.alias("text"),
        F.year(full).alias("year"),
        F.coalesce(F.month(full), F.get(short, F.lit(0)).try_cast("int")).alias("month"),
        F.coalesce(F.dayofmonth(full), F.get(short, F.lit(1)).try_cast("int")).alias("day"),
    )


def parse_ledger_layout(
    numbered: DataFrame, header_row: int = 1, reference_year: int = 2021, labels: dict[str, str] | None = None
) -> DataFrame:
    """One row per file: where its code, opening, month-to-date and daily columns are.

    ``blocks`` lists (day, at) per daily triplet. Labels without a year start in
    ``reference_year``; a month smaller than the one before it means the next year. ``fields``
    gives the position of each standard field (null when the label is missing).
    """
    head = numbered.filter(F.col("row_no") <= header_row).groupBy("file").agg(
        F.max_by("cells", F.when(F.col("row_no") == 0, F.lit(0))).alias("date_row"),
        F.max_by("cells", F.when(F.col("row_no") == header_row, F.lit(0))).alias("action_row"),
    )
    head = head.withColumns(
        {
            "marks": F.transform("date_row", _date_label),
            "action_row": F.transform("action_row", lambda c: F.trim(F.regexp_replace(c, "\ufeff", ""))),
        }
    )
    last = F.size("action_row") - 1
    empty = F.array().cast("array<struct<day:date,at:int>>")
    start = F.struct(
        F.lit(4).alias("next"),
        F.lit(None).cast("int").alias("mtd"),
        F.lit(reference_year).alias("year"),
        F.lit(0).alias("month"),
        empty.alias("blocks"),
    )

    def step(state, i):
        mark = F.get("marks", i)
        open_here = (i >= state["next"]) & (i + 2 <= last)
        is_day = mark["month"].isNotNull() & mark["day"].isNotNull()
        year = F.coalesce(mark["year"], state["year"] + F.when(mark["month"] < state["month"], 1).otherwise(0))
        day = F.try_make_timestamp(
            year, mark["month"], mark["day"], F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")
        ).cast("date")
        block = F.array(F.struct(day.alias("day"), i.alias("at")))
        jump = (i + 3).alias("next")
        return (
            F.when(
                open_here & (mark["text"] == MONTH_TO_DATE),
                F.struct(jump, i.alias("mtd"), state["year"].alias("year"), state["month"].alias("month"), state["blocks"].alias("blocks")),
            )
            .when(
                open_here & is_day,
                F.struct(jump, state["mtd"].alias("mtd"), year.alias("year"), mark["month"].alias("month"), F.concat(state["blocks"], block).alias("blocks")),
            )
            .otherwise(state)
        )

    scanned = F.when(last >= 4, F.aggregate(F.sequence(F.lit(4), F.greatest(last, F.lit(4))), start, step))
    labels = labels or LEDGER_LABELS
    where = {f: F.array_position("action_row", label) for f, label in labels.items()}
    fields = F.struct(*[F.when(at > 0, (at - 1).cast("int")).alias(f) for f, at in where.items()])
    return head.select(
        "file",
        F.when(F.get("action_row", F.lit(3)) == OPENING_LABEL, 3).alias("opening_at"),
        scanned["mtd"].alias("month_to_date_at"),
        F.coalesce(scanned["blocks"], empty).alias("blocks"),
        fields.alias("fields"),
    )


def layout_problems(layouts: DataFrame) -> DataFrame:
    """Standard fields a file does not have, and files without daily columns."""
    missing = [
        F.when(F.col(f"fields.{f}").isNull(), F.concat(F.lit("no column for "), F.lit(f)))
        for f in (ITEM, *QUANTITIES)
    ]
    no_days = F.when(F.size("blocks") == 0, F.lit("no daily columns"))
    return layouts.select("file", F.explode(F.array_compact(F.array(*missing, no_days))).alias("problem"))


def _is_total(keywords: tuple[str, ...], columns: int) -> Column:
    def named(cell: Column) -> Column:
        found = F.lit(False)
        for word in keywords:
            found = found | F.coalesce(F.contains(cell, F.lit(word)), F.lit(False))
        return found

    return F.exists(F.slice("cells", 1, columns), named)


def without_totals(
    numbered: DataFrame, data_row: int = 2, keywords: tuple[str, ...] = TOTAL_WORDS, columns: int = 7
) -> DataFrame:
    """Ledger lines that are no total lines, judged by their first cells.

    This comes before the fills: a total line with an empty code cell would take the code of
    the item above it.
    """
    return numbered.filter((F.col("row_no") < data_row) | ~_is_total(keywords, columns))


def total_lines(
    numbered: DataFrame, data_row: int = 2, keywords: tuple[str, ...] = TOTAL_WORDS, columns: int = 7
) -> DataFrame:
    """The lines ``without_totals`` removes, with file, row and reason."""
    removed = numbered.filter((F.col("row_no") >= data_row) & _is_total(keywords, columns))
    return removed.select("file", "row_no", F.get("cells", F.lit(1)).alias(ITEM), F.lit("total row").alias("reason"))


def _data_rows(numbered: DataFrame, layouts: DataFrame, data_row: int) -> DataFrame:
    """Data rows with their layout, of which there is one per file."""
    return numbered.filter(F.col("row_no") >= data_row).join(F.broadcast(layouts), "file")


def extract_summary(
    numbered: DataFrame, layouts: DataFrame, data_row: int = 2, fill: tuple[str, ...] = (ITEM, *QUANTITIES)
) -> DataFrame:
    """One row per ledger row: code and the four month quantities, with file and row.

    The first column with the label of a field is the field. Cells are filled from the row above
    (columns in ``fill``) before they are read as numbers, so text that is no number stays null.
    Files that miss a field are left out (see ``layout_problems``).
    """
    complete = F.lit(True)
    for field in (ITEM, *QUANTITIES):
        complete = complete & F.col(f"fields.{field}").isNotNull()
    rows = _data_rows(numbered, layouts.filter(complete), data_row)
    rows = rows.select(
        "file", "chunk", "row_id", "row_no",
        *[F.get("cells", F.col(f"fields.{f}")).alias(f) for f in (ITEM, *QUANTITIES)],
    )
    rows = forward_fill(rows, list(fill)) if fill else rows
    return rows.select(
        F.trim(ITEM).alias(ITEM), *[lenient_double(c).alias(c) for c in QUANTITIES], "file", "row_no"
    )


def unpivot_daily(numbered: DataFrame, layouts: DataFrame, data_row: int = 2, code_at: int | None = None) -> DataFrame:
    """Daily triplets as rows (item, date, in_qty, out_qty, balance, file, row_no).

    The code is in the column of the layout, or the second where the layout has none; ``code_at`` overrides both.
    """
    rows = _data_rows(numbered, layouts, data_row)
    at = F.coalesce(F.col(f"fields.{ITEM}"), F.lit(1)) if code_at is None else F.lit(code_at)
    rows = rows.withColumn(ITEM, F.get("cells", at))
    rows = forward_fill(rows, [ITEM])

    def cell(block, shift: int) -> Column:
        return lenient_double(F.get("cells", block["at"] + shift))

    days = F.transform(
        "blocks",
        lambda b: F.struct(
            b["day"].alias("date"),
            cell(b, 0).alias("in_qty"),
            cell(b, 1).alias("out_qty"),
            cell(b, 2).alias("balance"),
        ),
    )
    return rows.select(F.trim(ITEM).alias(ITEM), F.inline(days), "file", "row_no")
