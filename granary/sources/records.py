"""CSV records whose quoted cells hold line breaks, from files that are read in splits.

A line moves the reader between two states, outside and inside a quoted cell, so it is a function of the state before
it: it keeps it, toggles it, or ends in one state whatever came before. Such functions compose in any grouping. They are
composed per scan split from the few columns of the lines that change the state, then over the splits of a file (one row
per split), and that tells the state at the start of each split. Only splits with a torn record take part in
what follows: their lines get the state before and behind them by a window over the split, and the lines of a torn record are
glued to the line it begins with, wherever that stands: in the same task, but for the one record that may cross each border.
All other lines are not shuffled, and no file is one task. Records of such splits get ids without gaps, so they are numbered
without a second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_OPEN = r'"[^"]*+(?:""[^"]*+)*+'
_FIELDS = r'(?:(?:' + _OPEN + r'"[^,]*+|[^",][^,]*+)?,)*+'
_OPENS = r"^(?:ï»¿|﻿)?" + _FIELDS + _OPEN + r"\z"
_STAYS = r'^[^"]*+(?:""[^"]*+)*+(?:\z|"[^,]*+,' + _FIELDS + _OPEN + r"\z)"
_SPLIT = ["file", "chunk"]


def _odd(n: Column) -> Column:
    return F.pmod(n, F.lit(2)) == 1


def _after(start: Column, n: Column, fixed: Column, n_fixed: Column) -> Column:
    """The state behind ``n`` toggles, where the last function that fixes the state to ``fixed`` came behind ``n_fixed`` of them."""
    return F.when(fixed.isNotNull(), fixed != _odd(n - n_fixed)).otherwise(start != _odd(n))


def _composed(rows: DataFrame, over: W) -> DataFrame:
    """Running toggles ``n``, the last fixed state and the toggles until it, from columns ``opens`` and ``stays``."""
    fixes = F.col("opens") == F.col("stays")
    n = F.sum(F.when(F.col("opens") & ~F.col("stays"), 1).otherwise(0)).over(over)
    rows = rows.withColumn("n", n)
    return rows.withColumns({"fixed": F.last(F.when(fixes, F.col("opens")), True).over(over), "n_fixed": F.last(F.when(fixes, F.col("n")), True).over(over)})


def whole_records(lines: DataFrame) -> DataFrame:
    """(value, file, chunk, row_id): the lines, those of a CSV record with quoted line breaks glued by new lines.

    A quote opens a cell only as its first character; two quotes inside a quoted cell are one. A record stands at the place of its
    first line. A quote that is never closed is an ordinary character: the lines behind it stay as they are. Charsets that
    keep ASCII bytes for ASCII only (UTF-8, GBK, latin-1) are all right, for quotes and commas are found in the bytes.
    """
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    quoted = F.contains("value", F.lit('"'))
    return glued(lines, F.when(quoted, text.rlike(_OPENS)).otherwise(False), F.when(quoted, text.rlike(_STAYS)).otherwise(True), "\n")


def json_elements(pieces: DataFrame) -> DataFrame:
    """(entry map<string,string>): the objects of JSON arrays whose text was read in pieces that end at "}".

    A string may hold a brace; such pieces are glued. An element that holds another object is null.
    """
    unescaped = F.regexp_replace("value", r"(?s)\\.", "")
    odd = _odd(_count(unescaped, '"'))
    whole = glued(pieces, odd, ~odd, "}")
    braces = _count(F.regexp_replace(unescaped, '"[^"]*"', ""), "{")
    element = F.concat(F.substring("value", F.locate("{", F.col("value")), F.length("value")), F.lit("}"))
    return whole.where(braces > 0).select(F.when(braces == 1, F.from_json(element, "map<string,string>")).alias("entry"))


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def glued(lines: DataFrame, opens: Column, stays: Column, glue: str) -> DataFrame:
    """``lines`` with those of one record put together: whether a line leaves a reader inside a quoted cell that was outside
    before (``opens``) or inside (``stays``)."""
    columns = ["value", "file", "chunk", "row_id"]
    marked = lines.select(*columns, opens.alias("opens"), stays.alias("stays"))

    # per split: what its lines do to the state, composed
    inside = W.partitionBy(*_SPLIT).orderBy("row_id")
    running = inside.rowsBetween(W.unboundedPreceding, 0)
    moving = _composed(marked.where("opens OR NOT stays").drop("value"), running)
    ends = moving.groupBy(*_SPLIT).agg(F.max_by(F.struct("n", "fixed", "n_fixed"), "row_id").alias("last"))
    ends = ends.select(*_SPLIT, _after(F.lit(False), F.col("last.n"), F.col("last.fixed"), F.col("last.n_fixed")).alias("opens"), _after(F.lit(True), F.col("last.n"), F.col("last.fixed"), F.col("last.n_fixed")).alias("stays"))
    splits = marked.groupBy(*_SPLIT).agg(F.bool_or("opens").alias("any"))
    splits = splits.join(ends, _SPLIT, "left").withColumns({"opens": F.coalesce("opens", F.lit(False)), "stays": F.coalesce("stays", F.lit(True))})
    # over the splits of a file
    by_file = W.partitionBy("file").orderBy("chunk")
    splits = _composed(splits, by_file.rowsBetween(W.unboundedPreceding, 0))
    splits = splits.withColumn("end", _after(F.lit(False), F.col("n"), F.col("fixed"), F.col("n_fixed")))
    splits = splits.withColumn("start", F.lag("end", 1, False).over(by_file))
    splits = splits.withColumn("closed", ~F.last("end").over(W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    torn = splits.where("start OR any").select(*_SPLIT, "start", "closed")  # one row per scan split at most

    plain = lines.select(*columns).join(F.broadcast(torn.select(*_SPLIT)), _SPLIT, "left_anti").select(*columns)
    some = _states(_composed(marked.join(F.broadcast(torn), _SPLIT), running), inside)
    begins = F.when(~F.col("before"), F.struct("chunk", "row_id"))
    some = some.withColumn("head", F.last(begins, True).over(running))
    # the record that reaches into a split began with the last line that opened one before it
    opened = _states(moving.join(F.broadcast(torn), _SPLIT), inside).where("NOT before AND after")
    opened = opened.groupBy(*_SPLIT).agg(F.max(F.struct("chunk", "row_id")).alias("opened"))
    opened = torn.select(*_SPLIT).join(opened, _SPLIT, "left")
    reach = opened.select(
        *_SPLIT,
        "opened",
        F.last("opened", True).over(by_file.rowsBetween(W.unboundedPreceding, -1)).alias("earlier"),
        F.max("opened").over(W.partitionBy("file")).alias("latest"),
    )
    some = some.join(F.broadcast(reach), _SPLIT).withColumn("head", F.coalesce("head", "earlier"))
    # the last record of a file that never closes stays in lines
    part = (F.col("before") | F.col("after")) & (F.col("closed") | F.coalesce(F.col("head") != F.col("latest"), F.lit(True)))
    some = some.withColumn("part", part)
    # ids of records, without gaps
    first = F.when(~F.col("part") | ~F.col("before"), 1).otherwise(0)
    some = some.withColumn("nth", F.min("row_id").over(running) + F.sum(first).over(running) - 1)
    lone = some.where("NOT part").select("value", *_SPLIT, F.col("nth").alias("row_id"))

    def put(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        lines = F.array_sort(F.collect_list(F.struct(order, "nth", "value"))).alias("lines")
        held = rows.groupBy(*keys).agg(lines, F.first("opened").alias("opened"))
        return held.withColumns({"value": F.concat_ws(glue, F.col("lines.value")), "nth": F.element_at("lines.nth", 1)})

    pieces = put(some.where("part"), [*_SPLIT, "head"], "row_id")
    crosses = (F.col("head.chunk") != F.col("chunk")) | F.coalesce(F.col("head") == F.col("opened"), F.lit(False))
    kept = pieces.where(~crosses).select("value", *_SPLIT, F.col("nth").alias("row_id"))
    crossed = put(pieces.where(crosses), ["file", "head"], "chunk").select("value", "file", F.col("head.chunk").alias("chunk"), F.col("nth").alias("row_id"))
    return plain.unionByName(lone).unionByName(kept).unionByName(crossed)


def _states(rows: DataFrame, inside: W) -> DataFrame:
    """Whether a reader is inside a quoted cell ``before`` and ``after`` each line of a split, from its state at the ``start``."""
    rows = rows.withColumn("after", _after(F.col("start"), F.col("n"), F.col("fixed"), F.col("n_fixed")))
    return rows.withColumn("before", F.coalesce(F.lag("after").over(inside), F.col("start")))


# a comma and the cell behind it: quoted, with anything after the closing quote, or up to the next comma
_CELL = r'(?s),((?:"[^"]*+(?:""[^"]*+)*+"[^,]*+)|[^,]*+)'


def cells(record: Column, width: int | None = None) -> Column:
    """The cells of a record: an empty one is null, an empty quoted one is empty; exactly ``width`` of them if given."""
    # without a quote every comma parts two cells
    quoted = F.contains(record, F.lit('"'))
    raw = F.when(quoted, F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), F.lit(1))).otherwise(F.split(record, ","))

    def plain(cell: Column) -> Column:
        closed = F.regexp_extract(cell, r'(?s)^"([^"]*+(?:""[^"]*+)*+)"', 1)
        behind = F.regexp_extract(cell, r'(?s)^"[^"]*+(?:""[^"]*+)*+"(.*)$', 1)
        inner = F.concat(F.replace(closed, F.lit('""'), F.lit('"')), behind)
        return F.when(cell.startswith('"') & cell.rlike(r'(?s)^"[^"]*+(?:""[^"]*+)*+"'), inner).when(cell != "", cell)

    found = F.transform(raw, plain)
    # cut and filled as a whole: inside a lambda the record would be parsed again for every cell
    return found if width is None else F.slice(F.concat(found, F.array_repeat(F.lit(None).cast("string"), width)), 1, width)
