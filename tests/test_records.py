"""CSV records with quoted line breaks over split borders, against Python's own reader."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from granary.sources import ledger as L

ODD = ["", 'plain', '', '"quoted, with comma"', '"two\nlines"', '"a ""word"" in quotes"', '"three\n\nlines, ""x""\n"', 'in"side', '""', '"\n"', '"end""\n,"', '12.5', '"x"y', '" \n, "']


def text(seed, rows):
    rng = random.Random(seed)
    return "".join(",".join([str(i) if i % 7 else "", *rng.choices(ODD, k=rng.randint(1, 5)), "z"]) + rng.choice(["\n", "\n", "\r\n"]) for i in range(rows))


def want(data):
    # universal new lines, as the lines of a text file are read; blank records are none
    return [[None if c == "" else c for c in r] for r in csv.reader(io.StringIO(data.replace("\r\n", "\n"), newline="\n")) if any(c.strip() for c in r)]


@pytest.mark.parametrize(("split", "charset"), [("64", "utf-8"), ("64", "gbk"), ("1000", "utf-8")])
def test_records_across_splits(spark, tmp_path, split, charset):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        files = {f"{i}.csv": text(i, 60).replace("plain", "名称") for i in range(4)}
        for name, data in files.items():
            (tmp_path / name).write_bytes(("﻿" if charset == "utf-8" and name == "1.csv" else "").encode(charset if charset != "gbk" else "utf-8") + data.encode(charset))
        rows = L.number_rows(L.read_ledgers(spark, str(tmp_path))).withColumn("name", F.element_at(F.split("file", "/"), -1)).collect()
        if split == "64":
            assert len({(r["name"], r["chunk"]) for r in rows}) > 40
        for name, data in files.items():
            got = [[None if c == "" else c for c in r["cells"]] for r in sorted((r for r in rows if r["name"] == name), key=lambda r: r["row_no"])]
            assert got == want(data)
            assert sorted(r["row_no"] for r in rows if r["name"] == name) == list(range(len(got)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_quote_that_never_closes_tears_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"1\n2",b\nc,"open,d\ne,f\ng,h\n')
    rows = [r["cells"] for r in L.number_rows(L.read_ledgers(spark, str(tmp_path))).orderBy("row_no").collect()]
    assert rows[0] == ["a", "1\n2", "b"] and rows[2:] == [["e", "f"], ["g", "h"]] and rows[1][0] == "c"


def test_no_job_while_the_plan_is_built(spark, tmp_path):
    (tmp_path / "a.csv").write_text(text(3, 30))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    rows = L.number_rows(L.read_ledgers(spark, str(tmp_path)))
    L.unpivot_daily(rows, L.parse_ledger_layout(rows))
    assert list(tracker.getJobIdsForGroup("plan")) == []
    rows.count()
    assert list(tracker.getJobIdsForGroup("plan")) != []
    spark.sparkContext.setJobGroup("", "")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_are_read_in_splits(spark, tmp_path, indent):
    from granary.sources import tables as T

    odd = ["x", "a } b", '"}" and {', "\\", '\\"}', "new\nline }", "料号{"]
    rows = [{"物料编码": f"{odd[i % len(odd)]}{i}", "需求量": i / 4, "note": odd[(i * 3) % len(odd)], "none": None} for i in range(300)]
    (tmp_path / "d.json").write_text(json.dumps(rows, ensure_ascii=False, indent=indent), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
    try:
        found = T.read_demand(spark, str(tmp_path / "d.json"))
        assert sorted(map(tuple, found.collect())) == sorted((r["物料编码"], r["需求量"]) for r in rows)
        assert spark.read.text(str(tmp_path / "d.json"), lineSep="}").rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        T.read_demand(spark, str(tmp_path / "e.json"))


def test_a_record_is_parsed_once_whatever_its_width(spark):
    import time

    from granary.sources.records import cells

    lines = spark.range(3000).select(F.concat_ws(",", F.array_repeat(F.col("id").cast("string"), 150)).alias("value")).repartition(1).cache()
    cut = {n: {(len(r[0]), r[0].count(None)) for r in lines.select(cells(F.col("value"), n)).limit(20).collect()} for n in (2, 151)}
    assert cut == {2: {(2, 0)}, 151: {(151, 1)}}
    taken = {}
    for width in (None, 150):
        begun = time.time()
        lines.select(cells(F.col("value"), width)).write.format("noop").mode("overwrite").save()
        taken[width] = time.time() - begun
    lines.unpersist()
    # it took 150 times as long while every cell parsed the record again
    assert taken[150] < 15 * taken[None] + 1


def test_records_without_quotes_are_split(spark):
    from granary.sources.records import cells

    rows = spark.createDataFrame([("a,,b,",), ('"x,y",,"",z',), (",",), ("a",), ('a"b,c',)], "value string")
    got = rows.select(cells(F.col("value")).alias("c"))
    assert [r.c for r in got.collect()] == [["a", None, "b", None], ["x,y", None, "", "z"], [None, None], ["a"], ['a"b', "c"]]
    assert "split(value" in got._jdf.queryExecution().optimizedPlan().toString()


def test_ids_of_torn_records_have_no_gaps_in_plain_and_packed_files(spark, tmp_path):
    import gzip

    data = text(11, 60)
    (tmp_path / "a.csv").write_text(data)
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(data.encode()))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        for names, splits in (("*.csv", 3), ("*.csv.gz", 1)):
            found = L.read_ledgers(spark, str(tmp_path), names=names).select("chunk", "row_id", "cells").collect()
            rows = sorted((r.chunk, r.row_id, [None if c == "" else c for c in r.cells]) for r in found)
            assert [c for _, _, c in rows] == want(data)
            ids = {c: [i for at, i, _ in rows if at == c] for c in {at for at, _, _ in rows}}
            assert len(ids) >= splits and all(i == list(range(i[0], i[0] + len(i))) for i in ids.values())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
