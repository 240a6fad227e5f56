"""What the operators share: table access, staged tables, files of a shared folder, clashing columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from granary.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` that every executor reaches."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: later jobs start from the files.

    A Python worker or a shuffle that is lost later cannot change rows that others have used already.
    """
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_column(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def task_uri(path: str) -> str:
    """``path`` of the shared folder as a URI that pyarrow opens inside a task."""
    return path if "://" in path else "file://" + path.removeprefix("file:")


def written_blocks(df: DataFrame, name: str, block: str, blocks: int) -> str:
    """``df`` written to the shared folder, one sub-folder per value of ``block``; returns the folder for ``read_block``."""
    path = run_folder(df.sparkSession, name)
    df.repartition(max(1, min(blocks, partitions(df))), block).write.partitionBy(block).parquet(path)
    return path


def read_block(path: str, block: str, number: int):
    """Inside a task: one block of ``written_blocks`` as an Arrow table, or None if it has no rows."""
    return read_files(f"{path}/{block}={number}")


def read_files(path: str):
    """Inside a task: the Parquet files of a folder as an Arrow table, or None if there is no such folder."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, name = pafs.FileSystem.from_uri(task_uri(path))
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        return None
    return pq.read_table(name, filesystem=fs, partitioning=None)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pd.DataFrame], column: str, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """The batches cut so that ``column`` has about ``chars`` characters in each piece: long texts do not pile up."""
    for batch in batches:
        if batch.empty:
            continue
        piece = batch[column].str.len().fillna(0).to_numpy().cumsum() // chars
        for _, part in batch.groupby(piece, sort=False):
            yield part


def keep_rows(docs: DataFrame, text_col: str, judge: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows, all columns untouched, whose text ``judge()`` accepts; null is the empty text. ``judge`` runs once per task."""
    import pyarrow as pa

    at = [i for i, c in enumerate(docs.columns) if c.lower() == text_col.lower()][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = judge()
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                yield batch.filter(pa.array(decide([x or "" for x in batch.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
