"""Documents as compressed block files in the shared folder, so that later passes read texts without a shuffle."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, functions as F

from granary.llm.common import run_folder, staged, task_uri

BLOCK_BYTES = 4_000_000


def stored(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(no, path, bytes): one row per file of whole documents, about ``block_bytes`` each; a longer document has its own.

    Files have a new name per task attempt and count only if this staged table names them. Null is the empty text.
    """
    folder = task_uri(run_folder(docs.sparkSession, "blocks"))
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    written = staged(chosen.mapInArrow(lambda it: _write(it, folder, block_bytes), "path string, bytes long"), "written")
    return staged(written.select(F.monotonically_increasing_id().alias("no"), "path", "bytes"), "manifest")


def _write(batches, folder: str, block_bytes: int):
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, name = pafs.FileSystem.from_uri(folder)
    fs.create_dir(name, recursive=True)
    for batch in batches:
        sizes = np.array(pc.binary_length(batch.column("text")), np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // block_bytes, prepend=0)).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            if a < b:
                file = f"{uuid.uuid4().hex}.parquet"
                pq.write_table(pa.Table.from_batches([batch.slice(a, b - a)]), f"{name}/{file}", filesystem=fs, compression="zstd")
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{file}"], "bytes": [int(sizes[a:b].sum())]})


def read(path: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Inside a task: the ids (0 where null), which are null, and the texts of a file."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, name = pafs.FileSystem.from_uri(path)
    table = pq.read_table(name, filesystem=fs, partitioning=None)
    return np.array(table["doc_id"].fill_null(0), np.int64), np.array(table["doc_id"].is_null(), bool), table["text"].to_pylist()
