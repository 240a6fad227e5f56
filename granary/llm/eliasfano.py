"""Token-id shards with Elias-Fano document boundaries.

A shard file is: magic, the concatenated ids (2 bytes each where the vocabulary allows it, else 4), an Elias-Fano
sequence of the n + 1 document boundaries, another of the document ids (ascending), and a footer with their places.
An Elias-Fano sequence of n values below U keeps the low log2(U / n) bits of each packed, and the high bits in
unary: 2 + log2(U / n) bits a value. Samples of every 256th set bit make ``select`` a short scan, so a reader takes
the offsets of any documents without a table of 64-bit numbers.

Texts are range-partitioned by document id and tokenised where they are written, so only texts are shuffled. Files
get a new name per task attempt and count only if the manifest, itself written as a table, names them.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window as W, functions as F

from granary.llm.chunks import Memory
from granary.llm.common import partitions, run_folder, slices, staged, text_column

_MAGIC = b"IDSHARD1"
_FOOTER = struct.Struct("<QQQQQqBxxxxxxx")  # ids, documents, place of boundaries, place of ids, null ids, least id, id width
_SEQ = struct.Struct("<QQQQQ")  # values, bits below, bytes of low part, of high part, of samples
_SAMPLE = 256
_READ_DOCS = 4096


def pack(values: np.ndarray) -> bytes:
    """The Elias-Fano form of ascending values >= 0."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return _SEQ.pack(0, 0, 0, 0, 0)
    bits = max(0, int(values[-1] // np.uint64(n)).bit_length() - 1)
    shifts = np.arange(bits, dtype=np.uint64)
    low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes() if bits else b""
    places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1, np.uint8)
    high[places] = 1
    high = np.packbits(high, bitorder="little").tobytes()
    samples = places[::_SAMPLE].astype("<u8").tobytes()
    return _SEQ.pack(n, bits, len(low), len(high), len(samples)) + low + high + samples


class Sequence:
    """Reads values of a packed sequence at ``base`` of an open file: only the bytes that the values need."""

    def __init__(self, file, base: int):
        self.file = file
        self.n, self.bits, low, high, samples = _SEQ.unpack(file.read_at(_SEQ.size, base))
        self.low, self.high, self.samples = base + _SEQ.size, base + _SEQ.size + low, base + _SEQ.size + low + high
        self.high_bytes = high

    def select(self, start: int, stop: int) -> np.ndarray:
        """Values ``start`` to ``stop - 1``."""
        count = stop - start
        if count <= 0:
            return np.zeros(0, np.int64)
        first = start // _SAMPLE
        wanted = -(-stop // _SAMPLE) - first + 1
        held = min(wanted, -(-self.n // _SAMPLE) - first)
        marks = np.frombuffer(self.file.read_at(8 * held, self.samples + 8 * first), "<u8").astype(np.int64)
        begin = int(marks[0]) // 8
        end = int(marks[-1]) // 8 + 1 if held == wanted else self.high_bytes
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.file.read_at(end - begin, self.high + begin), np.uint8), bitorder="little")) + 8 * begin
        ones = ones[np.searchsorted(ones, marks[0]) :]
        skip = start - first * _SAMPLE
        upper = ones[skip : skip + count] - np.arange(start, stop)
        if not self.bits:
            return upper
        a, b = start * self.bits, stop * self.bits
        raw = np.unpackbits(np.frombuffer(self.file.read_at(b // 8 + 1 - a // 8, self.low + a // 8), np.uint8), bitorder="little")
        raw = raw[a % 8 : a % 8 + count * self.bits].reshape(count, self.bits).astype(np.int64)
        return (upper << self.bits) + (raw << np.arange(self.bits)).sum(1)


def write_shard(path: str, docs: Iterator[tuple[int | None, bytes]], wide: bool) -> tuple[int, int] | None:
    """Write (document id, ids as unsigned 32-bit bytes) in the given order; the numbers of documents and ids."""
    fs, name = pafs.FileSystem.from_uri(path)
    names, bounds, nulls = [], [0], 0
    kind = "<u4" if wide else "<u2"
    with fs.open_output_stream(name, compression=None) as out:
        out.write(_MAGIC)
        for doc_id, coded in docs:
            out.write(np.frombuffer(coded, "<u4").astype(kind).tobytes())
            bounds.append(bounds[-1] + len(coded) // 4)
            if pd.isna(doc_id):
                nulls += 1
            else:
                names.append(int(doc_id))
        boundaries, least = pack(np.array(bounds)), names[0] if names else 0
        ids = pack(np.array([x - least for x in names], np.uint64))
        at = len(_MAGIC) + bounds[-1] * (4 if wide else 2)
        out.write(boundaries + ids + _FOOTER.pack(bounds[-1], len(bounds) - 1, at, at + len(boundaries), nulls, least, 4 if wide else 2))
    return len(bounds) - 1, bounds[-1]


class Shard:
    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        end = self.file.size()
        self.n_ids, self.n_docs, bounds, ids, self.nulls, self.least, self.width = _FOOTER.unpack(self.file.read_at(_FOOTER.size, end - _FOOTER.size))
        self.bounds, self.names = Sequence(self.file, bounds), Sequence(self.file, ids)

    def read(self, start: int, stop: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, first id's place in the shard, ids) of documents ``start`` to ``stop - 1``."""
        bounds = self.bounds.select(start, stop + 1)
        a, b = max(0, start - self.nulls), max(0, stop - self.nulls)
        names = [None] * (stop - start - (b - a)) + [int(x) + self.least for x in self.names.select(a, b)]
        for name, x, y in zip(names, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            raw = self.file.read_at((y - x) * self.width, len(_MAGIC) + x * self.width)
            yield name, x, np.frombuffer(raw, f"<u{self.width}").astype("<u4")


@lru_cache(1)
def _tokenizer(path: str, special_as_text: bool) -> tuple[Memory, bool]:
    """Per worker: the tokenizer's ids of pieces, and whether ids need 4 bytes.

    A special string has no white space and ends in no punctuation that pieces are cut before, so it stays whole.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text

    # the vocabulary writes every byte of a token as one character
    lengths = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab().items():
        lengths[i] = len(token)

    def encode(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(texts), 256):
            for x in tokenizer.encode_batch_fast(texts[at : at + 256], add_special_tokens=False):
                ids = np.array(x.ids, np.int64)
                yield ids, lengths[ids]

    return Memory(encode, joined=100_000), tokenizer.get_vocab_size() > 65535


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Write all documents as shards in ascending order of id; the manifest (shard, path, docs, ids, first_id).

    Ids are those of the library without special tokens added around a text. A special string inside a text is its own token as
    the library has it by default, or ordinary text with ``special_as_text``.

    ``tokenizer`` is a byte-level BPE file of the tokenizers library, present on every machine; ``end_id`` follows
    every document. Null and empty texts have the end id only. Rows with a null id come first; equal ids are ordered
    by text, so repeated rows stand side by side. An empty table has an empty manifest.
    """
    spark = docs.sparkSession
    folder = run_folder(spark, "shards")
    end = np.array([end_id], "<u4").tobytes()
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    ordered = chosen.repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.withColumn("shard", F.spark_partition_id())
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory, wide = _tokenizer(tokenizer, special_as_text)
        filled = slices(batches, "text", 16_000_000)
        first = next(filled, None)
        if first is None:
            return
        path = f"{folder}/{int(first.shard.iloc[0]):06d}-{uuid.uuid4().hex}.ids"
        fs, name = pafs.FileSystem.from_uri(folder)
        fs.create_dir(name, recursive=True)

        def coded() -> Iterator[tuple[int | None, bytes]]:
            batch = first
            while batch is not None:
                for doc_id, ids in zip(batch.doc_id, memory.batch(batch.text.tolist()), strict=True):
                    yield doc_id, ids + end
                batch = next(filled, None)

        n_docs, n_ids = write_shard(path, coded(), wide or end_id > 65535)
        yield pd.DataFrame([(int(first.shard.iloc[0]), path, n_docs, n_ids)], columns=["shard", "path", "docs", "ids"])

    manifest = staged(ordered.mapInPandas(run, "shard int, path string, docs long, ids long"), "manifest")
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    return manifest.withColumn("first_id", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files: checksums of ids as unsigned 32-bit little endian."""
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(_READ_DOCS).cast("long")))
    parts = manifest.where("docs > 0").select("path", "docs", "first_id", runs.alias("begin"))
    parts = parts.repartition(partitions(manifest), "path", "begin")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch.itertuples():
                shard = Shard(part.path)
                stop = min(part.docs, part.begin + _READ_DOCS)
                rows = [(name, part.first_id + at, len(ids), zlib.crc32(ids.tobytes())) for name, at, ids in shard.read(part.begin, stop)]
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    return parts.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
