"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record with an offset index.

``write_archives`` writes one record per page and each file as a single gzip stream, as many crawlers do.
``normalise`` inflates such a file once, from front to back with bounded memory, writes every record again as a gzip
member of its own and a sidecar ``.idx`` (Parquet) with offset, length, type and id of each record: from then on records are
read singly, and files are split over tasks. ``read_archives`` reads through the sidecars. Archives of other writers may
have any member layout, header names in any case, folded lines, zeros behind a member and empty lines between records. An
archive that is cut inside a member or a record raises, and so does a payload without its digest: no record is lost unseen.

Equal payloads are found by their SHA-256, aggregated before any shuffle of pages. Groups that hold at least a
thousandth of all pages, of which there are at most a thousand, are looked up by broadcast; the others by a join.
Tasks write files with new names and only the manifest, itself a written table, makes them count, so a repeated
attempt leaves nothing in the result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from granary.llm.common import partitions, run_folder, staged, text_column

_BLOCK = 1 << 20
_END = b"\r\n\r\n"
_FILE_BYTES = 64 << 20
_READ_RECORDS = 2048
_HOT = 1000


def with_originals(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", url_col: str = "url", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, original): ``original`` is the largest id among equal payloads of at least ``least_bytes``."""
    chosen = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.encode(text_column(text_col), "UTF-8").alias("payload"))
    chosen = chosen.withColumn("sum", F.sha2("payload", 256))
    groups = chosen.where(F.length("payload") >= least_bytes).groupBy("sum").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    groups = staged(groups.where("n > 1"), "groups")
    total = pages.count()
    hot = groups.where(F.col("n") * _HOT >= total).drop("n")  # at most _HOT rows
    cold = groups.where(F.col("n") * _HOT < total).drop("n")
    looked_up = chosen.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "sum", "left")
    in_hot = looked_up.where("hot").drop("sum", "hot")
    others = looked_up.where("hot IS NULL").drop("hot", "original").join(cold, "sum", "left").drop("sum")
    return in_hot.unionByName(others)


def write_archives(pages: DataFrame, level: int = 4, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of ``with_originals`` as records; the manifest (path, records) of the whole-file gzip archives.

    The page with the id ``original``, or none, is a response with its payload; the others are revisits of it, whose
    HTTP header still has the payload's length. Null ids come before all others. Empty payloads are records as any
    other. Pages that are repeated whole give one record each.
    """
    folder = _uri(run_folder(pages.sparkSession, "warc"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = out = packer = None
        records = size = 0

        def close() -> pd.DataFrame:
            out.write(packer.flush())
            out.close()
            return pd.DataFrame([(path, records)], columns=["path", "records"])

        for batch in batches:
            for page_id, url, payload, original in zip(*(batch[c] for c in ("page_id", "url", "payload", "original")), strict=True):
                if out is None:
                    path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, packer = _create(path), zlib.compressobj(level, zlib.DEFLATED, 31)
                record = _record(page_id, url, payload, original, date)
                out.write(packer.compress(record))
                records, size = records + 1, size + len(record)
                if size >= _FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return staged(pages.mapInPandas(run, "path string, records long"), "manifest")


def normalise(archives: DataFrame, level: int = 4) -> DataFrame:
    """Rewrite gzip archives of any layout; the manifest (path, records) of files with one member per record and a sidecar."""
    folder = _uri(run_folder(archives.sparkSession, "members"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source in batch.path:
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                at = records = 0
                with _create(path) as out, _create(path + ".idx") as file, pq.ParquetWriter(file, _INDEX) as index:
                    lines: list = []
                    for record in split_records(inflate(source)):
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = packer.compress(record) + packer.flush()
                        out.write(member)
                        head = headers(record)
                        lines.append((at, len(member), head["warc-type"], head["warc-record-id"]))
                        at, records = at + len(member), records + 1
                        if len(lines) == _READ_RECORDS:  # a row group is what one reader takes
                            index.write_table(_lines(lines))
                            lines = []
                    if lines:
                        index.write_table(_lines(lines))
                yield pd.DataFrame([(path, records)], columns=["path", "records"])

    spread = archives.select("path").repartition(partitions(archives), "path")
    return staged(spread.mapInPandas(run, "path string, records long"), "normalised")


_INDEX = pa.schema([("at", pa.int64()), ("size", pa.int64()), ("type", pa.string()), ("record_id", pa.string())])


def _lines(rows: list) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)


def read_archives(normalised: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) per record, each read by its place in the index."""
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(_READ_RECORDS).cast("long")))
    parts = normalised.where("records > 0").select("path", "records", begin.alias("begin")).repartition(partitions(normalised), "path", "begin")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch.itertuples():
                fs, name = pafs.FileSystem.from_uri(part.path)
                file = fs.open_input_file(name)
                lines = pq.ParquetFile(fs.open_input_file(name + ".idx")).read_row_group(part.begin // _READ_RECORDS, ["at", "size"]).to_pydict()
                rows = [parse(zlib.decompress(file.read_at(size, at), 31)) for at, size in zip(lines["at"], lines["size"], strict=True)]
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return parts.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def drop_archives(archives: DataFrame) -> None:
    """Delete the files of a manifest of ``write_archives``, once they are normalised."""
    first = archives.select("path").first()
    if first:
        fs, name = pafs.FileSystem.from_uri(first[0].rpartition("/")[0])
        fs.delete_dir(name)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def _create(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(name, compression=None)


def _record(page_id, url, payload: bytes, original, date: str) -> bytes:
    own = None if pd.isna(page_id) else int(page_id)
    revisit = not pd.isna(original) and own != int(original)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{own}')}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if own is not None:
        lines.append(f"X-Page-ID: {own}")
    if url is not None and not pd.isna(url):
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url))
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{int(original)}')}>",
            f"X-Refers-To-Page-ID: {int(original)}",
        ]
    return "\r\n".join(lines).encode() + _END + block + _END


def inflate(path: str) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in blocks of bounded size; a file that ends inside a member raises."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(name, compression=None) as file:
        stream, rest = None, b""
        while rest or (rest := file.read(_BLOCK)):
            if stream is None:
                rest = rest.lstrip(b"\0")  # padding between members
                if not rest:
                    continue
                stream = zlib.decompressobj(31)
            block = stream.decompress(rest, _BLOCK)
            if block:
                yield block
            rest = stream.unconsumed_tail
            if stream.eof:
                stream, rest = None, stream.unused_data
        while stream is not None and (block := stream.decompress(b"", _BLOCK)):
            yield block
            if stream.eof:
                stream = None
    if stream is not None and not stream.eof:
        raise ValueError(f"{path} ends inside a gzip member")


def split_records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream: a header up to the empty line, as many bytes as it says, and the closing empty lines."""
    held, wanted = bytearray(), None
    for block in blocks:
        held += block
        while True:
            if wanted is None:
                while held[:2] == b"\r\n":  # more empty lines than the two that end a record
                    del held[:2]
                end = held.find(_END)
                if end < 0:
                    break
                wanted = end + 4 + int(headers(bytes(held[: end + 4]))["content-length"]) + 4
            if len(held) < wanted:
                break
            yield bytes(held[:wanted])
            del held[:wanted]
            wanted = None
    if held.strip(b"\r\n"):
        raise ValueError(f"{len(held)} bytes after the last whole record")


def headers(record: bytes) -> dict[str, str]:
    """The header fields by name in lower case; a line that begins with white space goes on with the field before it."""
    out: dict[str, str] = {}
    name = None
    for line in record[: record.find(_END)].decode(errors="replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parse(record: bytes) -> tuple:
    """The row of a record: length and digest come from the payload itself, or for a revisit from its headers."""
    head = headers(record)
    block = record[record.find(_END) + 4 : -4]
    cut = block.find(_END)
    page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
    if head["warc-type"] == "response":
        size, digest = len(block) - cut - 4, sha1_base32(block[cut + 4 :])
        if f"sha1:{digest}" != head["warc-payload-digest"]:
            raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
    else:
        size, digest = int(headers(block)["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
    return page and int(page), size, digest, head["warc-type"], refers and int(refers), head.get("warc-target-uri")
