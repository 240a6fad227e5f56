"""Removal of repeated byte strings over a whole corpus with suffix arrays.

A byte goes if some string of ``length`` bytes over it also starts in a document with a smaller id. So every string needs the
smallest document in which it starts, and equal strings have to meet.

Keys. Of the windows of ``_GRAM`` bytes inside a string the one with the least hash is its key: a function of the string
alone, so equal strings have equal keys. Neighbouring strings mostly share their key; such a run of starts is one
piece, the bytes of all its strings. A key seen in one document only cannot repeat, and its pieces go no further. A key with
more than ``HOT`` different pieces (what stands around a very common passage) is split further by a hash of the whole string.

Suffix arrays. The different pieces of a share of the keys are joined with separators and sorted by two-stage sorting:
only suffixes smaller than their successor are sorted directly; every other suffix is larger than its successor, so a
scan over the buckets of first bytes in ascending order puts it behind what it was induced from. Common prefixes of
neighbours then say which starts share their string, and each such group takes the smallest document of its pieces.
Sorting stops at ``length`` bytes, so the order among equal strings is open, which no result depends on.

Spark. Documents are written once as compressed blocks of bounded size in the shared folder, and what is shuffled are keys
(distinct per block), one bit per key back to its block, distinct pieces, and runs of smallest documents back. Copies
collapse inside a block before anything is sent, so a group of copies that holds a third of all rows sends a piece per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from granary.llm import textblocks
from granary.llm.common import partitions, staged

BUCKET_BYTES = 8_000_000
SORT_BYTES = 4_000_000
HOT = 20_000
LONGEST_RUN = 2048
_GRAM = 20
_SEGMENT = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_KEPT = 5  # bytes of a key that are compared inside its bucket


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, b, np.uint64))) for b in (_BASE, inverse))


def _window(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` neighbours."""
    reach = 1
    while 2 * reach <= width:
        x, reach = np.minimum(x[: len(x) - reach], x[reach:]), 2 * reach
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if reach < width else x


class Block:
    """Documents side by side: their bytes, ids and ends."""

    def __init__(self, path: str):
        self.doc, self.null, texts = textblocks.read(path)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def pieces(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, starts, key): runs of neighbouring starts with one key. Documents without an id have none."""
        found: list = [[], [], []]
        gram = min(_GRAM, length)
        up, down = _powers(_SEGMENT + length)
        first = np.searchsorted(self.ends, np.arange(0, max(1, len(self.data)), _SEGMENT), side="right")
        for at, d in zip(range(0, len(self.data) - length + 1, _SEGMENT), first.tolist(), strict=False):
            data = self.data[at : at + _SEGMENT + length - 1]
            n = len(data) - length + 1
            sums = np.append(np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]))
            key = _window(_mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]), length - gram + 1)
            # starts whose string ends inside their document
            last = np.searchsorted(self.ends, at + n - 1, side="right") + 1
            ends = np.minimum(self.ends[d:last] - at, n)
            sizes = np.diff(ends, prepend=0)
            inside = np.arange(n) + length <= np.repeat(self.ends[d:last] - at, sizes)
            inside &= ~np.repeat(self.null[d:last], sizes)
            new = np.append(True, (key[1:] != key[:-1]) | (inside[1:] != inside[:-1]))
            new[np.append(0, ends[:-1][ends[:-1] < n])] = True
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, n))
            keep = inside[begin]
            begin, size = begin[keep], size[keep]
            long = size > LONGEST_RUN
            if long.any():  # the same cuts for the same run everywhere
                parts = -(-size // LONGEST_RUN)
                offset = LONGEST_RUN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
                begin, size = np.repeat(begin, parts) + offset, np.minimum(np.repeat(size, parts) - offset, LONGEST_RUN)
            for to, x in zip(found, (begin + at, size, key[begin]), strict=True):
                to.append(x)
        return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(found, (np.int64, np.int64, np.uint64), strict=True))

    def document(self, begin: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, begin, side="right")

    def hashes(self, begin: np.ndarray, length: int) -> np.ndarray:
        """A hash of every whole string of ``length`` bytes."""
        out = np.zeros(len(begin), np.uint64)
        if len(begin) and length >= 8:
            words = np.ndarray((len(self.data) - 7,), "<u8", self.data.tobytes(), strides=(1,))
            for o in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
                out = _mix(out * _BASE + words[begin + o])
        else:
            for o in range(length):
                out = _mix(out * _BASE + self.data[begin + o])
        return out


def _truncated(keys: np.ndarray) -> bytes:
    return (keys >> np.uint64(8 * (8 - _KEPT))).view(np.uint8).reshape(-1, 8)[:, :_KEPT].tobytes()


def _keys_of_block(batches: Iterator[pd.DataFrame], length: int, buckets: int) -> Iterator[pd.DataFrame]:
    """(no, bucket, grams, held): per block and bucket the distinct keys, and for each the number of its different pieces
    and whether several documents have it."""
    for batch in batches:
        for row in batch.itertuples():
            block = Block(row.path)
            begin, starts, key = block.pieces(length)
            # a piece is told apart by its ends and size here; HOT needs no exact number
            print_ = _mix(block.hashes(begin, length) ^ _mix(block.hashes(begin + starts - 1, length) + starts.astype(np.uint64)))
            doc = block.doc[block.document(begin)]
            bucket = (key % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((print_, key, bucket))
            key, print_, doc, bucket = key[order], print_[order], doc[order], bucket[order]
            if not len(key):
                continue
            new = np.append(True, key[1:] != key[:-1])
            at = np.flatnonzero(new)
            other = np.append(True, print_[1:] != print_[:-1]) | new
            held = np.minimum(np.add.reduceat(other.astype(np.int64), at), 2**15 - 1)
            several = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
            key, bucket, held = key[at], bucket[at], (held | (several.astype(np.int64) << 15)).astype("<u2")
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
            rows = [(row.no, int(bucket[a]), _truncated(key[a:b]), held[a:b].tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
            yield pd.DataFrame(rows, columns=["no", "bucket", "grams", "held"])


def _shared(pdf: pd.DataFrame, hot: int) -> pd.DataFrame:
    """(no, bucket, marks): for every key of a block two bits, whether several documents have it and whether it is hot."""
    sizes = pdf.held.str.len().to_numpy() // 2
    raw = np.zeros((int(sizes.sum()), 8), np.uint8)
    raw[:, :_KEPT] = np.frombuffer(b"".join(pdf.grams), np.uint8).reshape(-1, _KEPT)
    grams = raw.view("<u8")[:, 0]
    held = np.frombuffer(b"".join(pdf.held), "<u2").astype(np.int64)
    _, group, blocks = np.unique(grams, return_inverse=True, return_counts=True)
    shared = (blocks > 1) | (np.bincount(group, held >> 15) > 0)
    marks = (shared + 2 * (np.bincount(group, held & (2**15 - 1)) > hot)).astype(np.uint8)[group]
    cuts = np.cumsum(sizes).tolist()
    return pd.DataFrame({"no": pdf.no, "bucket": pdf.bucket, "marks": [marks[a:b].tobytes() for a, b in zip([0, *cuts], cuts, strict=False)]})


class Repeats:
    """The pieces of a block that may repeat: where they stand, and the distinct ones in the order of their buckets."""

    def __init__(self, block: Block, marks: pd.DataFrame, length: int, buckets: int):
        begin, starts, key = block.pieces(length)
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((key, bucket))
        new = np.append(True, key[order][1:] != key[order][:-1]) if len(order) else np.zeros(0, bool)
        mark = np.empty(len(key), np.uint8)
        mark[order] = np.frombuffer(b"".join(marks.sort_values("bucket").marks), np.uint8)[np.cumsum(new) - 1]
        # strings of hot keys stand alone, under a key of the whole string
        cold, hot = mark == 1, mark == 3
        single = np.repeat(begin[hot], starts[hot]) + np.arange(int(starts[hot].sum())) - np.repeat(np.cumsum(starts[hot]) - starts[hot], starts[hot])
        self.begin = np.concatenate([begin[cold], single])
        key = np.concatenate([key[cold], block.hashes(single, length)])
        starts = np.concatenate([starts[cold], np.ones(len(single), np.int64)])
        self.doc, data = block.doc[block.document(self.begin)], block.data.tobytes()
        numbers: dict[bytes, int] = {}
        piece = np.array([numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(self.begin.tolist(), (self.begin + starts + length - 1).tolist(), strict=True)], np.int64)
        first = np.zeros(len(numbers), np.int64)
        first[piece[::-1]] = np.arange(len(piece))[::-1]
        bucket = (key[first] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        texts = list(numbers)
        self.piece, self.texts = place[piece], [texts[i] for i in order.tolist()]
        self.key, self.starts, self.bucket = key[first][order], starts[first][order], bucket[order]


def _pieces_of_block(manifest: pd.DataFrame, marks: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    """(no, bucket, keys, sizes, least, data): the distinct pieces of a block that may repeat, with the least document of each."""
    columns = ["no", "bucket", "keys", "sizes", "least", "data"]
    if manifest.empty or marks.empty:
        return pd.DataFrame([], columns=columns)
    found, no = Repeats(Block(manifest.path.iloc[0]), marks, length, buckets), int(manifest.no.iloc[0])
    least = np.full(len(found.texts), np.iinfo(np.int64).max)
    np.minimum.at(least, found.piece, found.doc)
    cut = [0, *(np.flatnonzero(np.diff(found.bucket)) + 1).tolist(), len(found.bucket)]
    rows = [
        (no, int(found.bucket[a]), found.key[a:b].tobytes(), found.starts[a:b].astype("<u2").tobytes(), least[a:b].tobytes(), _packed(b"".join(found.texts[a:b])))
        for a, b in zip(cut, cut[1:], strict=False)
        if a < b
    ]
    return pd.DataFrame(rows, columns=columns)


def _packed(data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(data)


def _unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(data)


def _ahead(data: bytes, at: np.ndarray, offset: int) -> np.ndarray:
    """The 8 bytes from ``offset`` behind each place as one number in the order of the bytes."""
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    return words[np.minimum(at + offset, len(words) - 1)].astype(np.uint64)


def suffix_order(data: np.ndarray, separators: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``data`` sorted by their first ``depth`` bytes or up to the next separator; one ends the data.

    Two-stage sorting: suffixes smaller than their successor are sorted directly, the others are induced.
    """
    text = data.astype(np.uint16) + 1
    text[separators] = 0
    step = np.sign(np.diff(text.astype(np.int32), append=0))
    # equal neighbours have the type of the next change
    change = np.where(step != 0, np.arange(len(text)), len(text) - 1)
    step = step[np.minimum.accumulate(change[::-1])[::-1]]
    at = np.flatnonzero((step > 0) & (text > 0))
    padded = np.where(text > 0, data, 0).astype(np.uint8).tobytes() + bytes(depth + 8)
    direct = _sorted(padded, at, depth)

    heads = np.bincount(text[direct], minlength=257)
    begins = np.concatenate([[0], np.cumsum(heads)])
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        parts = [separators] if c == 0 else induced[c]
        last = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        parts = [last]
        while c and len(last):  # runs of one byte: each induces the suffix before it
            last = last[last > 0] - 1
            last = last[text[last] == c]
            parts.append(last)
        whole = np.concatenate([*parts, direct[begins[c] : begins[c + 1]]])
        induced[c] = []
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        byte = text[before]
        before, byte = before[byte > c], byte[byte > c]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cut = [0, *(np.flatnonzero(byte[1:] != byte[:-1]) + 1).tolist(), len(byte)]
        for a, b in zip(cut, cut[1:], strict=False):
            if a < b:
                induced[byte[a]].append(before[a:b])
    return np.concatenate(out)


def _sorted(data: bytes, at: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by their next ``depth`` bytes; those that tie are sorted again by the bytes that follow."""
    open_, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    at = at.copy()
    if not len(at):
        return at
    for offset in range(0, depth, 8):
        key = _ahead(data, at[open_], offset)
        order = np.lexsort((key, group)) if offset else np.argsort(key, kind="stable")
        at[open_], key = at[open_][order], key[order]
        new = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        tied = ~(new & np.append(new[1:], True))
        group = np.cumsum(new)[tied]
        open_ = open_[tied]
        if not len(open_):
            break
    return at


def common_prefixes(data: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """How many of the next ``depth`` bytes each place shares with the place before it in ``order``; the first 0."""
    lcp = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for offset in range(0, depth, 8):
        differ = _ahead(data, order[open_], offset) ^ _ahead(data, order[open_ - 1], offset)
        lcp[open_] = offset + 8 - np.searchsorted(np.array([1 << (8 * i) for i in range(8)], np.uint64), differ, side="right")
        open_ = open_[differ == 0]
    return np.minimum(lcp, depth)


def first_documents(texts: list[bytes], starts: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For the first ``starts`` places of every text, one after the other: the least document over all texts of equal strings."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    joined = b"\0".join([*texts, b""])
    data = np.frombuffer(joined, np.uint8)
    order = suffix_order(data, begin + sizes, length)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = order - begin[owner[order]]
    is_start = offset < starts[owner[order]]
    order, offset = order[is_start], offset[is_start]
    piece = owner[order]
    group = np.flatnonzero(common_prefixes(joined + bytes(length + 8), order, length) < length)
    lowest = np.minimum.reduceat(least[piece], group)
    out = np.empty(len(order), np.int64)
    out[(np.cumsum(starts) - starts)[piece] + offset] = np.repeat(lowest, np.diff(np.append(group, len(order))))
    return out


def _firsts_of_bucket(pdf: pd.DataFrame, length: int, sort_bytes: int) -> pd.DataFrame:
    """(no, bucket, marks, change, value, many): per block the smallest documents of its pieces' strings, as runs of one value."""
    key = np.frombuffer(b"".join(pdf["keys"]), np.uint64)
    starts = np.frombuffer(b"".join(pdf["sizes"]), "<u2").astype(np.int64)
    least = np.frombuffer(b"".join(pdf["least"]), np.int64)
    data, size = b"".join(map(_unpacked, pdf["data"])), starts + length - 1
    ends = np.cumsum(size)
    numbers: dict[bytes, int] = {}
    piece = np.array([numbers.setdefault(data[a:b], len(numbers)) for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)], np.int64)
    lowest = np.full(len(numbers), np.iinfo(np.int64).max)
    np.minimum.at(lowest, piece, least)
    own = np.empty(len(numbers), np.int64)
    own[piece] = np.arange(len(piece))
    texts, key, count = list(numbers), key[own], starts[own]
    # different keys have no string in common: sorted in parts of whole keys
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    total = np.cumsum(size[own][order]) - size[own][order]
    part = (total[np.flatnonzero(new)] // sort_bytes)[np.cumsum(new) - 1]
    cut = np.append(np.flatnonzero(np.append(True, np.diff(part) != 0)), len(order)).tolist()
    found = np.empty(int(count.sum()), np.int64)
    base = np.cumsum(count) - count
    for a, b in zip(cut, cut[1:], strict=False):
        chosen = order[a:b]
        firsts = first_documents([texts[i] for i in chosen.tolist()], count[chosen], lowest[chosen], length)
        shift = np.cumsum(count[chosen]) - count[chosen]
        found[np.repeat(base[chosen] - shift, count[chosen]) + np.arange(len(firsts))] = firsts
    rows, at = [], 0
    for no, bucket, n in zip(pdf.no, pdf.bucket, pdf["sizes"].str.len() // 2, strict=True):
        own, many = piece[at : at + n], starts[at : at + n]
        values = found[np.repeat(base[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        change = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        rows.append((no, bucket, None, _packed(change.astype("<i4").tobytes()), _packed(values[change].tobytes()), int(many.sum())))
        at += n
    return pd.DataFrame(rows, columns=["no", "bucket", "marks", "change", "value", "many"])


_ROWS = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"


def _documents_of_block(manifest: pd.DataFrame, found: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    """The documents of a block with their removed spans and the bytes that are left."""
    if manifest.empty:
        return pd.DataFrame([], columns=["doc_id", "n_bytes", "starts", "ends", "kept"])
    block = Block(manifest.path.iloc[0])
    n = len(block.data)
    gone = np.zeros(n, bool)
    sent = found[found.change.notna()]
    if len(sent):
        pieces = Repeats(block, found[found.marks.notna()], length, buckets)
        begin, piece, doc, starts = pieces.begin, pieces.piece, pieces.doc, pieces.starts
        parts = []
        for row in sent.sort_values("bucket").itertuples():
            change = np.frombuffer(_unpacked(row.change), "<i4")
            parts.append(np.repeat(np.frombuffer(_unpacked(row.value), np.int64), np.diff(np.append(change, int(row.many)))))
        first = np.concatenate(parts)
        base, many = np.cumsum(starts) - starts, starts[piece]
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        earlier = first[np.repeat(base[piece], many) + inner] < np.repeat(doc, many)
        place = (np.repeat(begin, many) + inner)[earlier]
        depth = np.bincount(place, minlength=n + 1) - np.bincount(place + length, minlength=n + 1)
        gone = np.cumsum(depth[:n]) > 0
    begins = np.append(0, block.ends[:-1]) if len(block.ends) else block.ends
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    edge[block.ends] = True
    on = np.flatnonzero(gone & np.append(True, ~gone[:-1] | edge[1:n])) if n else np.zeros(0, np.int64)
    off = np.flatnonzero(gone & np.append(~gone[1:] | edge[1:n], True)) + 1 if n else on
    owner = block.document(on)
    split = np.searchsorted(owner, np.arange(len(block.doc) + 1))
    kept = block.data[~gone].tobytes()
    cuts = np.concatenate([[0], np.cumsum(~gone)])[np.append(0, block.ends)].tolist()
    on, off = on - begins[owner], off - begins[owner]
    return pd.DataFrame(
        {
            "doc_id": pd.Series(block.doc, dtype="Int64").mask(block.null),
            "n_bytes": block.ends - begins,
            "starts": [on[a:b] for a, b in zip(split, split[1:], strict=False)],
            "ends": [off[a:b] for a, b in zip(split, split[1:], strict=False)],
            "kept": [kept[a:b] for a, b in zip(cuts, cuts[1:], strict=False)],
        }
    )


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, bucket_bytes: int = BUCKET_BYTES, block_bytes: int = textblocks.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept) per row: the removed spans of the UTF-8 text, and what is left of it.

    A byte is removed if a string of ``length`` bytes that covers it also starts in a row with a smaller id, judged on the
    whole input. Null is the empty text; texts shorter than ``length`` stay whole, and texts of any length are read whole. Rows
    with equal ids are no smaller than each other, so repeated rows fare alike. A row with a null id is compared with nothing and
    stays. An empty table has no rows. A character of which bytes go is cut, so ``kept`` is binary.
    """
    spark = docs.sparkSession
    manifest = textblocks.stored(docs, id_col, text_col, block_bytes)
    blocks, total = manifest.select(F.count(F.lit(1)), F.sum("bytes")).first()
    if not blocks:
        return spark.createDataFrame([], _ROWS)
    buckets = max(1, -(-total // bucket_bytes))
    # explicit numbers: the shuffled rows are small, the work behind them is not
    by_block, by_bucket = min(blocks, 4 * partitions(docs)), min(4 * buckets, 4 * partitions(docs))
    spread = manifest.repartition(by_block, "no")

    keys = spread.mapInPandas(lambda it: _keys_of_block(it, length, buckets), "no long, bucket int, grams binary, held binary")
    marks = keys.repartition(by_bucket, "bucket").groupBy("bucket").applyInPandas(lambda pdf: _shared(pdf, hot), "no long, bucket int, marks binary")
    marks = staged(marks, "marks")
    known = marks.repartition(by_block, "no").groupBy("no")
    pieces = spread.groupBy("no").cogroup(known).applyInPandas(
        lambda a, b: _pieces_of_block(a, b, length, buckets), "no long, bucket int, keys binary, sizes binary, least binary, data binary"
    )
    firsts = pieces.repartition(by_bucket, "bucket").groupBy("bucket").applyInPandas(
        lambda pdf: _firsts_of_bucket(pdf, length, SORT_BYTES), "no long, bucket int, marks binary, change binary, value binary, many long"
    )
    both = staged(firsts, "firsts").unionByName(marks, allowMissingColumns=True).repartition(by_block, "no")
    return spread.groupBy("no").cogroup(both.groupBy("no")).applyInPandas(lambda a, b: _documents_of_block(a, b, length, buckets), _ROWS)
