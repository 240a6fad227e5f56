"""Exact Jaccard join of word n-gram sets as a metric-space join, and the groups it makes.

1 - Jaccard is a metric d, and so is the size of the symmetric difference. The join runs in three steps.

First regions. A pivot document cuts the space of sets only where distances to it vary by more than the window; for texts
that share nothing every distance is 1. So the space is first projected: hashing deals the n-grams to m subspaces, and the
part of a set in a subspace is its pivot there. If two sets differ by at most k n-grams and m > k, the triangle inequality
leaves one subspace at least in which they do not differ, so they stand in a common region. k follows from the
threshold and the largest size of a size class; a set is replicated into every further class that has sizes it can be
linked with (the window of the size pivot, the empty set). A region that only one set has is dropped. Linked sets share one
region more than the parts of a set outnumber k, so a set leaves out as many regions that hold many sets (a passage
that many texts share), and all of them are kept where it has fewer to spare. Inside a region the bound from sizes and bit parities
(the bits that differ are at most the symmetric difference) says which sets may link; what these connect is a cell, and no
link leaves it.

Voronoi recursion. A cell over the limit takes pivot documents that lie more than two thresholds apart. Every member
goes to the cell of its nearest pivot, and to the cell of an earlier pivot as a guest if its distance to that one is larger by
no more than two thresholds: if x and y link, d(x, p) <= d(x, y) + d(y, p) gives both triangle inequalities that
make this enough. Two guests of a cell are not compared there, so a pair is compared in one cell only. Cells recur while
they are large and cut. One that does not (near copies, all within a window) is compared block by block, each pair of blocks a
piece of work of its own; where only groups are wanted, what links with its pivot is linked to it and needs no comparison
with its like.

Leaves. A piece of work is bounded in sets and n-grams, and a task verifies all its pairs exactly with products of its
incidence matrix. Out come sums per set (links, as rows are counted) and the group label of every linked set, never pairs.

Equal sets are one entry throughout: one document stands for all with its set before any region is made, so copies share
none. Regions of few blocks meet in a task that one of these blocks names, so sets that share many meet in few tasks. Groups are found by label
propagation with pointer jumping over written tables, on labels of cells instead of sets. N-grams are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from granary.llm import textblocks
from granary.llm.common import partitions, staged

BROADCAST_ROWS = 100_000
BUCKET_BYTES = 8_000_000
# text whose shared regions meet in one task, and the least number of such tasks: the more meet, the fewer times parities are sent
GROUP_BYTES, LEAST_GROUPS = 128_000_000, 8
CELL_ROWS = 400
CELL_SHINGLES = 50_000
FEW = 16  # so few sets are one piece of work at any size
PIVOTS = 8
LEVELS = 12
_CHUNK = 1 << 20
MANY = 64  # entries of a region beyond which sets leave it out if they can
NEAR = 16  # blocks of a region up to which one of them names the place where its sets meet
_KEPT = 5  # bytes of a region key that are compared inside its bucket
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)))
    down = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, _INVERSE, np.uint64)))
    return up, down


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, hash) of every word, A-Z in lower case; arrays beside the data are bounded by the longest word."""
    gap = ((data == 0x20) | ((data >= 9) & (data <= 13))).view(np.int8)
    edge = np.diff(np.concatenate([np.ones(1, np.int8), gap, np.ones(1, np.int8)]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _CHUNK, side="right")))
        part = data[base : ends[to - 1]]
        up, down = _powers(_CHUNK) if len(part) <= _CHUNK else _powers.__wrapped__(len(part))
        lower = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint64)
        sums = np.append(np.zeros(1, np.uint64), np.cumsum((lower + np.uint64(1)) * up[: len(part)]))
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * down[s] ^ mix((e - s).astype(np.uint64)))
        at = to
    return starts, out


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The distinct hashed ``size``-word shingles of every text, ascending; with fewer words, the whole sequence is one."""
    at = 0
    while at < len(texts):
        to, held = at + 1, len(texts[at])
        while to < len(texts) and held + len(texts[to]) < _CHUNK:
            held += len(texts[to]) + 1
            to += 1
        coded, at = texts[at:to], to
        starts, word = _word_hashes(np.frombuffer(b"\n".join([*coded, b""]), np.uint8))
        limits = np.cumsum([len(c) + 1 for c in coded])
        cuts = np.searchsorted(starts, np.append(0, limits))
        whole = np.zeros(max(0, len(word) - size + 1), np.uint64)
        for i in range(size):
            whole = whole * np.uint64(_BASE) + word[i : len(word) - size + 1 + i]
        whole = mix(whole ^ np.uint64(size))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            if b - a >= size:
                yield np.unique(whole[a : b - size + 1])
            elif b > a:
                h = np.zeros(1, np.uint64)
                for w in word[a:b]:
                    h = h * np.uint64(_BASE) + w
                yield mix(h ^ np.uint64((b - a) << 8))
            else:
                yield np.zeros(0, np.uint64)


class Classes:
    """Size classes with the number of subspaces of each, for a threshold of ``num`` / ``den``."""

    def __init__(self, num: int, den: int, ratio: float = 1.5):
        self.num, self.den, self.ratio = num, den, ratio
        self.lows, self.budgets, self.parts = [1], [], []
        self._grow(1)

    def _grow(self, n: int) -> None:
        """Classes up to size ``n``."""
        while self.lows[-1] <= n or not self.budgets:
            low = self.lows[-1]
            high = max(low, int(np.ceil(low * self.ratio)) - 1)
            budget = (self.den - self.num) * 2 * high // (self.den + self.num)
            parts = budget + 1
            # parts that stay empty by chance are made up for, so that few sets need their empty parts
            for _ in range(4):
                parts = int(np.ceil((budget + 1) / (1 - np.exp(-low / parts)))) + (budget > 0)
            self.budgets.append(budget)
            self.parts.append(parts)
            self.lows.append(high + 1)

    def of(self, n: int) -> list[int]:
        """The classes in which a set of ``n`` meets all sets it can be linked with."""
        self._grow(n * self.den // self.num + 1)
        c = int(np.searchsorted(self.lows, n, side="right")) - 1
        further = range(c + 1, len(self.budgets))  # a low threshold links sets that lie several classes apart
        return [i for i in [c, *(i for i in further if n * self.den >= self.num * self.lows[i])] if self.budgets[i]]

    def regions(self, shingles: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """A key for every region of the set (class, subspace and the part of the set that lies in it), and per class how
        many there are and how many of them can be left out."""
        keys, spare, n = [], [], len(shingles)
        spread, place = mix(shingles + np.uint64(0x51)), (mix(shingles ^ np.uint64(0xA5)) >> np.uint64(33)).astype(np.int64)
        for c in self.of(n):
            m = self.parts[c]
            part = place % m
            order = np.argsort(part, kind="stable")
            used, begin = np.unique(part[order], return_index=True)
            sums = np.add.reduceat(spread[order], begin)
            if len(used) <= self.budgets[c]:
                full = np.zeros(m, np.uint64)
                full[used] = sums
                used, sums = np.arange(m), full
            keys.append(mix(sums ^ mix((used.astype(np.uint64) << np.uint64(8)) + np.uint64(c))))
            differ = (self.den - self.num) * (n + min(n * self.den // self.num, self.lows[c + 1] - 1)) // (self.den + self.num)
            spare.append((len(used), max(0, len(used) - differ - 1)))
        return (np.concatenate(keys) if keys else np.zeros(0, np.uint64)), spare


def parity_words(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """64-bit words of the parities of sets of ``n``: sets that share nothing differ in half of the bits, a quarter more than links can."""
    most = (den - num) * 2 * n // (den + num)
    return np.minimum(64, 1 << np.frexp(np.maximum(5 * most // 2 - 1, 0) // 64)[1].astype(np.int64))


def parities(shingles: np.ndarray, words: int) -> np.ndarray:
    """Whether the number of shingles is odd for every value of their low bits; halves of it add up to that of half the width."""
    bits = 64 * words
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def digest(shingles: np.ndarray) -> int:
    """64 bits that name the set."""
    with np.errstate(over="ignore"):
        both = [mix(shingles + np.uint64(1)).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0xC3)).sum(dtype=np.uint64) + np.uint64(len(shingles))]
        return int(mix(mix(np.array(both[:1])) + np.array(both[1:])).view(np.int64)[0])


def least_labels(node: np.ndarray, key: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For every node the smallest label that common keys lead to."""
    order = np.argsort(key, kind="stable")
    node, key = node[order], key[order]
    new = np.append(True, key[1:] != key[:-1])
    several = ~(new & np.append(new[1:], True))
    node, new = node[several], new[several]
    if not len(node):
        return label
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    while True:
        low = label.copy()
        np.minimum.at(low, node, np.minimum.reduceat(label[node], first)[group])
        if (low == label).all():
            return label
        label = low


_DESCRIBED = "no long, pos int, doc_id long, n long, e long"


def _describe(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """A row per document with its set's size and digest."""
    for batch in batches:
        for file in batch.itertuples():
            doc, null, texts = textblocks.read(file.path)
            told = [(len(s), digest(s)) for s in shingle_sets(texts, size)]
            n, e = np.array(told, np.int64).reshape(-1, 2).T
            yield pd.DataFrame({"no": file.no, "pos": np.arange(len(doc)), "doc_id": pd.Series(doc, dtype="Int64").mask(null), "n": n, "e": e})


class Regions:
    """The sets of the chosen documents of a block (``e``, ``n``, parities) and the rows (key, node) of their regions by bucket and key."""

    def __init__(self, texts: list[bytes], size: int, classes: Classes, buckets: int):
        keys, self.spare, self.sets, e = [], [], [], []
        for s in shingle_sets(texts, size):
            key, spare = classes.regions(s)
            keys.append(key)
            e.append(digest(s))
            self.spare.append(spare)
            self.sets.append((len(s), parities(s, int(parity_words(np.array([len(s)]), classes.num, classes.den)[0]))))
        self.e = np.array(e, np.int64)
        key = np.concatenate([np.zeros(0, np.uint64), *keys])
        node = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        # which class of its set a region belongs to
        sizes = [many for spare in self.spare for many, _ in spare]
        share = np.repeat(np.arange(len(sizes)), sizes)
        bucket = (key % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((key, bucket))
        self.key, self.node, self.share, self.bucket = key[order], node[order], share[order], bucket[order]
        self.new = np.append(True, self.key[1:] != self.key[:-1]) if len(key) else np.zeros(0, bool)


def _chosen(file) -> list[bytes]:
    """The texts at the places ``pos`` of a block."""
    texts = textblocks.read(file.path)[2]
    return [texts[p] for p in file.pos]


_KEYS = "no long, bucket int, regions binary, several binary"


def _keys(batches: Iterator[pd.DataFrame], size: int, num: int, den: int, buckets: int) -> Iterator[pd.DataFrame]:
    """Of every block and bucket the region keys of the chosen sets, each once with the number of sets that have it."""
    classes = Classes(num, den)
    for batch in batches:
        for file in batch.itertuples():
            r = Regions(_chosen(file), size, classes, buckets)
            first = np.flatnonzero(r.new)
            several = np.minimum(np.diff(np.append(first, len(r.key))), 255).astype(np.uint8)
            key, bucket = r.key[first], r.bucket[first]
            cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            rows = [(file.no, int(bucket[a]), _short(key[a:b]), several[a:b].tobytes()) for a, b in zip(cut, cut[1:], strict=False) if a < b]
            if rows:
                yield pd.DataFrame(rows, columns=["no", "bucket", "regions", "several"])


def _short(keys: np.ndarray) -> bytes:
    return (keys >> np.uint64(8 * (8 - _KEPT))).view(np.uint8).reshape(-1, 8)[:, :_KEPT].tobytes()


def _long(short: list[bytes]) -> np.ndarray:
    kept = np.frombuffer(b"".join(short), np.uint8).reshape(-1, _KEPT)
    raw = np.zeros((len(kept), 8), np.uint8)
    raw[:, :_KEPT] = kept
    return raw.view("<u8")[:, 0]


_MARKS = "no long, bucket int, marks binary, meets binary"


def _shared(pdf: pd.DataFrame, near: int, groups: int) -> pd.DataFrame:
    """For every region of a block 1 if several sets have it, 3 if more than ``MANY`` do, else 0; and where those of several sets meet.

    Regions of at most ``near`` blocks meet where one of these blocks says, others where their key does.
    """
    key, region, blocks = np.unique(_long(list(pdf.regions)), return_inverse=True, return_counts=True)
    counts = pdf.several.str.len().to_numpy()
    held = np.bincount(region, np.frombuffer(b"".join(pdf.several), np.uint8))
    marks = ((held > 1) + 2 * (held > MANY)).astype(np.uint8)[region]
    least = np.full(len(key), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, region, np.repeat(mix(pdf.no.to_numpy(np.int64)), counts))
    meets = (np.where(blocks <= near, mix(least), mix(key)) % np.uint64(groups)).astype("<u4")[region]
    out = []
    for a, b in zip([0, *(cuts := np.cumsum(counts).tolist())], cuts, strict=False):
        out.append((_packed(marks[a:b].tobytes()), _packed(meets[a:b][marks[a:b] > 0].tobytes())))
    return pd.DataFrame(out, columns=["marks", "meets"]).assign(no=pdf.no.to_numpy(), bucket=pdf.bucket.to_numpy())[["no", "bucket", "marks", "meets"]]


def _packed(data: bytes) -> bytes:
    return zstandard.compress(data)


def _unpacked(parts: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(map(zstandard.decompress, parts)), kind)


_SENT = "no long, bucket int, regions binary, nodes binary, e binary, n binary, words binary"


def _shared_regions(chosen: pd.DataFrame, marks: pd.DataFrame, size: int, num: int, den: int, buckets: int) -> pd.DataFrame:
    """Per meeting place (``bucket``) the shared regions of a block's sets, and size and parities of these sets."""
    columns = [x.split()[0] for x in _SENT.split(", ")]
    if chosen.empty or marks.empty:
        return pd.DataFrame([], columns=columns)
    file = next(chosen.itertuples())
    r = Regions(_chosen(file), size, Classes(num, den), buckets)
    marks = marks.sort_values("bucket")
    each = _unpacked(marks.marks, np.uint8)
    meets = np.zeros(len(each), np.int64)
    meets[each > 0] = _unpacked(marks.meets, "<u4")
    region = np.cumsum(r.new) - 1
    mark, group = each[region], meets[region]
    spare = np.array([more for spare in r.spare for _, more in spare])
    kept = (mark == 1) | ((mark == 3) & (np.bincount(r.share[mark == 3], minlength=len(spare)) > spare)[r.share])
    group = group[kept]
    order = np.argsort(group, kind="stable")
    key, node, bucket = r.key[kept][order], r.node[kept][order], group[order]
    cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    rows = []
    for a, b in zip(cut, cut[1:], strict=False):
        if a < b:
            own, at = np.unique(node[a:b], return_inverse=True)
            n = np.array([r.sets[i][0] for i in own.tolist()], np.int64)
            words = b"".join(r.sets[i][1].tobytes() for i in own.tolist())
            rows.append((int(file.no), int(bucket[a]), _short(key[a:b]), at.astype("<i4").tobytes(), r.e[own].tobytes(), n.tobytes(), words))
    return pd.DataFrame(rows, columns=columns)


def _differing(a: np.ndarray, b: np.ndarray, start: np.ndarray, wide: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The number of bits in which the parities of the sets ``a`` and ``b`` differ, at the smaller of both widths."""
    out = np.zeros(len(a), np.int64)
    for wa, wb in {*zip(wide[a].tolist(), wide[b].tolist(), strict=True)}:
        at = np.flatnonzero((wide[a] == wa) & (wide[b] == wb))
        low = min(wa, wb)
        for begin in range(0, len(at), 1 << 16):
            part = at[begin : begin + (1 << 16)]
            x, y = (words[start[i][:, None] + np.arange(w)] for i, w in ((a[part], wa), (b[part], wb)))
            x, y = (np.bitwise_xor.reduce(z.reshape(len(part), -1, low), axis=1) for z in (x, y))
            out[part] = np.bitwise_count(x ^ y).sum(1)
    return out


def _plausible(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """(x, y): sets that regions of this bucket and the bounds connect, each with the smallest it leads to.

    Every set of a region is compared with one of its sets after the other; regions whose sets are connected need no more.
    """
    e, n = np.frombuffer(b"".join(pdf.e), np.int64), np.frombuffer(b"".join(pdf.n), np.int64)
    words = np.frombuffer(b"".join(pdf.words), np.uint64)
    counts = pdf.e.str.len().to_numpy() // 8
    node = np.frombuffer(b"".join(pdf.nodes), "<i4") + np.repeat(np.cumsum(counts) - counts, pdf.nodes.str.len() // 4)
    wide = parity_words(n, num, den)
    start = np.cumsum(wide) - wide
    # equal sets of several blocks are one node
    name, first, same = np.unique(e, return_index=True, return_inverse=True)
    _, region = np.unique(_long(list(pdf.regions)), return_inverse=True)
    rows = np.unique(np.stack([region, same[node]], 1), axis=0)
    region, node = rows[:, 0], rows[:, 1]
    label = np.arange(len(name))
    turn = 0
    while len(region):
        begin = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
        size = np.diff(np.append(begin, len(region)))
        low, high = np.minimum.reduceat(label[node], begin), np.maximum.reduceat(label[node], begin)
        open_ = (low < high) & (size > turn)
        if not open_.any():
            break
        kept = np.repeat(open_, size)
        pivot = np.repeat(node[np.minimum(begin + turn, len(node) - 1)], size)[kept]
        region, node = region[kept], node[kept]
        ask = np.flatnonzero(label[pivot] != label[node])
        a, b = first[pivot[ask]], first[node[ask]]
        fits = np.maximum(n[a], n[b]) * num <= np.minimum(n[a], n[b]) * den
        ask, a, b = ask[fits], a[fits], b[fits]
        fits = _differing(a, b, start, wide, words) * (den + num) <= (n[a] + n[b]) * (den - num)
        ask = ask[fits]
        if len(ask):
            pair = np.arange(len(ask), dtype=np.uint64)
            label = least_labels(np.concatenate([pivot[ask], node[ask], np.arange(len(label)), label]), np.concatenate([pair, pair, np.arange(len(label), dtype=np.uint64) + len(ask), np.arange(len(label), dtype=np.uint64) + len(ask)]), label)
        turn += 1
    moved = label != np.arange(len(label))
    return pd.DataFrame({"x": name[moved], "y": name[label[moved]]})


_MEMBERS = "cell long, e long, mask long, held long, n long, s binary"


def _fetch(manifest: pd.DataFrame, wanted: pd.DataFrame, size: int) -> pd.DataFrame:
    """The sets of the wanted documents of a block."""
    if manifest.empty or wanted.empty:
        return pd.DataFrame([], columns=[x.split()[0] for x in _MEMBERS.split(", ")])
    texts = textblocks.read(manifest.path.iloc[0])[2]
    sets = shingle_sets([texts[p] for p in wanted.pos], size)
    return wanted[["cell", "e", "held", "n"]].assign(mask=0, s=[s.tobytes() for s in sets])


def _distances(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """Jaccard distances of all sets (rows) to the pivots."""
    sizes = np.array([len(s) for s in sets])
    first, joined = np.cumsum(sizes) - sizes, np.concatenate(sets)
    out = np.empty((len(sets), len(pivots)))
    for j, p in enumerate(pivots):
        at = np.minimum(np.searchsorted(p, joined), len(p) - 1)
        inter = np.add.reduceat((p[at] == joined).astype(np.int64), first)
        out[:, j] = 1 - inter / (sizes + len(p) - inter)
    return out


_SPLIT = _MEMBERS + ", stuck boolean, guest boolean, label long"


def _pivots(seeds: pd.DataFrame, window: float) -> tuple[list[int], list[np.ndarray]]:
    """Names and sets of seeds that lie more than two thresholds apart, the first one always."""
    names, pivots = [], []
    for e, s in sorted((int(r["e"]), r["s"]) for r in seeds.seeds.iloc[0]):
        s = np.frombuffer(s, np.uint64)
        if e not in names and all(d > 2 * window for d in (_distances([s], pivots)[0] if pivots else [])):
            names.append(e)
            pivots.append(s)
    return names, pivots


def _cells(far: np.ndarray, window: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(pivot, who stays, who visits) of the cells of a Voronoi partition."""
    home = far.argmin(1)
    least = far[np.arange(len(far)), home]
    for j in range(far.shape[1]):
        yield j, home == j, (home > j) & (far[:, j] - least <= 2 * window)


def _measure(members: pd.DataFrame, seeds: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """(cell, part, load): what the cells of the pivots would hold of a part of a cell."""
    if members.empty:
        return pd.DataFrame([], columns=["cell", "part", "load"])
    window = (den - num) / den + 1e-9
    far = _distances([np.frombuffer(s, np.uint64) for s in members.s], _pivots(seeds, window)[1])
    n = members.n.to_numpy()
    return pd.DataFrame([(int(members.cell.iloc[0]), j, int(n[stays | visits].sum())) for j, stays, visits in _cells(far, window)], columns=["cell", "part", "load"])


def _split(members: pd.DataFrame, seeds: pd.DataFrame, num: int, den: int, level: int, only_groups: bool) -> pd.DataFrame:
    """The members of a part of a cell in the cells of its pivots, guests included; uncut where ``seeds`` say so."""
    columns = [x.split()[0] for x in _SPLIT.split(", ")]
    if members.empty:
        return pd.DataFrame([], columns=columns)
    window = (den - num) / den + 1e-9
    names, pivots = _pivots(seeds, window)
    out = members.reset_index(drop=True).assign(stuck=False, guest=False, label=pd.Series(pd.NA, index=range(len(members)), dtype="Int64"))
    sets = [np.frombuffer(s, np.uint64) for s in members.s]
    if not seeds.cuts.iloc[0]:
        out["stuck"] = True
        if only_groups:
            near = _distances(sets, pivots[:1])[:, 0] <= window - 2e-9
            out["guest"] = near
            out["mask"] = out["mask"] | np.where(near, 1 << level, 0)
            out["label"] = pd.Series(np.full(len(out), names[0]), dtype="Int64").mask(~near)
        return out[columns]
    parts = []
    for j, stays, visits in _cells(_distances(sets, pivots), window):
        part = out[stays | visits].copy()
        part["mask"] = part["mask"] | np.where(visits[stays | visits], 1 << level, 0)
        old = part["cell"].to_numpy(np.int64).view(np.uint64)
        part["cell"] = mix(mix(old + np.uint64(level + 1)) ^ np.array([names[j]], np.int64).view(np.uint64)).view(np.int64)
        parts.append(part)
    return pd.concat(parts)[columns]


def _verified(sets: list[np.ndarray], side: np.ndarray, mask: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs link: all of one side, or those between both sides; two members with a common bit of ``mask`` never do here."""
    sizes = np.array([len(s) for s in sets])
    m = len(sets)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    # what a single set holds adds nothing, what all hold is added at once
    shared = (count > 1) & (count < m)
    number = np.cumsum(shared) - 1
    row, column = row[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inter = np.full((m, m), float((count == m).sum()), np.float32)
    for begin in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [begin, begin + 4096])
        held = np.zeros((m, min(4096, int(shared.sum()) - begin)), np.float32)
        held[row[a:b], column[a:b] - begin] = 1
        inter += held @ held.T
    inter = inter.astype(np.int64)
    link = den * inter >= num * (sizes[:, None] + sizes[None] - inter)
    link &= (mask[:, None] & mask[None]) == 0
    if side.any():
        link &= side[:, None] != side[None]
    np.fill_diagonal(link, False)
    return link


def _leaves(batches: Iterator[pd.DataFrame], num: int, den: int) -> Iterator[pd.DataFrame]:
    """(e, label, beside) of every linked set of each piece of work: its group there, and the rows of the sets it links with."""

    def work(part: pd.DataFrame) -> pd.DataFrame | None:
        if len(part) < 2:
            return None
        link = _verified([np.frombuffer(s, np.uint64) for s in part.s], part.side.to_numpy(), part["mask"].to_numpy(), num, den)
        if not link.any():
            return None
        label = part.e.to_numpy(np.int64)
        while True:
            low = np.minimum(label, np.where(link, label[None], np.iinfo(np.int64).max).min(1))
            if (low == label).all():
                break
            label = low
        linked = link.any(1)
        return pd.DataFrame({"e": part.e.to_numpy()[linked], "label": label[linked], "beside": (link @ part.held.to_numpy(np.int64))[linked]})

    held: list[pd.DataFrame] = []
    out: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        cut = [0, *(np.flatnonzero(np.diff(batch.key.to_numpy())) + 1).tolist(), len(batch)]
        for a, b in zip(cut, cut[1:], strict=False):
            part = batch.iloc[a:b]
            if held and held[0].key.iloc[0] != part.key.iloc[0]:
                out.append(work(pd.concat(held)))
                held = []
            held.append(part)
        if any(x is not None for x in out):
            yield pd.concat([x for x in out if x is not None])
        out = []
    if held and (last := work(pd.concat(held))) is not None:
        yield last


def _bounded(df: DataFrame, rows: int, shingles: int) -> DataFrame:
    """(cell, load, parts) of the cells over the limits."""
    sizes = df.groupBy("cell").agg(F.sum("n").alias("load"), F.count(F.lit(1)).alias("many"))
    parts = F.greatest(F.ceil(F.col("load") / shingles), F.ceil(F.col("many") / rows)).cast("int")
    return sizes.select("cell", "load", "many", parts.alias("parts")).where(f"parts > 1 AND many > {FEW}")


def _pieces(members: DataFrame, num: int, den: int, rows: int, shingles: int, only_groups: bool) -> tuple[DataFrame, DataFrame | None]:
    """(key, side, e, mask, held, n, s): bounded pieces of work that hold every pair that can link, and labels found before."""
    kept = ["cell", "e", "mask", "held", "n", "s"]
    spread = 4 * partitions(members)

    def split_at(level: int):
        return lambda a, b: _split(a, b, num, den, level, only_groups)

    ready, blocks, labels = [], [], []
    for level in range(LEVELS):
        big = staged(_bounded(members, rows, shingles), "big")
        many = big.count()
        if not many:
            ready.append(members)
            break
        ready.append(members.join(_sized(big, many), "cell", "left_anti"))
        large = members.join(_sized(big, many), "cell").withColumn("salt", F.pmod(F.xxhash64("e"), F.col("parts")).cast("int"))
        left = large.select(*kept, "salt").repartition(spread, "cell", "salt").groupBy("cell", "salt")
        seed = [F.min_by(F.struct("e", "s"), F.xxhash64("e", F.lit(level * PIVOTS + k))).alias(f"s{k}") for k in range(PIVOTS)]
        seeds = staged(large.groupBy("cell").agg(F.max("parts").alias("parts"), F.max("load").alias("whole"), *seed), "seeds")
        salted = seeds.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.array(*[f"s{k}" for k in range(PIVOTS)]).alias("seeds"))
        loads = left.cogroup(salted.repartition(spread, "cell", "salt").groupBy("cell", "salt")).applyInPandas(lambda a, b: _measure(a, b, num, den), "cell long, part int, load long")
        loads = loads.groupBy("cell", "part").agg(F.sum("load").alias("load")).groupBy("cell").agg(F.sum("load").alias("total"), F.max("load").alias("most"))
        # a cell that hardly shrinks, or whose guests outweigh it, is not cut again
        cuts = (F.col("most") <= 0.7 * F.col("whole")) & (F.col("total") <= 1.5 * F.col("whole")) & F.lit(level < LEVELS - 1)
        told = staged(loads.join(seeds.select("cell", "whole"), "cell").select("cell", cuts.alias("cuts")), "cuts")
        right = salted.join(_sized(told, many), "cell").repartition(spread, "cell", "salt").groupBy("cell", "salt")
        cut = staged(left.cogroup(right).applyInPandas(split_at(level), _SPLIT), "cut")
        labels.append(cut.where("label IS NOT NULL").select("e", "label", F.lit(0).cast("long").alias("beside")))
        blocks.append(cut.where("stuck").select(*kept, "guest"))
        members = cut.where("NOT stuck").select(*kept)
    pieces = _union(ready).select(F.col("cell").alias("key"), F.lit(0).alias("side"), *kept[1:])
    if blocks:
        stuck = staged(_union(blocks), "stuck")
        per = lambda guest: F.greatest(F.ceil(F.sum(F.when(F.col("guest") == guest, F.col("n")).otherwise(0)) / shingles), F.ceil(F.count(F.when(F.col("guest") == guest, 1)) / rows)).cast("int")
        sizes = staged(stuck.groupBy("cell").agg(per(False).alias("own"), per(True).alias("guests")), "stuck-sizes")
        placed = stuck.join(_sized(sizes, sizes.count()), "cell")
        own = F.pmod(F.xxhash64("e", F.lit(7)), F.greatest("own", F.lit(1))).cast("int")
        other = F.col("own") + F.pmod(F.xxhash64("e", F.lit(7)), F.greatest("guests", F.lit(1))).cast("int")
        placed = placed.withColumn("block", F.when(F.col("guest"), other).otherwise(own))
        # pairs of blocks i <= j with i among the cell's own blocks: guests are not compared with each other
        upto = F.when(F.col("guest"), F.col("own") - 1).otherwise(F.col("own") + F.col("guests") - 1)
        placed = placed.where("own > 0").withColumn("with", F.explode(F.sequence(F.lit(0), upto)))
        low, high = F.least("block", "with"), F.greatest("block", "with")
        key = F.xxhash64("cell", low, high).alias("key")
        pieces = pieces.unionByName(placed.select(key, F.when((low != high) & (F.col("block") == high), 1).otherwise(0).alias("side"), *kept[1:]))
    return pieces, _union(labels) if labels else None


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def components(
    docs: DataFrame,
    size: int = 5,
    num: int = 80,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    count_links: bool = False,
    cell_rows: int = CELL_ROWS,
    cell_shingles: int = CELL_SHINGLES,
    block_bytes: int = textblocks.BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: ``component_id`` is the smallest id that links lead to.

    With ``count_links`` every link is verified, also inside groups that are connected already, and a column
    ``n_links`` has the number of other rows the row links with.

    Two rows link when den * intersection >= num * union of their sets of ``size``-word shingles (words between
    ASCII white space, A-Z in lower case). A text without words, or null, has the empty set and links with nothing.
    Equal texts link, so repeated rows share a group; rows with a null id are groups of their own (null). Texts and words
    of any length are read whole. An empty table has no rows.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold has to lie above 0 and not above 1")
    spark = docs.sparkSession
    manifest = textblocks.stored(docs, id_col, text_col, block_bytes)
    blocks, total = manifest.select(F.count(F.lit(1)), F.sum("bytes")).first()
    if not blocks:
        return spark.createDataFrame([], "doc_id long, n_shingles long, component_id long" + ", n_links long" * count_links)
    buckets = max(1, -(-total // BUCKET_BYTES))
    groups = min(buckets, max(LEAST_GROUPS, -(-total // GROUP_BYTES)))
    # explicit numbers: the shuffled rows are small, the work behind them is not
    by_block, by_bucket = min(blocks, 4 * partitions(docs)), min(4 * buckets, 4 * partitions(docs))
    spread = manifest.repartition(by_block, "no")
    rows = staged(spread.mapInPandas(lambda it: _describe(it, size), _DESCRIBED), "described")

    # equal sets are one entry, named by the digest; the row with the smallest id stands for it
    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    entries = full.groupBy("e").agg(F.min(F.struct("doc_id", "no", "pos")).alias("at"), F.count(F.lit(1)).alias("held"), F.max("n").alias("n"))
    entries = staged(entries.select("e", "held", "n", "at.*"), "entries")
    places = entries.groupBy("no").agg(F.sort_array(F.collect_list("pos")).alias("pos"))
    chosen = staged(manifest.join(places, "no"), "chosen").repartition(by_block, "no")

    keys = chosen.mapInPandas(lambda it: _keys(it, size, num, den, buckets), _KEYS).repartition(by_bucket, "bucket").groupBy("bucket")
    near = min(NEAR, blocks // 4)  # of many blocks, so that none of them names the place of much more than its share
    marks = staged(keys.applyInPandas(lambda pdf: _shared(pdf, near, groups), _MARKS), "marks")
    shared = chosen.groupBy("no").cogroup(marks.repartition(by_block, "no").groupBy("no"))
    shared = shared.applyInPandas(lambda a, b: _shared_regions(a, b, size, num, den, buckets), _SENT)
    met = shared.repartition(min(4 * groups, 4 * partitions(docs)), "bucket").groupBy("bucket").applyInPandas(lambda pdf: _plausible(pdf, num, den), "x long, y long")
    cells = connected(met).select(F.col("node").alias("e"), F.col("group").alias("cell"))

    wanted = entries.join(cells, "e").select("no", "pos", "cell", "e", "held", "n")
    found = spread.groupBy("no").cogroup(wanted.repartition(by_block, "no").groupBy("no")).applyInPandas(lambda a, b: _fetch(a, b, size), _MEMBERS)
    members = staged(found, "members")

    pieces, known = _pieces(members, num, den, cell_rows, cell_shingles, not count_links)
    work = pieces.repartition(4 * partitions(docs), "key").sortWithinPartitions("key")
    linked = work.mapInPandas(lambda it: _leaves(it, num, den), "e long, label long, beside long")
    linked = staged(linked if known is None else linked.unionByName(known), "linked")
    sums = staged(linked.groupBy("e").agg(F.min("label").alias("label"), F.sum("beside").alias("beside")), "sums")
    # a set of several pieces of work joins their labels; sets themselves take no part in the propagation
    low = linked.select("e", F.col("label").alias("x")).distinct().join(sums.select("e", F.col("label").alias("y")), "e").where("x <> y").select("x", "y").distinct()
    merged = connected(low).withColumnRenamed("node", "label")
    grouped = sums.join(_sized(merged, merged.count()), "label", "left").select("e", "beside", F.coalesce("group", "label").alias("group"))
    least = entries.join(grouped, "e").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    least = staged(least, "least")
    named = grouped.join(_sized(least, least.count()), "group").select("e", "beside", "component_id")
    named = entries.join(named, "e", "left").select("e", F.coalesce("component_id", "doc_id").alias("component_id"), (F.col("held") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"))

    joined = rows.join(named, "e", "left")
    grouped_row = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    columns = [F.col("doc_id"), F.col("n").alias("n_shingles"), F.when(grouped_row, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")]
    if count_links:
        columns.append(F.when(grouped_row, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))
    return joined.select(*columns)


def first_of_groups(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, that hold the smallest id of their group; of rows with one id and one text, one stays.

    Rows without words, or with a null id, are in no group and stay.
    """
    groups = staged(components(docs, size, num, den, id_col, text_col), "groups")
    row_id = F.col(f"`{id_col}`").cast("long")
    gone = groups.where("component_id IS NOT NULL AND doc_id <> component_id AND n_shingles > 0").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(_sized(gone, gone.count()), row_id == F.col("__gone"), "left_anti")
    # an id on several rows: rare, so only those rows are shuffled
    again = groups.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))
    again = staged(again, "again")
    if again.isEmpty():
        return left
    many = _sized(again, again.count())
    once = left.join(many, row_id == F.col("__again"), "left_anti")
    several = left.join(many, row_id == F.col("__again"), "left_semi").dropDuplicates([id_col, text_col])
    return once.unionByName(several)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """Ids, broadcast where their counted number allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def connected(links: DataFrame) -> DataFrame:
    """(node, group) for every node of the links: the smallest id of its component.

    Each round gives a node the smallest label among its neighbours' and its own, then the label of that label
    (pointer jumping), and writes the labels as a table; it ends when none changes.
    """
    edges = staged(links.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(links.select(F.col("y").alias("u"), F.col("x").alias("v"))).distinct(), "edges")
    labels = staged(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("group")).select(F.col("u").alias("node"), "group"), "labels")
    nodes = labels.count()
    while nodes:
        near = edges.join(_sized(labels, nodes), F.col("v") == F.col("node")).groupBy("u").agg(F.min("group").alias("best"))
        joined = labels.join(near, labels.node == near.u).select("node", F.col("group").alias("old"), F.least("group", "best").alias("new"))
        jump = labels.select(F.col("node").alias("at"), F.col("group").alias("further"))
        moved = staged(joined.join(_sized(jump, nodes), joined.new == jump.at).select("node", "old", F.least("new", "further").alias("group")), "labels")
        labels = moved.select("node", "group")
        if moved.where("old <> group").isEmpty():
            break
    return labels
