"""Ranked lexical search: exact inner products of sparse vectors over ball trees, searched best first.

A document is the sparse vector of its integer term impacts, an item the vector of its integer term weights, and the
score their inner product. A node of a ball tree has a centre c and a radius r that no document x below it exceeds,
so q.x = q.c + q.(x - c) <= q.c + |q| r. A search takes nodes by descending bound, ends when the best bound lies
below the k-th score found, and computes integer scores at the leaves only. Bounds are doubles: radii and bounds are
rounded up by more than their arithmetic can lose, and a subtree goes only if its bound is below the k-th score, so a
tie is never pruned. Terms that no item has add nothing to any score and are left out of the vectors.

Spark. Items are a stated query set: blocks of them are written as files that tasks read. One pass over the texts turns
each document into its vector (staged), document frequencies and the two sums that the length correction needs are aggregates of
those, and a second pass builds trees of bounded size where the vectors lie and searches them with all items of the
block. Floors carry over from tree to tree in a task, and a task returns its best ``k`` per item, so nothing is shuffled but
counts per term and these.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from granary.llm.common import read_block, read_files, run_folder, slices, staged, text_column, written_blocks

TREE_DOCS = 4096
LEAF = 64
ITEM_CHARS = 100_000
ITEM_ROWS = 512
_PIECE = 1_000_000
_LAST = np.iinfo(np.int64).max  # stands for a null id, after all others
# bytes of terms: digits, letters (A-Z in lower case) and everything outside ASCII
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    data, at = text.encode().translate(_BYTES), 0
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Items:
    """A block of items: their terms, and the numbers of all terms of the block."""

    def __init__(self, path: str, number: int):
        found = read_block(path, "block", number)
        rows = found.to_pydict() if found is not None else {"no": [], "item_id": [], "text": []}
        self.no, self.item_id = rows["no"], rows["item_id"]
        own = [{w for part in terms(t) for w in part} for t in rows["text"]]
        self.number = {w: i for i, w in enumerate(sorted(set().union(*own)))}
        self.terms = [np.array(sorted(self.number[w] for w in words), np.int64) for words in own]


@lru_cache(2)
def _items(path: str, number: int) -> Items:
    return Items(path, number)


def _vectors(batches: Iterator[pd.DataFrame], path: str, number: int) -> Iterator[pd.DataFrame]:
    """(doc_id, n, ids, tfs) of the documents with terms: their length, and the counts of the terms that items have."""
    get = _items(path, number).number.get
    for batch in slices(batches, "text"):
        rows = []
        for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
            n, hits = 0, []
            for words in terms(text):
                n += len(words)
                hits += [i for i in map(get, words) if i is not None]
            if n:
                rows.append((doc_id, n, *np.unique(np.array(hits, np.int32), return_counts=True)))
        yield pd.DataFrame(rows, columns=["doc_id", "n", "ids", "tfs"]).astype({"doc_id": "Int64", "n": "int64"})


class Tree:
    """A ball tree over sparse rows (``start`` of each row in ``ids`` and ``x``, no row empty) of ``width`` dimensions."""

    def __init__(self, start: np.ndarray, ids: np.ndarray, x: np.ndarray, width: int, leaf: int = LEAF):
        self.leaf, self.width = leaf, width
        self.bounds = np.append(start, len(ids))
        self.ids, self.x = ids, x
        self.rows: list = []  # per node: the rows of a leaf, else its children
        self.centres: list = []
        self.radii: list = []
        self._grow(np.arange(len(start)))
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)
        # every leaf with its entries side by side
        self.leaves = {at: self._entries(rows) + (rows,) for at, (rows, below) in enumerate(self.rows) if below is None}

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begin, sizes = self.bounds[rows], self.bounds[rows + 1] - self.bounds[rows]
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(begin - first, sizes)
        return first, self.ids[at], self.x[at]

    def _grow(self, rows: np.ndarray) -> int:
        at = len(self.rows)
        first, ids, x = self._entries(rows)
        real = x.astype(np.float64)
        norms = np.add.reduceat(real * real, first)

        def distances(point: np.ndarray) -> np.ndarray:
            """Squared distances to a point, rounded up by more than sums of so many products can be off."""
            square = float(point @ point)
            exact = norms - 2 * np.add.reduceat(real * point[ids], first) + square
            return np.maximum(exact, 0) + 1e-10 * (norms + square)

        centre = np.bincount(ids, real, self.width) / len(rows)
        off = distances(centre)
        self.rows.append((rows, None))
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(off.max())) * (1 + 1e-12))
        if len(rows) > self.leaf:
            # two rows far apart; every row goes to the nearer one
            far = [self._point(rows[int(off.argmax())])]
            one = distances(far[0])
            far.append(self._point(rows[int(one.argmax())]))
            apart = one - distances(far[1])
            near = apart <= 0
            if not len(rows) <= 8 * near.sum() <= 7 * len(rows):  # else a row at a time would split off
                near = np.zeros(len(rows), bool)
                near[np.argsort(apart, kind="stable")[: len(rows) // 2]] = True
            self.rows[at] = (None, (self._grow(rows[near]), self._grow(rows[~near])))
        return at

    def _point(self, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        held = slice(self.bounds[row], self.bounds[row + 1])
        out[self.ids[held]] = self.x[held]
        return out

    def upper(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of all nodes (rows) for all queries (columns)."""
        dot = self.centres @ queries
        spread = self.radii[:, None] * np.sqrt((queries * queries).sum(0))[None]
        return (dot + spread) * (1 + 1e-9) + 1

    def search(self, query: np.ndarray, upper: np.ndarray, names: np.ndarray, best: list, k: int) -> None:
        """Put the ``k`` best (score, -name) above 0 of this tree and of ``best`` into ``best``, a heap."""
        queue = [(-upper[0], 0)]
        while queue:
            bound, at = heapq.heappop(queue)
            floor = best[0][0] if len(best) == k else 1
            if -bound < floor:
                break
            below = self.rows[at][1]
            if below is not None:
                for child in below:
                    near = min(-bound, upper[child])
                    if near >= floor:
                        heapq.heappush(queue, (-near, child))
                continue
            first, ids, x, rows = self.leaves[at]
            score = np.add.reduceat(x * query[ids], first)
            for i in np.flatnonzero(score >= floor):
                found = (int(score[i]), -int(names[rows[i]]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)


def _search(batches: Iterator[pd.DataFrame], path: str, number: int, counts: str, n_docs: int, n_terms: int, k: int, tree_docs: int) -> Iterator[pd.DataFrame]:
    items = _items(path, number)
    width = max(1, len(items.number))
    df = np.zeros(width, np.int64)
    table = read_files(counts)
    df[table["id"].to_numpy()] = table["df"].to_numpy()
    weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
    queries = np.zeros((width, len(items.no)), np.int64)
    for i, own in enumerate(items.terms):
        queries[own, i] = np.where(df[own] > 0, weight[own], 0)
    real, columns = queries.astype(np.float64), np.ascontiguousarray(queries.T)
    best: list[list] = [[] for _ in items.no]

    def plant(rows: list[pd.DataFrame]) -> None:
        part = pd.concat(rows)
        part = part[part.ids.str.len() > 0]
        if part.empty:
            return
        sizes = part.ids.str.len().to_numpy(np.int64)
        ids, tf = np.concatenate(part.ids.to_list()).astype(np.int64), np.concatenate(part.tfs.to_list()).astype(np.int64)
        m = 10 + 90 * part.n.to_numpy(np.int64) * n_docs // n_terms
        x = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
        tree = Tree(np.cumsum(sizes) - sizes, ids, x, width)
        names = part.doc_id.astype("Int64").fillna(_LAST).to_numpy(np.int64)
        upper = tree.upper(real)
        for i, own in enumerate(best):
            tree.search(columns[i], upper[:, i], names, own, k)

    held, rows = [], 0
    for batch in batches:
        for begin in range(0, len(batch), tree_docs):
            part = batch.iloc[begin : begin + tree_docs]
            if rows + len(part) > tree_docs:
                plant(held)
                held, rows = [], 0
            held.append(part)
            rows += len(part)
    if rows:
        plant(held)
    out = [(no, item, None if -d == _LAST else -d, s) for no, item, own in zip(items.no, items.item_id, best, strict=True) for s, d in own]
    yield pd.DataFrame(out, columns=["no", "item_id", "doc_id", "score"]).astype({"item_id": "Int64", "doc_id": "Int64", "no": "int64", "score": "int64"})


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", tree_docs: int = TREE_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for every item.

    A term's weight is floor(1000 * ln((2 N + 2) / (2 df + 1))), its impact in a document 10^9 tf div (1000 tf + 8 m) with
    m = 10 + 90 n N div L, for N documents with terms, L terms in all of them, n in the document. Equal scores go by
    ascending id, null ids last. Null and empty texts have no terms, and items without any return nothing. Every row is a
    document of its own, repeated or not; equal items (id and text) are asked once. Texts of any length are read whole. With
    an empty table on either side there are no rows. Scores have to fit a long.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), text_column(text_col).alias("text")).distinct()
    asked = staged(asked.withColumn("no", F.monotonically_increasing_id()), "items")
    size = asked.select(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    if not size[0]:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    blocks = max(-(-size[0] // ITEM_ROWS), -(-(size[1] or 1) // ITEM_CHARS))
    path = written_blocks(asked.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int")), "item-blocks", "block", blocks)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_column(text_col).alias("text"))

    found, sums = None, None
    for number in range(blocks):
        vectors = staged(texts.mapInPandas(lambda it, b=number: _vectors(it, path, b), "doc_id long, n long, ids array<int>, tfs array<long>"), "vectors")
        if sums is None:
            sums = vectors.select(F.count(F.lit(1)), F.sum("n")).first()
            if not sums[0]:
                return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        counts = run_folder(spark, "frequencies")
        vectors.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).write.parquet(counts)
        near = vectors.where(F.size("ids") > 0).select("doc_id", "n", "ids", "tfs")
        near = near.mapInPandas(lambda it, b=number, c=counts: _search(it, path, b, c, sums[0], sums[1], k, tree_docs), "no long, item_id long, doc_id long, score long")
        found = near if found is None else found.unionByName(near)
    rank = F.row_number().over(W.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
