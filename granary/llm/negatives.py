"""Hard negatives by exact inner products of Kronecker-packed vectors.

Packing. All components are biased by the least one, so they are not negative, and several candidates' biased components
of one dimension are put into separated fields of one wide integer: P_i = sum over j of c_ji * 2^(b j). One multiplication
of an anchor's biased component with P_i multiplies every field, and the sum over the dimensions, taken on the wide
integers, is the sum in every field as long as b bits hold it (width * largest anchor component * largest candidate
component < 2^b): nothing carries into the next field. The fields are cut out at the end, and the biases are taken off:
a.c = field + least * (sum of a + sum of c) - width * least^2 with the true sums. Where two fields or more fit into the 53
bits in which doubles are exact integers, the wide integer is the mantissa of a double, so all products of an anchor block and
a candidate block are one matrix product; wider fields go into Python integers of any length. Both are exact.

Spark. The anchors are a stated query set: they are written once as blocks of files in the shared folder. Each task
takes its candidates in slices and runs every anchor block against them, keeping the best few of each anchor, so
only those are shuffled; no pair of rows is ever a row, and a label that a third of all rows share is split over all tasks.
The first round finds the positives, the second the negatives inside the window that each positive's score opens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from granary.llm.common import read_block, staged, written_blocks

ANCHOR_BLOCK = 1024
SLICE = 65536
CHUNK = 4096
_EXACT = 53  # bits of a double's mantissa
_NONE = np.iinfo(np.int64).min


def labelled_vectors(df: DataFrame, id_col: str, label: Column, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, label, v): vectors as floor(scale * x), without rows that hold a null, NaN or infinity in any of the three."""
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = df.where(F.col(f"`{id_col}`").isNotNull() & label.isNotNull() & vector.isNotNull() & finite)
    return kept.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


class Packing:
    """Fields for vectors of ``width`` components between ``low`` and ``high``."""

    def __init__(self, width: int, low: int, high: int):
        self.width, self.low = max(1, width), min(0, low)  # padding with zeros has to be inside the range
        self.span = max(0, high) - self.low
        self.bits = max(1, (self.width * self.span * self.span).bit_length())
        self.fields = _EXACT // self.bits
        if self.fields < 2:  # whole bytes, so that fields are cut out by place
            self.size = -(-self.bits // 8)

    def matrix(self, vectors) -> np.ndarray:
        out = np.zeros((len(vectors), self.width), np.int64)
        for row, v in zip(out, vectors, strict=True):
            row[: len(v)] = v
        return out

    def pack(self, x: np.ndarray):
        """The wide integers of candidates ``x``, and what is needed to take the biases off."""
        biased = x - self.low
        if self.fields >= 2:
            held = -(-len(x) // self.fields)
            biased = np.vstack([biased, np.zeros((held * self.fields - len(x), self.width), np.int64)]).reshape(self.fields, held, self.width)
            shifts = (1 << (self.bits * np.arange(self.fields, dtype=np.int64)))[:, None, None]
            wide = (biased * shifts).sum(0).astype(np.float64).T
        else:
            wide = []
            for column in biased.T.tolist():
                wide.append(int.from_bytes(b"".join(c.to_bytes(self.size, "little") for c in column), "little"))
        return wide, x.sum(1), len(x)

    def scores(self, anchors: np.ndarray, packed) -> np.ndarray:
        """The inner products of all ``anchors`` with all packed candidates."""
        wide, sums, n = packed
        biased = anchors - self.low
        if self.fields >= 2:
            total = (biased.astype(np.float64) @ wide).astype(np.int64)
            mask = (1 << self.bits) - 1
            fields = np.concatenate([(total >> (self.bits * j)) & mask for j in range(self.fields)], axis=1)[:, :n]
            return fields + self.low * (anchors.sum(1)[:, None] + sums[None]) - self.width * self.low * self.low
        out = np.empty((len(anchors), n), np.int64)
        fixed = (self.low * sums).tolist()
        for row, anchor in enumerate(biased.tolist()):
            total = sum(a * p for a, p in zip(anchor, wide, strict=True)).to_bytes(n * self.size, "little")
            off = self.low * int(anchors[row].sum()) - self.width * self.low * self.low
            out[row] = [int.from_bytes(total[i * self.size : (i + 1) * self.size], "little") + off + fixed[i] for i in range(n)]
        return out


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the ``k`` largest allowed scores of every row, ties to the smaller place; -1 where there are fewer."""
    n = scores.shape[1]
    k = min(k, n)
    step = 1 << max(1, (n - 1).bit_length())
    if scores.size and max(abs(int(scores.min())), abs(int(scores.max()))) < 2**61 // step:
        both = np.where(allowed, scores * step + (step - 1 - np.arange(n))[None], _NONE)
        top = -np.sort(-np.partition(both, n - k, axis=1)[:, n - k :], axis=1) if k else both[:, :0]
        place = step - 1 - (top & (step - 1))
        none = top == _NONE
    else:
        place = np.argsort(np.where(allowed, -scores, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k]
        none = ~np.take_along_axis(allowed, place, 1)
    place = np.where(none, -1, place)
    return place, np.where(none, 0, np.take_along_axis(scores, np.maximum(place, 0), 1))


@lru_cache(4)
def _anchors(path: str, number: int, packing: tuple):
    """Per worker: one block of anchors as arrays."""
    found = read_block(path, "block", number)
    if found is None:
        return None
    p = Packing(*packing)
    rows = found.to_pydict()
    return rows, p.matrix(rows["v"]), np.array(rows["id"], np.int64), np.array(rows["label"], np.int64)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates in slices of ``SLICE`` rows, by ascending id."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= SLICE:
            yield pd.concat(held).sort_values("id", kind="stable")
            held, n = [], 0
    if n:
        yield pd.concat(held).sort_values("id", kind="stable")


def _hits(batches, path: str, blocks: int, packing: tuple, k: int, windows, same_label: bool) -> Iterator[pd.DataFrame]:
    """(aid, slot, vec_id, score): for every anchor and slot the best ``k`` candidates of each slice.

    ``windows(rows)`` has the slots of a block's anchors as (factor, least, most) arrays, a row per anchor and a column per
    slot; a candidate counts in a slot where least <= factor * score <= most. None: one slot without bounds.
    """
    p = Packing(*packing)
    for part in _slices(batches):
        ids, labels, x = part.id.to_numpy(), part.label.to_numpy(), p.matrix(part.v)
        packed = [p.pack(x[a : a + CHUNK]) for a in range(0, len(x), CHUNK)]
        for number in range(blocks):
            block = _anchors(path, number, packing)
            if block is None:
                continue
            rows, matrix, own, own_label = block
            factor, least, most = windows(rows) if windows else (1, None, None)
            slots = 1 if least is None else least.shape[1]
            kept = [(np.full((len(own), 0), -1), np.zeros((len(own), 0), np.int64)) for _ in range(slots)]
            for c, chunk in enumerate(packed):
                at = c * CHUNK
                held = slice(at, at + chunk[2])
                scores = p.scores(matrix, chunk)
                allowed = (labels[None, held] == own_label[:, None]) == same_label
                if same_label:
                    allowed &= ids[None, held] != own[:, None]
                for s in range(slots):
                    inside = allowed if least is None else allowed & (factor * scores >= least[:, s, None]) & (factor * scores <= most[:, s, None])
                    place, score = best(scores, inside, k)
                    place = np.concatenate([kept[s][0], np.where(place < 0, -1, place + at)], 1)
                    score = np.concatenate([kept[s][1], score], 1)
                    order = np.lexsort((place, -score, place < 0), axis=1)[:, :k]
                    kept[s] = np.take_along_axis(place, order, 1), np.take_along_axis(score, order, 1)
            for s, (place, score) in enumerate(kept):
                row, col = np.nonzero(place >= 0)
                yield pd.DataFrame({"aid": np.array(rows["aid"], np.int64)[row], "slot": np.full(len(row), s, np.int32), "vec_id": ids[place[row, col]], "score": score[row, col]})


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, of: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives.

    ``vectors`` has (id, label, v array<long>), see ``labelled_vectors``; ``is_anchor`` is a condition on ``id``. An anchor's
    positives are the ``positives`` rows of its label and another id with the largest inner products. For each, the
    ``negatives`` best rows of another label come back for which least * positive_score <= of * score <= most * positive_score.
    Ties go to the smaller id everywhere. Repeated rows count once; an id with several vectors or labels takes part with
    each of them. Shorter vectors count as padded with zeros. An anchor without positives, a positive without negatives and an
    empty table give no rows. Scores times ``of`` have to fit a long.
    """
    spark = vectors.sparkSession
    points = staged(vectors.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").distinct(), "points")
    seen = points.select(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if not seen[0]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    packing = (int(seen[1]), int(seen[2] or 0), int(seen[3] or 0))
    asked = staged(points.where(is_anchor).withColumn("aid", F.monotonically_increasing_id()), "asked")
    blocks = -(-max(1, asked.count()) // ANCHOR_BLOCK)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    path = written_blocks(asked, "anchors", "block", blocks)
    kinds = "aid long, slot int, vec_id long, score long"

    first = points.mapInPandas(lambda it: _hits(it, path, blocks, packing, positives, None, True), kinds)
    by_score = [F.desc("score"), "vec_id"]
    rank = F.row_number().over(W.partitionBy("aid").orderBy(*by_score))
    found = staged(first.withColumn("nth", rank).where(F.col("nth") <= positives).drop("slot"), "positives")
    windows = found.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("nth", "score"))).alias("pos"))
    wanted = asked.join(windows, "aid").withColumn("pos", F.transform("pos", lambda x: x.score))
    targets = written_blocks(wanted, "targets", "block", blocks)

    def bounds(rows):
        """Window ends per positive; an anchor with fewer positives has empty windows beyond them."""
        low = np.ones((len(rows["pos"]), positives), np.int64)
        high = np.zeros((len(rows["pos"]), positives), np.int64)
        for i, scores in enumerate(rows["pos"]):
            low[i, : len(scores)], high[i, : len(scores)] = np.array(scores, np.int64) * least, np.array(scores, np.int64) * most
        return of, low, high

    second = points.mapInPandas(lambda it: _hits(it, targets, blocks, packing, negatives, bounds, False), kinds)
    place = F.row_number().over(W.partitionBy("aid", "slot").orderBy(*by_score)).cast("int")
    second = second.withColumn("rank", place).where(F.col("rank") <= negatives)
    named = found.select("aid", (F.col("nth") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = second.join(named, ["aid", "slot"]).join(asked.select("aid", F.col("id").alias("anchor_id")), "aid")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
