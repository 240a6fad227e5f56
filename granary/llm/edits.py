"""Benchmark decontamination: pigeonhole pieces and Myers' bit-parallel edit distance.

With an error budget of k edits, an item cut into k + 1 pieces has at least one piece that stands unchanged in every
text that holds the item within the budget. All pieces form one Aho-Corasick automaton; each document is read once,
a hit has to hold in ever longer stretches of the item, and the window around what is left is verified. Distances come
from Myers' algorithm, which advances all rows of the edit matrix in a few word operations per character. Items are compared in lower case with
runs of white space as one space.

The items are a test set that is small beside the corpus. They are given to the tasks in blocks of at most
``BLOCK_CHARS`` characters; more blocks mean more passes over the documents, not larger tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from granary.llm.common import keep_rows, read_block, slices, staged, text_column, written_blocks

RATE = 0.1
BLOCK_CHARS = 2_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


class Pattern:
    """A stretch of an item: text from ``at``, with as many edits as it has pieces less one."""

    def __init__(self, text: str, at: int, budget: int):
        self.text, self.at, self.budget = text, at, budget
        self.masks: dict[str, int] = {}

    def prepare(self) -> None:
        masks = defaultdict(int)
        for i, c in enumerate(self.text):
            masks[c] |= 1 << i
        self.masks = dict(masks)

    def best(self, window: str) -> tuple[int, int]:
        """The least edit distance of the item to any part of ``window``, and where the first such part ends."""
        if not self.masks:
            self.prepare()
        get, n = self.masks.get, len(self.text)
        full, top = (1 << n) - 1, 1 << (n - 1)
        plus, minus, score = full, 0, n
        least, end = n, 0
        for j, c in enumerate(window, 1):
            eq = get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(xh | plus) & full
            down = plus & xh
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = up << 1 & full  # no | 1: the item may begin anywhere in the window
            down = down << 1 & full
            plus = down | ~(xv | up) & full
            minus = up & xv
            if score < least:
                least, end = score, j
        return least, end


class Item:
    """An item as a binary tree over its pieces.

    A stretch of j pieces has a budget of j - 1 edits. If a text holds it within that, one of its two halves is held
    within its own budget, down to a piece without any edit: so a hit counts only if every stretch above it does.
    """

    def __init__(self, item_id: int, text: str, rate: float):
        self.id = item_id
        n, budget = len(text), int(rate * len(text))
        cuts = [n * i // (budget + 1) for i in range(budget + 2)]
        self.pieces: list[tuple[str, int, list[Pattern]]] = []  # text, place, the stretches above it, lowest first

        def grow(low: int, high: int, above: list[Pattern]) -> None:
            if high - low == 1:
                self.pieces.append((text[cuts[low] : cuts[high]], cuts[low], above))
                return
            here = [Pattern(text[cuts[low] : cuts[high]], cuts[low], high - low - 1), *above]
            middle = (low + high) // 2
            grow(low, middle, here)
            grow(middle, high, here)

        self.whole = Pattern(text, 0, budget)
        grow(0, budget + 1, [])

    def plausible(self, text: str, piece: int, start: int) -> bool:
        """Whether the stretches above a piece hold where the item would begin at ``start``."""
        for p in self.pieces[piece][2][:-1]:
            low = start + p.at - p.budget
            if p.best(text[max(0, low) : start + p.at + len(p.text) + p.budget])[0] > p.budget:
                return False
        return True


class Finder:
    """All items of a block behind one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [Item(i, t, rate) for i, text in items if (t := normal(text))]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, item in enumerate(self.items):
            for j, (piece, _, _) in enumerate(item.pieces):
                where[piece].append((i, j))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def hits(self, text: str, first: bool = False) -> list[tuple[int, int, int]]:
        """(item, distance, end of the best match) per item within its budget; with ``first``, at most one item."""
        if not self.items:
            return []
        text = normal(text)
        diagonals: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(text):
            for i, j in places:
                start = end - size + 1 - self.items[i].pieces[j][1]
                if start not in diagonals[i] and self.items[i].plausible(text, j, start):
                    diagonals[i].add(start)
        out = []
        for i, starts in diagonals.items():
            p = self.items[i].whole
            k, n = p.budget, len(p.text)
            ordered, best = sorted(starts), None
            a = 0
            while a < len(ordered):
                # windows that overlap are one, within a few item lengths
                b = a
                while b + 1 < len(ordered) and ordered[b + 1] - ordered[b] <= 2 * k and ordered[b + 1] - ordered[a] <= 4 * n:
                    b += 1
                low, high = max(0, ordered[a] - k), ordered[b] + n + k
                distance, end = p.best(text[low:high])
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, low + end)
                a = b + 1
            if best:
                out.append((self.items[i].id, *best))
                if first:
                    break
        return out


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> tuple[str, int]:
    """Folder and number of blocks of bounded size, written as files that tasks read one at a time: the driver holds no item.

    Null and blank items match nothing; rows without an id have none to report; repeated items are one.
    """
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_column(text_col).alias("text")).where("id IS NOT NULL AND trim(text) <> ''").distinct()
    items = staged(items, "items")
    count = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)
    part = F.pmod(F.xxhash64("id", "text"), F.lit(max(1, count))).cast("int")
    return written_blocks(items.withColumn("block", part), "item-blocks", "block", max(1, count)), count


def _finder(path: str, number: int, rate: float) -> Finder:
    """Inside a task: the finder of one block."""
    found = read_block(path, "block", number)
    rows = found.to_pydict() if found is not None else {"id": [], "text": []}
    return Finder(list(zip(rows["id"], rows["text"], strict=True)), rate)


def matches(
    docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, item_id, distance, match_end): every item that a document holds within ``rate`` edits per character.

    Distance is the least over the whole document, ``match_end`` the place in the normalised text where that match
    ends. Null and empty texts hold nothing, and texts of any length are read whole. Repeated documents give repeated rows; two
    items with one text both match. Empty tables give no rows.
    """
    kinds = "doc_id long, item_id long, distance int, match_end long"
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    path, count = item_blocks(benchmark, block_chars=block_chars)
    out = docs.sparkSession.createDataFrame([], kinds)
    for number in range(count):

        def run(batches: Iterator[pd.DataFrame], number=number) -> Iterator[pd.DataFrame]:
            finder = _finder(path, number, rate)
            for batch in slices(batches, "text"):
                rows = [(d, *hit) for d, text in zip(batch.doc_id, batch.text, strict=True) for hit in finder.hits(text)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "match_end"]).astype({"doc_id": "Int64"})

        out = out.unionByName(chosen.mapInPandas(run, kinds))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, all columns, that hold no item within ``rate`` edits per character."""
    path, count = item_blocks(benchmark, block_chars=block_chars)
    for number in range(count):
        docs = keep_rows(docs, text_col, _judge(path, number, rate))
    return docs


def _judge(path: str, number: int, rate: float) -> Callable[[], Callable[[list[str]], list[bool]]]:
    def judge() -> Callable[[list[str]], list[bool]]:
        finder = _finder(path, number, rate)
        return lambda texts: [not finder.hits(t, first=True) for t in texts]

    return judge
