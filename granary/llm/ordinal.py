"""Quality by ordinal regression on graded ratings: a cumulative-link model over hashed text features.

One weight vector is shared by all grades, and ordered thresholds cut the score: P(grade <= k) = logistic(t_k - w.x).
From it come the expected grade and the tail probability P(grade >= g) that selection uses. Features are hashed: short
words, word endings and shapes by their share of the text, and text statistics (repetition, symbols, capitals,
lengths) in steps. The model is fitted on at most ``sample_rows`` rated documents, those with the lowest hash of their
id, so the choice does not depend on the size of the table; every document is scored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from granary.llm.common import keep_rows, slices, text_column

BITS = 12
SAMPLE_ROWS = 8192
_EDGES = np.array([0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def features(text: str) -> dict[int, float]:
    """Hashed features of a whole text; an empty one has a feature of its own."""
    sequence = text.split()
    counts = Counter(sequence)
    n = sum(counts.values())
    if not n:
        return {_slot("empty"): 1.0}
    out: dict[int, float] = {}
    shares: Counter = Counter()
    marks = odd = shouted = 0
    for word, c in counts.items():
        last = word[-1]
        if last.isalnum():
            if len(word) <= 4:
                shares["w" + word.lower()] += c
        else:
            tail = word[-2:]
            shares["e" + (tail if not tail[0].isalnum() else last)] += c
            marks += c
            odd += c * (not word.isalpha() and len(word) > 1 and not word[-2].isalnum())
        if word.isupper() and len(word) > 2:
            shouted += c
    twice = sum(map(eq, sequence, sequence[1:])) / n
    repeated = 1 - len(set(zip(sequence, sequence[1:], strict=False))) / (n - 1) if n > 1 else 0.0
    lines = [x for x in text.split("\n") if x.strip()]
    stats = {
        "twice": twice,
        "repeated": repeated,
        "distinct": len(counts) / n,
        "marks": marks / n,
        "odd": odd / n,
        "shouted": shouted / n,
        "lines": 1 - len(set(lines)) / len(lines),
        "lone": sum(c for w, c in counts.items() if len(w) == 1 and not w.isalnum()) / n,
    }
    for name, value in stats.items():
        for step in np.flatnonzero(value > _EDGES):  # one feature for every step reached
            out[_slot(f"{name}>{step}")] = 1.0
    out[_slot(f"size{int(math.log2(n))}")] = 1.0
    out[_slot(f"length{min(20, sum(map(len, counts)) // len(counts))}")] = 1.0
    for name, c in shares.items():
        slot = _slot(name)
        out[slot] = out.get(slot, 0.0) + math.sqrt(c / n)
    return out


@dataclass(frozen=True)
class Ordinal:
    """Weights and thresholds; ``grades`` are the rating values in ascending order."""

    weights: np.ndarray
    cuts: np.ndarray
    grades: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade) by row."""
        below = _logistic(self.cuts[None] - np.asarray(score, float)[:, None])
        return np.diff(np.hstack([np.zeros((len(below), 1)), below, np.ones((len(below), 1))]), axis=1)

    def score(self, text: str) -> float:
        found = features(text)
        return float(self.weights[list(found)] @ np.array(list(found.values())))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[dict[int, float]], ratings: np.ndarray, penalty: float = 1.0, steps: int = 400, rate: float = 0.05) -> Ordinal:
    """Maximum penalised likelihood by Adam on all rows; one grade or none gives a model without weights."""
    grades, y = np.unique(ratings, return_inverse=True)
    size = 1 << BITS
    if len(grades) < 2:
        return Ordinal(np.zeros(size), np.zeros(0), grades if len(grades) else np.array([1]))
    n, k = len(rows), len(grades)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.array([i for r in rows for i in r], np.int64)
    val = np.array([v for r in rows for v in r.values()])
    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / n
    start = np.log(share / (1 - share))
    # thresholds as the first one and logarithms of the gaps keep their order
    theta = np.concatenate([np.zeros(size), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        cuts = theta[size] + np.concatenate([[0], np.cumsum(np.exp(theta[size + 1 :]))])
        s = np.bincount(row, val * theta[col], n)
        padded = np.concatenate([[-np.inf], cuts, [np.inf]])
        high, low = _logistic(np.clip(padded[y + 1] - s, -40, 40)), _logistic(np.clip(padded[y] - s, -40, 40))
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        grad_cut = np.bincount(y, -dh, k)[: k - 1] + np.bincount(y, dl, k)[1:]
        grad = np.zeros_like(theta)
        grad[:size] = np.bincount(col, val * (dh - dl)[row], size) + penalty * theta[:size]
        tail = np.cumsum(grad_cut[::-1])[::-1]
        grad[size] = tail[0]
        grad[size + 1 :] = tail[1:] * np.exp(theta[size + 1 :])
        grad /= n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Ordinal(theta[:size], theta[size] + np.concatenate([[0], np.cumsum(np.exp(theta[size + 1 :]))]), grades)


def train(docs: DataFrame, ratings: DataFrame, grade_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Ordinal:
    """Fit on at most ``sample_rows`` rated ids. Null ids and grades do not count; an id rated twice has the mean, rounded down."""
    grade = F.floor(F.avg(F.col(f"`{grade_col}`").cast("double"))).cast("int").alias("grade")
    known = ratings.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{grade_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("rated")).agg(grade)
    chosen = known.orderBy(F.xxhash64("rated"), "rated").limit(sample_rows)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("rated"), text_column(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, "text"):
            found = [features(t) for t in batch.text]
            yield pd.DataFrame({"rated": batch.rated, "grade": batch.grade, "slots": [list(f) for f in found], "amounts": [list(f.values()) for f in found]})

    sample = texts.join(F.broadcast(chosen), "rated").mapInPandas(run, "rated long, grade int, slots array<int>, amounts array<double>")
    rows = sample.orderBy("rated").limit(2 * sample_rows).collect()
    return fit([dict(zip(r.slots, r.amounts, strict=True)) for r in rows], np.array([r.grade for r in rows]))


def score(docs: DataFrame, model: Ordinal, at_least: int | None = None, keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail, keep) per row: ``tail`` is P(grade >= ``at_least``), the highest grade by default.

    Null is the empty text; repeated rows are scored each. With one known grade only, every row gets it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, "text"):
            p = model.probabilities([model.score(t) for t in batch.text])
            tail = _tail(model, p, at_least)
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "expected_grade": p @ model.grades, "tail": tail, "keep": tail >= keep_from})

    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    return chosen.mapInPandas(run, "doc_id long, expected_grade double, tail double, keep boolean")


def _tail(model: Ordinal, p: np.ndarray, at_least: int | None) -> np.ndarray:
    wanted = model.grades >= (model.grades[-1] if at_least is None else at_least)
    return p[:, wanted].sum(1)


def select(docs: DataFrame, model: Ordinal, at_least: int | None = None, keep_from: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose tail probability is at least ``keep_from``."""

    def judge() -> Callable[[list[str]], list[bool]]:
        return lambda texts: list(map(bool, _tail(model, model.probabilities([model.score(t) for t in texts]), at_least) >= keep_from))

    return keep_rows(docs, text_col, judge)
