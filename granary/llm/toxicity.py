"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

Voters are word lists by language and theme, writing patterns, and word and prefix lists mined from a bounded sample
of labelled training rows; each fires on a text or does not. The label model has the true label as a hidden class with
a firing rate of every voter in each class, estimated by expectation maximisation. Voters that fire together more
often than their class explains are correlated: their correlations inside the classes are estimated, and a voter's evidence is
divided by the number of voters it stands for. The posterior labels train a logistic classifier over words and
prefixes, which scores any text, also those on which no voter fires.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from sys import intern

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from granary.llm.common import keep_rows, slices, text_column

SAMPLE_ROWS = 6000
SAMPLE_CHARS = 200_000
PREFIXES = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")

# fixed values: common insults by theme
_LISTS = {
    "mind_en": "idiot moron stupid dumb dumbass imbecile fool clown retard dimwit halfwit cretin brainless",
    "worth_en": "loser worthless pathetic useless failure nobody trash garbage scum vermin filth",
    "disgust_en": "disgusting repulsive vile gross sickening creep pig rat cockroach parasite",
    "curse_en": "fuck fucking shit bullshit bitch bastard asshole dick cunt whore slut damn crap",
    "threat_en": "kill die hang shoot stab rape murder destroy",
    "fr": "imbécile crétin débile idiot idiote connard connasse salope salaud merde ordure minable abruti pourriture",
    "de": "idiot dummkopf trottel arschloch scheiße scheisse schlampe abschaum drecksau mistkerl wertlos versager",
    "es": "idiota imbécil estúpido estúpida tonto gilipollas mierda puta puto cabrón basura inútil asqueroso patético",
}
_PATTERNS = {
    "you_are": re.compile(r"\b(?:you|u|your|du bist|tu es|eres)\s+(?:are|re|a|an|ein|un|une)?\s*(?:idiot|moron|stupid|loser|clown|trash|scum|pathetic)", re.I),
    "shouted": re.compile(r"\b(?:IDIOT|MORON|STUPID|LOSER|TRASH|SCUM|CLOWN|PATHETIC)\b"),
    "masked": re.compile(r"\b[a-z]+[*@$]{2,}[a-z]+\b", re.I),
    "shut_up": re.compile(r"\b(?:shut up|go away|get lost|ta gueule|halt die klappe|cállate)\b", re.I),
}


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def units(found: set[str]) -> Counter:
    """Words and word beginnings, each with the number of distinct words that have it."""
    out = Counter(map(intern, found))  # rows of the sample share their strings
    for word in found:
        for n in PREFIXES:
            if len(word) > n:
                out[intern(word[:n] + "*")] += 1
    return out


@dataclass(frozen=True)
class Toxicity:
    """A linear classifier: the score of a text is logistic(bias + sum of its distinct words' weights)."""

    bias: float
    weights: dict[str, float]

    def of_word(self, word: str) -> float:
        get = self.weights.get
        return get(word, 0.0) + sum(get(word[:n] + "*", 0.0) for n in PREFIXES if len(word) > n)

    def scorer(self) -> Callable[[str], float]:
        known: dict[str, float] = {}

        def score(text: str) -> float:
            total = self.bias
            if len(known) > 500_000:
                known.clear()
            for word in words(text):
                w = known.get(word)
                if w is None:
                    w = known[word] = self.of_word(word)
                total += w
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

        return score


@dataclass(frozen=True)
class LabelModel:
    """Firing rates by class, the class share, and how many voters each voter stands for."""

    toxic: np.ndarray
    clean: np.ndarray
    share: float
    stands_for: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fired = np.log(self.toxic / self.clean) / self.stands_for
        silent = np.log((1 - self.toxic) / (1 - self.clean)) / self.stands_for
        logit = math.log(self.share / (1 - self.share)) + votes @ fired + (1 - votes) @ silent
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def label_model(votes: np.ndarray, share: float, rounds: int = 25, linked: float = 0.25) -> LabelModel:
    """Expectation maximisation over 0/1 ``votes`` (rows x voters), with the class share given.

    It starts from the ``share`` of rows with the most votes, where voters that almost repeat each other count once.
    A second run uses correlations left inside the classes: for a pair of voters, the classes come from all others.
    """
    with np.errstate(divide="ignore", invalid="ignore"):  # a voter that never fires has no correlation
        raw = np.nan_to_num(np.atleast_2d(np.corrcoef(votes.T))) if len(votes) > 1 else np.eye(votes.shape[1])
    stands_for = _tied(raw, 0.8)
    model = _maximise(votes, share, stands_for, rounds)
    return _maximise(votes, share, _tied(_residual_correlation(votes, model), linked), rounds)


def _tied(correlation: np.ndarray, least: float) -> np.ndarray:
    tied = np.where(correlation > least, correlation, 0)
    np.fill_diagonal(tied, 1)
    return tied.sum(1)


def _maximise(votes: np.ndarray, share: float, stands_for: np.ndarray, rounds: int) -> LabelModel:
    weighted = votes @ (1 / stands_for)
    posterior = np.where((weighted > 0) & (weighted >= np.quantile(weighted, 1 - share)), 0.9, 0.02)
    for _ in range(rounds):
        # a prior of two rows keeps rates off 0 and 1; voters are taken to be better than chance
        toxic = (posterior @ votes + 0.2) / (posterior.sum() + 2)
        clean = ((1 - posterior) @ votes + 0.02) / ((1 - posterior).sum() + 2)
        model = LabelModel(np.clip(np.maximum(toxic, 1.5 * clean), 1e-4, 0.999), np.clip(clean, 1e-5, 0.6), share, stands_for)
        posterior = model.posterior(votes)
    return model


def _residual_correlation(votes: np.ndarray, model: LabelModel) -> np.ndarray:
    """Correlation of each pair of voters inside the classes that the other voters give."""
    evidence = np.where(votes > 0, np.log(model.toxic / model.clean), np.log((1 - model.toxic) / (1 - model.clean))) / model.stands_for
    total = math.log(model.share / (1 - model.share)) + evidence.sum(1)
    k = votes.shape[1]
    out = np.eye(k)
    for i in range(k):
        for j in range(i):
            p = 1 / (1 + np.exp(-np.clip(total - evidence[:, i] - evidence[:, j], -30, 30)))
            a, b = (votes[:, v] - (p @ votes[:, v] / (p.sum() + 1e-9)) * p - ((1 - p) @ votes[:, v] / ((1 - p).sum() + 1e-9)) * (1 - p) for v in (i, j))
            out[i, j] = out[j, i] = (a @ b) / (math.sqrt((a @ a) * (b @ b)) + 1e-9)
    return out


def mine(rows: list[Counter], labels: np.ndarray, least: int = 4, z: float = 4.0) -> list[str]:
    """Words and prefixes whose share of toxic rows exceeds that of clean ones by ``z`` standard errors of the log odds."""
    n = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    counts = [Counter(), Counter()]
    for row, y in zip(rows, labels, strict=True):
        counts[y].update(row.keys())
    out = []
    for unit, b in counts[1].items():
        a = counts[0][unit]
        if b >= least:
            odds = math.log((b + 0.5) / (n[1] - b + 0.5)) - math.log((a + 0.5) / (n[0] - a + 0.5))
            error = math.sqrt(1 / (b + 0.5) + 1 / (a + 0.5))
            if odds > 2 and odds / error > z / 2 and b / (a + b) > 0.5:
                out.append(unit)
    return sorted(out)


def vote(texts: list[str], rows: list[Counter], mined: list[str]) -> tuple[np.ndarray, list[str]]:
    """The votes of all voters; mined lists are dealt to voters by kind and hash, to see them agree."""
    lists = {name: set(x.split()) for name, x in _LISTS.items()}
    for i, unit in enumerate(mined):
        kind = f"prefix{len(unit) - 1}" if unit.endswith("*") else "word"
        lists.setdefault(f"mined_{kind}_{i % 3}", set()).add(unit)
    names = [*lists, *_PATTERNS]
    out = np.zeros((len(texts), len(names)))
    for i, (text, row) in enumerate(zip(texts, rows, strict=True)):
        out[i, : len(lists)] = [not found.isdisjoint(row) for found in lists.values()]
        out[i, len(lists) :] = [p.search(text) is not None for p in _PATTERNS.values()]
    return out, names


def fit(texts: list[str], labels: np.ndarray) -> Toxicity:
    """The classifier from labelled texts; without both classes, the bias alone says how common the label is."""
    labels = np.asarray(labels, int)
    share = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.01
    if len(set(labels.tolist())) < 2:
        return Toxicity(math.log(share / (1 - share)), {})
    rows = [units(words(t)) for t in texts]
    votes, _ = vote(texts, rows, mine(rows, labels))
    posterior = label_model(votes, share).posterior(votes)
    # units that the posterior labels tell apart, either way
    heavy, light = Counter(), Counter()
    for row, p in zip(rows, posterior, strict=True):
        for unit in row:
            heavy[unit] += p
            light[unit] += 1 - p
    total = posterior.sum(), len(rows) - posterior.sum()
    chosen = []
    for unit, b in heavy.items():
        a = light[unit]
        if a + b >= 4:
            odds = math.log((b + 0.5) / (total[0] - b + 0.5)) - math.log((a + 0.5) / (total[1] - a + 0.5))
            if abs(odds) / math.sqrt(1 / (b + 0.5) + 1 / (a + 0.5)) > 3 and odds > 1:
                chosen.append(unit)
    slot = {unit: i for i, unit in enumerate(sorted(chosen))}
    row = np.repeat(np.arange(len(rows)), [sum(u in slot for u in r) for r in rows])
    col = np.array([slot[u] for r in rows for u in r if u in slot], np.int64)
    val = np.array([r[u] for r in rows for u in r if u in slot], float)
    theta = np.append(np.zeros(len(slot)), math.log(share / (1 - share)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, 401):
        s = np.bincount(row, val * theta[col], len(rows)) + theta[-1]
        gap = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - posterior
        grad = np.append(np.bincount(col, val * gap[row], len(slot)) + 0.3 * theta[:-1], gap.sum()) / len(rows)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Toxicity(float(theta[-1]), {unit: float(theta[i]) for unit, i in slot.items() if abs(theta[i]) > 1e-3})


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learnt from: crc32 of the id as text is a multiple of 5."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Toxicity:
    """Fit on at most ``sample_rows`` labelled training ids, those with the lowest hash; texts over ``sample_chars`` are not learnt from.

    Held-out rows, null ids and null labels are left out; an id labelled twice counts with its larger label.
    """
    known = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(f"`{id_col}`").cast("long").alias("known")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("known"), "known").limit(sample_rows)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("known"), text_column(text_col).alias("text"))
    sample = texts.where(F.length("text") <= sample_chars).join(F.broadcast(chosen), "known")
    rows = sample.orderBy("known", "text").limit(2 * sample_rows).toLocalIterator()
    texts_, labels_ = [], []
    for r in rows:
        texts_.append(r.text)
        labels_.append(r.label)
    return fit(texts_, np.array(labels_, int))


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row. Null and empty texts get the score of a text without any word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = model.scorer()
        for batch in slices(batches, "text"):
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "held_out": batch.held_out, "score": [of(t) for t in batch.text]})

    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), text_column(text_col).alias("text"))
    scored = chosen.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Toxicity, below: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, all columns, that score less than ``below``."""

    def judge() -> Callable[[list[str]], list[bool]]:
        of = model.scorer()
        return lambda texts: [of(t) < below for t in texts]

    return keep_rows(docs, text_col, judge)
