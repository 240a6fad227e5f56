"""Ranked lexical search and hard negatives against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from granary.llm import balltree, negatives

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def ranked(docs, items, k):
    found = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    full = [(d, c, sum(c.values())) for d, c in found if c]
    n_docs, n_terms = len(full), sum(n for _, _, n in full)
    df = Counter(w for _, c, _ in full for w in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c, n in full:
            m = 10 + 90 * n * n_docs // n_terms
            own = set(TERM.findall((text or "").translate(LOWER)))
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in own if c[w])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def search(spark, docs, items, **sizes):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, item_id string")
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    return sorted([tuple(r) for r in balltree.top_documents(d, q, **sizes).collect()], key=repr)


def test_ranking_is_that_of_all_scores(spark, monkeypatch):
    monkeypatch.setattr(balltree, "ITEM_ROWS", 7)  # several blocks of items
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "éa", "x9", "Ab"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)]  # copies tie
    docs += [docs[7], (None, docs[7][1]), (2000, None), (2001, ""), (2002, " \x00.,"), (2003, "w1 " * 300_000), (2004, "W1-w2_w3\x7fw4")]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(20)] + [(50, None), (51, ""), (52, "unknown"), (53, "w1 W1"), (53, "w1 W1"), (None, "w2 w3")]
    assert search(spark, docs, items, k=10, tree_docs=128) == ranked(docs, items, 10)


def test_ranking_of_empty_tables(spark):
    assert search(spark, [], [(1, "a")]) == [] == search(spark, [(1, "a")], [])
    assert search(spark, [(1, None)], [(1, "a")]) == []


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 200), st.integers(1, 30))
def test_bounds_hold_below_every_node(seed, n, width):
    rng = np.random.default_rng(seed)
    dense = rng.integers(0, 1_000_000, (n, width)) * (rng.random((n, width)) < 0.4)
    dense[:, 0] += 1
    row, ids = np.nonzero(dense)
    sizes = np.bincount(row, minlength=n)
    tree = balltree.Tree(np.cumsum(sizes) - sizes, ids, dense[row, ids], width, leaf=4)
    queries = rng.integers(0, 20_000, (width, 3))
    upper, score = tree.upper(queries.astype(float)), dense @ queries
    assert sorted(np.concatenate([rows for rows, below in tree.rows if below is None]).tolist()) == list(range(n))
    for at, (rows, _) in enumerate(tree.rows):
        if rows is not None:
            assert (score[rows] <= upper[at]).all()
    for i in range(3):
        best = []
        tree.search(np.ascontiguousarray(queries[:, i]), upper[:, i], np.arange(n), best, 5)
        assert sorted(best, reverse=True) == sorted(((int(s), -j) for j, s in enumerate(score[:, i]) if s > 0), reverse=True)[:5]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 70), st.sampled_from([0, 1, 5, 300, 10**6, 10**8]))
def test_packed_products_are_exact(seed, width, largest):
    rng = np.random.default_rng(seed)
    x, a = rng.integers(-largest, largest + 1, (9, width)), rng.integers(-largest, largest + 1, (4, width))
    both = np.vstack([x, a])
    packing = negatives.Packing(width, int(both.min()), int(both.max()))
    assert (packing.scores(a, packing.pack(x)) == a @ x.T).all()


def mined(rows, positives=5, negatives_=3):
    clean = {(i, y, tuple(math.floor(256 * float(x)) for x in v)) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, y, v in clean:
        if i % 50:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, z, w in clean]
        pos = sorted((s, j) for s, j, z in scores if z == y and j != i)[:positives]
        for p, j in pos:
            fit = sorted((s, n) for s, n, z in scores if z != y and -50 * p <= -100 * s <= -95 * p)[:negatives_]
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def mine(spark, rows):
    df = spark.createDataFrame([(i, y, v, "x", 1) for i, y, v in rows], "vec_id long, label int, embedding array<float>, id string, slot int")
    vectors = negatives.labelled_vectors(df, "vec_id", F.col("label"), "embedding")
    return sorted(tuple(r) for r in negatives.hard_negatives(vectors, F.col("id") % 50 == 0).collect())


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_hard_negatives_are_those_of_all_pairs(spark, scale, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(negatives, "CHUNK", 32)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 6))
    rows = [(i, int(rng.integers(0, 3)), [float(np.float32(x * scale)) for x in rng.normal(size=6) * 0.5 + centres[i % 3]]) for i in range(400)]
    rows += [(500 + i, 1, rows[3][2]) for i in range(20)] + [(600 + i, 2, rows[3][2]) for i in range(20)]  # ties on both sides
    rows += [rows[50], rows[51], (700, None, rows[1][2]), (701, 1, None), (702, 1, [None] * 6), (703, 2, [float("nan")] * 6), (None, 1, rows[1][2]), (750, 9, rows[0][2])]
    assert mine(spark, rows) == mined(rows)


def test_hard_negatives_of_few_and_none(spark):
    assert mine(spark, []) == []
    assert mine(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0]), (2, 2, [0.75]), (3, 2, []), (50, 3, [1.0])]
    assert mine(spark, rows) == mined(rows)
