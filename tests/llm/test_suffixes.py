"""Removal of repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from granary.llm import suffixes


def brute(docs, length):
    first = {}
    coded = [(d, (t or "").encode()) for d, t in docs]
    for d, t in coded:
        if d is not None:
            for i in range(len(t) - length + 1):
                s = t[i : i + length]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, t in coded:
        gone = bytearray(len(t))
        if d is not None:
            for i in range(len(t) - length + 1):
                if first[t[i : i + length]] < d:
                    gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def removed(spark, docs, length, **sizes):
    df = spark.createDataFrame([(t, d, "x", 1) for d, t in docs], "text string, doc_id long, bucket string, no int").repartition(3)
    rows = suffixes.without_repeats(df, length, **sizes).collect()
    for r in rows:
        assert r.n_bytes == len(r.kept) + sum(b - a for a, b in zip(r.starts, r.ends, strict=True))
    return sorted(((r.doc_id, r.n_bytes, sum(b - a for a, b in zip(r.starts, r.ends, strict=True)), len(r.starts), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gämma", "δ", "of", "the", "x" * 30, "日本"]
    passages = [" ".join(rng.choices(words, k=30)) for _ in range(4)]
    docs = []
    for i in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        docs.append((rng.randint(-20, 200), "|".join(parts)))
    docs += [docs[3], docs[4], (500, docs[4][1]), (501, docs[4][1][7:-9]), (502, "a" * 9000), (503, "a" * 4000 + "b"), (504, "ab" * 3000)]
    return docs + [(None, docs[5][1]), (None, None), (505, None), (506, ""), (507, "a" * 49), (508, "a" * 50), (509, "\0" * 200), (510, "\0\1" * 90)]


@pytest.mark.parametrize("sizes", [{}, {"hot": 2, "bucket_bytes": 3000, "block_bytes": 4000}])
def test_repeats_are_removed_as_by_brute_force(spark, sizes):
    docs = corpus(1)
    assert removed(spark, docs, 50, **sizes) == brute(docs, 50)
    assert removed(spark, docs, 13, **sizes) == brute(docs, 13)


def test_long_documents_cross_segments(spark, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdef ", k=2_300_000))
    docs = [(1, text[:1_999_999]), (2, text[600_000:] + "end"), (3, text[5:70])]
    rows = {r[0]: r for r in removed(spark, docs, 50)}
    assert rows[1][2:4] == (0, 0) and rows[3][2:4] == (65, 1)
    assert rows[2][2:4] == (1_399_999, 1)


def test_no_documents(spark):
    assert removed(spark, [], 50) == []
    assert removed(spark, [(1, None)], 50) == brute([(1, None)], 50)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=60) | st.text("ab", min_size=1, max_size=60).map(str.encode), min_size=1, max_size=12), st.integers(1, 20))
def test_suffixes_are_sorted_to_their_depth(texts, depth):
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    joined = b"\0".join([*texts, b""])
    order = suffixes.suffix_order(np.frombuffer(joined, np.uint8), begin + sizes, depth)
    assert sorted(order.tolist()) == list(range(len(joined)))
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    heads = [tuple(x + 1 for x in joined[i : begin[owner[i]] + sizes[owner[i]]][:depth]) for i in order.tolist()]
    whole = [(h, i) for h, i in zip(heads, order.tolist(), strict=True) if len(h) == depth]
    assert [h for h, _ in whole] == sorted(h for h, _ in whole)
    lcp = suffixes.common_prefixes(joined + bytes(depth + 8), np.array([i for _, i in whole], np.int64), depth) if whole else []
    for (a, _), (b, _), n in zip(whole, whole[1:], lcp[1:], strict=False):
        assert n == next((k for k in range(depth) if a[k] != b[k]), depth)
