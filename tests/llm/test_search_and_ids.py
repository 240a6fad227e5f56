"""Top-k search, token shards and BPE against brute force and the libraries they follow."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from granary.llm import bpe, chunks, eliasfano, mtree

BASE = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "",
    "plain words, and more words.\nA new line",
    "  two  spaces   three \n\n lines \n",
    " leading",
    "trailing ",
    "aaaa" * 400 + " bbbb",
    "it's I'LL we've 123456 ³½",
    "日本語 テキスト 🙂🙂 é",
    "a b  c\x1cd\x85e",
    "<|endoftext|> word",
    "x" * 5000,
    "word, word. word! (word) \"word\" word's",
]


def brute(rows, k):
    out = set()
    clean = {(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for i, v in clean:
        if i % 50:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in clean if j != i))[:k]
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)}
    return out


def search(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, v int")if rows and len(rows[0]) == 4 else spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = mtree.top_k(mtree.integer_vectors(df, "vec_id", "embedding"), F.col("id") % 50 == 0, **sizes)
    return {tuple(r) for r in found.collect()}


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(400 + i, rows[50][1]) for i in range(60)]  # copies of one vector
    rows += [(900, None), (901, [float("nan")] * 6), (902, [1.0, None, 0, 0, 0, 0]), (None, [0.0] * 6), rows[3], (950, [0.0] * 6), (951, [float("inf")] * 6)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert search(spark, rows, k=5, page=8, tree_rows=64) == brute(rows, 5)


def test_blocks_and_trees_are_read_in_bounded_pieces(spark, monkeypatch):
    import pandas as pd

    space = mtree.Space(4, 4.0, True)
    routed = list(mtree._route(iter([pd.DataFrame({"v": [[i % 7, 1, 0, 1] for i in range(3000)]})]), space, np.ones((1000, 4))))
    assert max(map(len, routed)) <= 1000 and sum(map(len, routed)) == 3000
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 3)
    monkeypatch.setattr(mtree, "TREES", 2)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(0, 600, 2)]
    assert search(spark, rows, k=3, page=8, tree_rows=24) == brute(rows, 3)


def test_top_k_of_few_and_none(spark):
    assert search(spark, [(0, [1.0, 2.0]), (1, [1.0, 1.0])], k=5) == brute([(0, [1.0, 2.0]), (1, [1.0, 1.0])], 5)
    assert search(spark, [], k=5) == set()
    clash = [(0, [1.0], "a", 1), (2, [3.0], "b", 2), (50, [3.0], None, None)]
    assert search(spark, clash, k=1) == {(0, 1, 2, 196608), (50, 1, 2, 589824)}


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    with open(BASE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n):
    dice = random.Random(3)
    alphabet = ["a", "the", " ", "  ", "\n", "ing", ".", ",", "'s", "é", "日", "7", "\t", "!", " ", " x", "\n\n"]
    return ["".join(dice.choice(alphabet) for _ in range(dice.randint(1, 60))) for _ in range(n)]


def test_bpe_equals_the_library(tiktoken_encoding):
    ranks, memory = bpe._encoder(BASE, public_tokenizers.PATTERN)
    texts = TEXTS + random_texts(500)
    got = [np.frombuffer(x, "<u4") for x in memory.batch(texts)]
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == tiktoken_encoding.encode_ordinary(text), repr(text)
        assert ranks.decode(ids) == text.encode()


def test_memory_forgets_without_changing_ids(tiktoken_encoding):
    _, memory = bpe._encoder(BASE, public_tokenizers.PATTERN)
    small = chunks.Memory(memory.encode, most=5)
    for _ in range(3):
        for text in TEXTS:
            [ids] = small.batch([text])
            assert np.frombuffer(ids, "<u4").tolist() == tiktoken_encoding.encode_ordinary(text)


def test_bpe_rows(spark, documents, tiktoken_encoding):
    found = bpe.encode_decode(documents, BASE, public_tokenizers.PATTERN).collect()
    want = [(r.doc_id, tiktoken_encoding.encode_ordinary(r.text or ""), r.text or "") for r in documents.collect()]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in found) == sorted(
        (str(i), len(t), hashlib.sha256(np.array(t, "<u4").tobytes()).hexdigest(), hashlib.sha256(x.encode()).hexdigest(), t) for i, t, x in want
    )
    assert bpe.encode_decode(documents.limit(0), BASE, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("step", [0, 1, 3, 700, 10**6])
def test_elias_fano_round_trip(step, tmp_path):
    import pyarrow.fs as pafs

    dice = np.random.default_rng(step)
    values = np.cumsum(dice.integers(0, step + 1, 3000))
    path = tmp_path / "sequence"
    path.write_bytes(b"12345" + eliasfano.pack(values))
    sequence = eliasfano.Sequence(pafs.LocalFileSystem().open_input_file(str(path)), 5)
    assert sequence.n == len(values)
    for a, b in [(0, 3000), (0, 1), (2999, 3000), (255, 257), (256, 512), (1000, 1700), (5, 5)]:
        assert sequence.select(a, b).tolist() == values[a:b].tolist()


@pytest.mark.parametrize("special", [False, True])
def test_shards(spark, documents, special):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = tokenizers.Tokenizer.from_file(path)
    own.encode_special_tokens = special
    odd = ["a b<|endoftext|>c", "<|endoftext|>", "x <|endoftext|>, y", "x\n<|endoftext|>\ny z", "a  <|endoftext|>  b <|endoftext|><|endoftext|> c", "word<|endoftext|", "<|endoftext|>. <|endoftext|>) end"]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(TEXTS + odd + random_texts(300))], "doc_id long, text string")
    docs = documents.select("doc_id", "text", "id", "n").unionByName(extra, allowMissingColumns=True)
    got = eliasfano.read_shards(eliasfano.write_shards(docs, path, end_id=2, special_as_text=special)).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or ""), r.doc_id, own.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    got = sorted(got, key=lambda r: r.start)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(t) + 1, zlib.crc32(np.array([*t, 2], "<u4").tobytes())) for _, i, t in rows]
    assert eliasfano.read_shards(eliasfano.write_shards(documents.limit(0), path, end_id=2)).count() == 0
