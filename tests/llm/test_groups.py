"""Near-duplicate groups against all pairs, and the pipeline."""

import random
import re

import pytest
from pyspark.sql import functions as F

from granary.llm import jaccard

FOLDER = "/root/testdata/sf0.001"


def brute(rows, size, num, den):
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append((i, frozenset(tuple(words[j : j + size]) for j in range(max(1, len(words) - size + 1))) if words else frozenset()))
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and None not in (sets[a][0], sets[b][0]) and den * len(x & y) >= num * len(x | y) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(sets, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted((str(i), len(s), str(None if i is None else least[g])) for (i, s), g in zip(sets, group, strict=True))


def made(spark, rows, size, num, den, **limits):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, e int, region string").repartition(3)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.components(df, size, num, den, **limits).collect())


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80), (2, 60)])
def test_groups_equal_all_pairs(spark, size, num):
    dice = random.Random(size)
    vocabulary = [f"w{i}" for i in range(25)] + ["É", "Big"]
    bases = [[dice.choice(vocabulary) for _ in range(dice.choice([2, 6, 15, 40, 110]))] for _ in range(25)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one"), (None, "one"), (1006, "long " * 9000)]
    for i in range(350):
        words = list(dice.choice(bases))
        for _ in range(dice.choice([0, 0, 1, 1, 2, 4])):
            words[dice.randrange(len(words))] = dice.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows.append(rows[20])
    assert made(spark, rows, size, num, 100) == brute(rows, size, num, 100)


def near_copies(dice, groups, each, changes):
    rows = []
    for g in range(groups):
        base = [f"w{g % 2}-{j % 60 if g < 2 else j}" for j in range(70)]
        for _ in range(each):
            words = list(base)
            for _ in range(dice.choice(changes)):
                words[dice.randrange(70)] = f"n{dice.randrange(1000)}"
            rows.append((len(rows), " ".join(words)))
    return rows


LIMITS = {"cell_rows": 8, "cell_shingles": 500}


@pytest.mark.parametrize(("num", "changes"), [(90, [1, 2, 3, 5]), (30, [0, 10, 20, 40])])
def test_large_cells_recur(spark, monkeypatch, num, changes):
    monkeypatch.setattr(jaccard, "FEW", 2)
    rows = near_copies(random.Random(9), 4, 40, changes)
    assert made(spark, rows, 3, num, 100, **LIMITS) == brute(rows, 3, num, 100)


@pytest.mark.parametrize(("limits", "num", "changes"), [({}, 90, [0, 0, 1, 1, 2, 3]), (LIMITS, 90, [0, 0, 1, 1, 2, 3]), (LIMITS, 40, [0, 10, 20, 40])])
def test_every_link_is_counted(spark, monkeypatch, limits, num, changes):
    monkeypatch.setattr(jaccard, "FEW", 2)
    rows = [(1000, None), (1001, ""), (1002, "one"), (None, "one"), (1003, "ONE"), (1003, "one"), *near_copies(random.Random(5), 4, 40, changes)]
    sets = [frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))) if (w := (t or "").lower().split()) else frozenset() for _, t in rows]
    link = lambda a, b: bool(sets[a]) and a != b and None not in (rows[a][0], rows[b][0]) and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    want = sorted((str(rows[a][0]), sum(link(a, b) for b in range(len(rows)))) for a in range(len(rows)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.components(df, 3, num, 100, count_links=True, **limits).collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == want
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 3, num, 100)


def test_pivots_cut_cells_and_guests_keep_every_pair():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([rng.choice(30, 28, replace=False) + 200 * (i % 4), rng.choice(2000, 2) + 1000])).astype(np.uint64) for i in range(200)]
    members = pd.DataFrame({"cell": 5, "e": np.arange(200) + 1, "mask": 0, "held": 1, "n": [len(s) for s in sets], "s": [s.tobytes() for s in sets], "salt": 0})
    seeds = pd.DataFrame({"seeds": [[{"e": int(i) + 1, "s": sets[i].tobytes()} for i in range(8)]], "cuts": [True]})
    cut = jaccard._split(members, seeds, 80, 100, 0, False)
    assert cut.cell.nunique() >= 4 and not cut.stuck.any()
    link = jaccard._verified(sets, np.zeros(200, int), np.zeros(200, int), 80, 100)
    met = {(x, y) for _, c in cut.groupby("cell") for x, m in zip(c.e, c["mask"], strict=True) for y, k in zip(c.e, c["mask"], strict=True) if x < y and not m & k}
    assert {(a + 1, b + 1) for a, b in zip(*np.nonzero(link), strict=True) if a < b} <= met
    assert len(met) < 200 * 199 / 2 / 2


@pytest.mark.parametrize("num", [10, 30, 50, 60, 65, 80, 90])
def test_sizes_that_can_link_share_a_class(num):
    classes = jaccard.Classes(num, 100)
    of = {n: set(classes.of(n)) for n in range(1, 201)}
    # without a budget of differences only equal sets link, and those are one entry
    apart = [(a, b) for a in of for b in range(a + 1, 201) if a * 100 >= num * b and not of[a] & of[b]]
    assert apart == []


def test_no_groups(spark):
    assert made(spark, [], 3, 90, 100) == []
    assert made(spark, [(1, "a b c d")], 3, 90, 100) == [("1", 2, "1")]


def test_copies_in_other_blocks_share_no_regions(spark, monkeypatch):
    kept, write = {}, jaccard.staged
    monkeypatch.setattr(jaccard, "staged", lambda df, name: kept.update({name: (out := write(df, name))}) or out)
    texts = [" ".join(f"{k}-{j}" for j in range(40)) for k in range(30)]
    rows = [(100 * c + k, t) for c in range(4) for k, t in enumerate(texts)]
    assert made(spark, rows, 3, 90, 100, block_bytes=1500) == brute(rows, 3, 90, 100)
    marks = kept["marks"].collect()
    assert len(marks) > 4 and sum(jaccard.zstandard.decompress(r.marks).count(0) for r in marks) > 30
    assert all(set(jaccard.zstandard.decompress(r.marks)) == {0} for r in marks)


def test_regions_of_the_same_blocks_meet_in_one_task():
    import numpy as np
    import pandas as pd

    keys = np.sort(jaccard.mix(np.arange(300, dtype=np.uint64)))
    pdf = pd.DataFrame([(no, 0, jaccard._short(k), bytes([1] * len(k))) for no, k in [(3, keys[:200]), (17, keys[:200]), *((no, keys[200:]) for no in range(40))]], columns=["no", "bucket", "regions", "several"])
    out = jaccard._shared(pdf, 16, 50)
    places = [np.frombuffer(jaccard.zstandard.decompress(m), "<u4").tolist() for m in out.meets]
    assert len(set(places[0])) == 1 and places[0] == places[1] and len(places[0]) == 200
    assert all(p == places[2] for p in places[3:]) and len(set(places[2])) > 30  # a region of many blocks goes by its key


def test_one_of_each_group_stays(spark, documents):
    left = jaccard.first_of_groups(documents)
    assert left.columns == documents.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["-7", "1", "2", "3", "4", "5", "None"]


def test_pipeline_stages_equal_a_plain_run(spark):
    import corpus_pipeline as p
    from granary.llm import edits, ordinal, toxicity

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = ordinal.train(docs, labels)
    kept = {i: t for i, t in rows.items() if 1 - model.probabilities([model.score(t)])[0][0] >= p.QUALITY_FROM or len(model.grades) < 2}
    of = toxicity.train(docs.where(F.col("doc_id").isin(list(kept))), labels).scorer()
    kept = {i: t for i, t in kept.items() if of(t) < p.TOXIC_FROM}
    kept = {int(i): kept[int(i)] for i, _, c in brute(list(kept.items()), p.SHINGLE_WORDS, p.SIMILAR, p.OF) if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    finder = edits.Finder(items, p.EDITS_PER_CHARACTER)
    kept = {i for i, t in kept.items() if not finder.hits(t)}
    assert {r.doc_id for r in p.run(spark, FOLDER).collect()} == kept
