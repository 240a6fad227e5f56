"""Exact top-k inner products with M-trees searched best first.

Inner product is turned into a metric: with M the largest norm, a stored vector x gets one more component
sqrt(M^2 - |x|^2) and a query q a zero, so d(q, x)^2 = |q|^2 + M^2 - 2 q.x and the nearest vectors are those with
the largest products. Over that metric stand M-trees of fixed-size pages: an internal page has routing vectors with
covering radius, distance to the parent's routing vector and child page; a leaf page has vectors with the distance
to their parent. A search keeps a queue of pages ordered by the least distance they can hold, and an entry whose
stored distances already exclude it by the triangle inequality costs no distance computation.

Spark splits the work: equal vectors are one entry with their ``k + 1`` smallest ids (more cannot be returned);
vectors go to the nearest of some sampled routing vectors, each region is cut by hash into trees of bounded size,
and every tree is built in one task and written to a folder of its own. Queries visit their nearest tree first; the k-th
score found there is the bound with which whole trees are excluded in the second round. There a piece of work is a block of
queries and some trees, which it reads one after the other; the best scores of a query so far exclude what follows. So a task
holds one tree and one block, and neither trees nor pairs of queries and trees are shuffled. The sample only routes:
every vector is indexed and the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from granary.llm.common import partitions, read_block, read_files, run_folder, staged, written_blocks

PAGE = 128
TREE_ROWS = 8192
MAX_ROUTES = 1024
QUERY_BLOCK = 2048
TREES = 64  # at most, that a piece of work searches for a block of queries
_CELLS = 1_000_000  # of a matrix of distances
_SLACK = 1e-6


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v): vectors as floor(scale * x), without rows whose id or vector is null or holds null, NaN or infinity."""
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(f"`{id_col}`").isNotNull() & vector.isNotNull() & finite).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, page: int = PAGE, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` largest inner products of every query with all other ids.

    ``vectors`` has (id, v array<long>); ``is_query`` is a condition on ``id``. Ties go to the smaller id. Repeated
    rows count once; an id with several vectors takes part with each of them. Shorter vectors count as padded with
    zeros, so an empty one scores 0. Fewer than ``k`` rows come back where there are fewer candidates, and none for
    an empty table. Scores have to fit a long.
    """
    spark = vectors.sparkSession
    order = F.dense_rank().over(W.partitionBy("v").orderBy("id"))
    points = staged(vectors.withColumn("nth", order).where(F.col("nth") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")), "points")
    size = points.select(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not size[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, exact_floats = int(size[1]), float(size[2] or 0) ** 2 * max(1, int(size[1])) < 2.0**52
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most2 = float(points.select(F.max(norm2)).first()[0])
    space = Space(width, most2, exact_floats)

    # routing vectors: a hash sample whose size follows the number of trees, within MAX_ROUTES
    wanted = min(MAX_ROUTES, max(1, size[0] // (tree_rows // 4)))
    routes = np.array([space.pad(r[0]) for r in points.select("v").orderBy(F.xxhash64("v"), "v").limit(wanted).collect()])
    routed = points.mapInPandas(lambda it: _route(it, space, routes), StructType([*points.schema.fields, StructField("route", IntegerType())]))
    routed = staged(routed, "routed")
    counts = {r[0]: r[1] for r in routed.groupBy("route").count().collect()}
    parts = F.create_map(*[F.lit(x) for r, n in counts.items() for x in (r, -(-n // tree_rows))])
    cut = F.pmod(F.xxhash64("v"), parts[F.col("route")]).cast("int")
    forest = run_folder(spark, "trees")  # a folder per tree, read by tasks
    routed.withColumn("cut", cut).groupBy("route", "cut").applyInPandas(lambda key, pdf: _build(key, pdf, space, page), _PAGES).write.partitionBy("tree").parquet(forest)
    tops = run_folder(spark, "tops")  # a row per tree, read by tasks
    spark.read.schema(_PAGES).parquet(forest).where("page = 0").select("tree", "top", "reach").write.parquet(tops)
    trees = spark.read.parquet(tops).count()

    asked = vectors.where(is_query)
    questions = staged(asked.groupBy("v").agg(F.min("id").alias("qid")), "questions")
    blocks = -(-max(1, questions.count()) // QUERY_BLOCK)
    placed = StructType([StructField("qid", LongType()), StructField("v", ArrayType(LongType())), StructField("tree", LongType())])
    nearest = staged(questions.mapInPandas(lambda it: _nearest(it, space, tops), placed).withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")), "nearest")
    sorted_ = nearest.repartition(4 * partitions(vectors), "tree", "block").sortWithinPartitions("tree")
    first = staged(sorted_.mapInPandas(lambda it: _first(it, space, forest, k + 1), _FOUND), "first")
    kth = first.where(F.col("nth") == k + 1).select("qid", F.col("score").alias("least"))
    known = written_blocks(nearest.join(kth, "qid", "left"), "known", "block", blocks)
    tasks = 4 * partitions(vectors)
    per = max(1, min(TREES, blocks * trees // tasks))
    work = blocks * -(-trees // per)
    rest = spark.range(0, work, 1, min(work, tasks)).mapInPandas(lambda it: _others(it, space, forest, tops, known, blocks, per, k + 1), _FOUND)

    best = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    merged = first.unionByName(rest).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    rank = F.row_number().over(W.partitionBy("query_id", "qid").orderBy(F.desc("score"), "vec_id")).cast("int")
    queries = asked.distinct().join(questions, "v").select(F.col("id").alias("query_id"), "qid")
    hits = queries.join(merged, "qid").where(F.col("vec_id") != F.col("query_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Space:
    """The metric made of inner products: integer vectors with the bound of their squared norms."""

    def __init__(self, width: int, most2: float, exact_floats: bool):
        self.width, self.most2, self.kind = width, most2, np.float64 if exact_floats else np.int64

    def pad(self, v) -> np.ndarray:
        out = np.zeros(self.width, self.kind)
        out[: len(v)] = v
        return out

    def matrix(self, vectors) -> np.ndarray:
        return np.array([self.pad(v) for v in vectors], self.kind).reshape(-1, self.width)

    def norms(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) ** 2).sum(-1)

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of all stored vectors x to all stored vectors y."""
        a, b = self.norms(x), self.norms(y)
        lift = np.sqrt(np.maximum(self.most2 - a, 0))[:, None] * np.sqrt(np.maximum(self.most2 - b, 0))[None]
        same = x.astype(np.float64) @ y.astype(np.float64).T + lift
        return np.sqrt(np.maximum(2 * self.most2 - 2 * same, 0))

    def to_query(self, product, q2: float):
        return np.sqrt(np.maximum(q2 + self.most2 - 2 * np.asarray(product, np.float64), 0))

    def slack(self) -> float:
        return _SLACK * (1 + self.most2**0.5)


_PAGES = StructType(
    [
        StructField("tree", LongType()),
        StructField("page", IntegerType()),
        StructField("leaf", IntegerType()),
        StructField("vectors", BinaryType()),
        StructField("to_parent", BinaryType()),
        StructField("radius", BinaryType()),
        StructField("child", BinaryType()),
        StructField("ids", ArrayType(ArrayType(LongType()))),
        StructField("top", ArrayType(LongType())),
        StructField("reach", DoubleType()),
    ]
)
_FOUND = StructType([StructField("qid", LongType()), StructField("nth", IntegerType()), StructField("vec_id", LongType()), StructField("score", LongType())])


def _route(batches: Iterator[pd.DataFrame], space: Space, routes: np.ndarray) -> Iterator[pd.DataFrame]:
    for batch in batches:
        step = max(1, _CELLS // len(routes))
        for at in range(0, len(batch), step):
            part = batch.iloc[at : at + step]
            yield part.assign(route=space.between(space.matrix(part.v), routes).argmin(1).astype("int32"))


def _build(key, pdf: pd.DataFrame, space: Space, page: int) -> pd.DataFrame:
    """Bulk load of one tree: page 0 is the root, reached over the routing vector ``top`` with radius ``reach``."""
    pdf = pdf.sort_values("v", key=lambda s: s.map(tuple), ignore_index=True)
    x = space.matrix(pdf.v)
    ids = pdf.ids.to_numpy()
    rows: list = []
    tree = (int(key[0]) << 32) | int(key[1])

    def grow(members: np.ndarray, parent: np.ndarray) -> int:
        """The page of ``members`` below the routing vector ``parent``."""
        at = len(rows)
        rows.append(None)
        dist = space.between(x[members], parent[None])[:, 0]
        if len(members) <= page:
            rows[at] = (tree, at, 1, x[members].tobytes(), dist.tobytes(), b"", b"", [list(map(int, ids[m])) for m in members])
            return at
        # seeds far apart: each is the farthest from those chosen before it
        seeds, nearest = [int(dist.argmax())], None
        for _ in range(min(page, -(-len(members) // page) + 1) - 1):
            d = space.between(x[members], x[members[seeds[-1]]][None])[:, 0]
            nearest = d if nearest is None else np.minimum(nearest, d)
            if nearest.max() <= 0:
                break
            seeds.append(int(nearest.argmax()))
        owner = space.between(x[members], x[members[seeds]]).argmin(1)
        groups = [members[owner == s] for s in range(len(seeds))]
        if max(map(len, groups)) == len(members):  # no seed separates anything: cut by order
            groups = np.array_split(members[np.argsort(dist, kind="stable")], -(-len(members) // page))
        routing, radius, child = [], [], []
        for group in groups:
            if len(group):
                centre = x[group[space.between(x[group], x[group].mean(0, keepdims=True).astype(x.dtype)).argmin()]] if len(group) < len(members) else x[group[0]]
                routing.append(centre)
                radius.append(float(space.between(x[group], centre[None]).max()))
                child.append(grow(group, centre))
        entries = np.array(routing, x.dtype)
        rows[at] = (tree, at, 0, entries.tobytes(), space.between(entries, parent[None])[:, 0].tobytes(), np.array(radius).tobytes(), np.array(child, np.int64).tobytes(), None)
        return at

    everything = np.arange(len(x))
    top = x[space.between(x, x.mean(0, keepdims=True).astype(x.dtype)).argmin()]
    reach = float(space.between(x, top[None]).max())
    grow(everything, top)
    out = pd.DataFrame(rows, columns=[f.name for f in _PAGES][:8])
    first = out.page == 0
    return out.assign(top=[list(map(int, top)) if f else None for f in first], reach=np.where(first, reach, np.nan))


@lru_cache(1)
def _tops(path: str) -> tuple[np.ndarray, list, np.ndarray]:
    """Per worker: the trees, ascending, with their top vectors and reach."""
    rows = read_files(path).sort_by("tree").to_pydict()
    return np.array(rows["tree"], np.int64), rows["top"], np.array(rows["reach"], np.float64)


def _nearest(batches, space: Space, path: str) -> Iterator[pd.DataFrame]:
    """Questions with the tree whose top is nearest."""
    trees, tops, _ = _tops(path)
    centres = space.matrix(tops).astype(np.float64).T
    step = max(1, _CELLS // len(trees))
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.iloc[at : at + step]
            q = space.matrix(part.v)
            d = space.to_query(q.astype(np.float64) @ centres, space.norms(q)[:, None])
            yield pd.DataFrame({"qid": part.qid, "v": part.v, "tree": trees[d.argmin(1)]})


@lru_cache(1)
def _tree(forest: str, number: int, width: int, kind: type) -> tuple[np.ndarray, dict]:
    """Top vector and pages of a tree."""
    pages = read_block(forest, "tree", number).select(["page", "leaf", "vectors", "to_parent", "radius", "child", "ids", "top"]).to_pylist()
    tree, top = {}, np.zeros(width, kind)
    for r in pages:
        entries = np.frombuffer(r["vectors"], kind).reshape(-1, width)
        leaf = r["leaf"]
        tree[r["page"]] = (leaf, entries, np.frombuffer(r["to_parent"]), None if leaf else np.frombuffer(r["radius"]), r["ids"] if leaf else np.frombuffer(r["child"], np.int64))
        if r["page"] == 0:
            top[: len(r["top"])] = r["top"]
    return top, tree


def _first(batches: Iterator[pd.DataFrame], space: Space, forest: str, wanted: int) -> Iterator[pd.DataFrame]:
    """The best ``wanted`` (score, id) of each question in its nearest tree."""
    for batch in batches:
        for number, part in batch.groupby("tree", sort=False):
            tree, found = _tree(forest, int(number), space.width, space.kind), [[] for _ in range(len(part))]
            for v, best in zip(part.v, found, strict=True):
                _search(tree, space.pad(v), -np.inf, best, space, wanted)
            yield _found(part.qid.tolist(), found)


def _others(batches: Iterator[pd.DataFrame], space: Space, forest: str, tops: str, known: str, blocks: int, per: int, wanted: int) -> Iterator[pd.DataFrame]:
    """Of each piece of work, the best ``wanted`` (score, id) of each question of a block in some of the trees, beside the one
    searched already; what cannot reach the bound is left out."""
    trees, centres, reach = _tops(tops)
    for piece in (int(i) for batch in batches for i in batch.id):
        asked = read_block(known, "block", piece % blocks)
        if asked is None:
            continue
        own = slice(piece // blocks * per, (piece // blocks + 1) * per)
        asked = asked.to_pydict()
        q = space.matrix(asked["v"])
        q2, searched = space.norms(q), np.array(asked["tree"], np.int64)
        d = space.to_query(q.astype(np.float64) @ space.matrix(centres[own]).astype(np.float64).T, q2[:, None]) - reach[own]
        floors = [-np.inf if x is None else x for x in asked["least"]]
        bounds = np.array([np.inf if x == -np.inf else float(space.to_query(x, y)) for x, y in zip(floors, q2, strict=True)])
        found: list[list] = [[] for _ in floors]
        for j in np.argsort(d.min(0), kind="stable"):
            open_ = np.flatnonzero((d[:, j] <= bounds + space.slack()) & (searched != trees[own][j]))
            if len(open_):
                tree = _tree(forest, int(trees[own][j]), space.width, space.kind)
                for i in open_:
                    floors[i] = _search(tree, q[i], floors[i], found[i], space, wanted)
                    if floors[i] > -np.inf:
                        bounds[i] = float(space.to_query(floors[i], q2[i]))
        yield _found(asked["qid"], found)


def _search(of: tuple[np.ndarray, dict], q: np.ndarray, floor, found: list, space: Space, wanted: int):
    """Puts the best scores of at least ``floor`` of a tree on the heap ``found`` of at most ``wanted`` (score, -id); the new floor."""
    top, tree = of
    q2, slack = float(space.norms(q)), space.slack()
    bound = np.inf if floor == -np.inf else float(space.to_query(floor, q2)) + slack
    queue = [(0.0, 0, float(space.to_query(top @ q, q2)))]
    while queue:
        near, at, to_parent = heapq.heappop(queue)
        if near > bound:
            break
        leaf, entries, parent, radius, below = tree[at]
        # the triangle inequality over stored distances: no product is computed for what it excludes
        gap = np.abs(to_parent - parent)
        keep = np.flatnonzero((gap if leaf else gap - radius) <= bound)
        if not len(keep):
            continue
        product = entries[keep] @ q
        if not leaf:
            d = space.to_query(product, q2)
            low = np.maximum(d - radius[keep], 0)
            for i in np.flatnonzero(low <= bound):
                heapq.heappush(queue, (float(low[i]), int(below[keep[i]]), float(d[i])))
            continue
        for i in np.flatnonzero(product >= floor):
            score = int(product[i])
            for vec_id in below[keep[i]]:
                item = (score, -int(vec_id))
                if len(found) < wanted:
                    heapq.heappush(found, item)
                elif item > found[0]:
                    heapq.heapreplace(found, item)
                else:
                    break
        if len(found) == wanted and found[0][0] > floor:
            floor = found[0][0]
            bound = float(space.to_query(floor, q2)) + slack
    return floor


def _found(qids: list[int], found: list[list]) -> pd.DataFrame:
    out = [(int(qid), n, -i, score) for qid, best in zip(qids, found, strict=True) for n, (score, i) in enumerate(sorted(best, key=lambda x: (-x[0], -x[1])), 1)]
    return pd.DataFrame(out, columns=["qid", "nth", "vec_id", "score"]).astype({"qid": "int64", "nth": "int32", "vec_id": "int64", "score": "int64"})
