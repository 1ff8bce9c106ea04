"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Vectors are lengthened by one component so that all have the norm of the longest; the
largest inner product is then the smallest distance.  A tree halves the space at the
median of a random projection, again and again.  Directions come from a seeded random
generator; only the medians are fitted, on a bounded sample.  Every vector is filed in
one leaf of every tree.

A query goes down all trees at once with one priority queue: the branch, of whatever
tree, whose worst margin is best is opened next, until the leaves reached hold enough
vectors.  These leaves are scored exactly, in blocks of bounded size, against all
queries that reached them, and each query keeps its best.

How many vectors are enough depends on the data.  Clustered embeddings need a fixed
number (`SEARCHED`).  Vectors without any structure, such as independent noise in 64
dimensions, keep their neighbours only if most of the index is looked at, whatever the
method; `SHARE` asks for that and can be lowered to 0 where it isn't needed.

Equal vectors are one class: it is indexed and searched once, and carries the smallest
ids of its rows, as many as any answer can use.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlet.llm.common import ship, stage

ship(__name__)

TREES = 8
LEAF = 512           # classes a leaf should hold at least,
VISITS = 32          # and so many that a query need not open more leaves than this
DEEPEST = 14         # levels of a tree at most: 2**14 leaves
SAMPLE = 65_536      # classes the medians are fitted on, at most
SEARCHED = 12_000    # filed classes (over all trees) that a query's leaves hold at least,
SHARE = 1.0          # and as many as this share of all classes
BLOCK = 16_384       # rows of a leaf, and queries, that one task scores at a time


def usable(vector: Column) -> Column:
    """Whether a vector takes part: components all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def directions(seed: int, tree: int, depth: int, width: int) -> np.ndarray:
    """The random directions of the inner nodes of a tree, one row each; the same everywhere."""
    return np.random.default_rng([seed, tree]).standard_normal((2**depth - 1, width)).astype(np.float32)


class Forest:
    """medians[t] holds a cut for each inner node of tree t; nodes are numbered as in a heap."""

    def __init__(self, seed: int, depth: int, width: int, longest: float, medians: list[np.ndarray]):
        self.seed, self.depth, self.width, self.longest, self.medians = seed, depth, width, longest, medians
        self.normals: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"normals": {}}

    def normal(self, tree: int) -> np.ndarray:
        if tree not in self.normals:
            self.normals[tree] = directions(self.seed, tree, self.depth, self.width + 1)
        return self.normals[tree]

    def lengthened(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors one component longer; rows get what they lack to the longest, queries nothing."""
        norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
        if query:
            return np.hstack([x / norms, np.zeros_like(norms)]).astype(np.float32)
        return np.hstack([x / self.longest, np.sqrt(np.maximum(0.0, 1.0 - (norms / self.longest) ** 2))]).astype(np.float32)

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        normal, medians = self.normal(tree), self.medians[tree]
        for _ in range(self.depth):
            right = np.einsum("ij,ij->i", x, normal[node]) > medians[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)

    def margins(self, x: np.ndarray) -> list[np.ndarray]:
        """For each tree, every query's signed distance to every cut."""
        return [x @ self.normal(t).T - self.medians[t] for t in range(len(self.medians))]

    def reached(self, margins: list[np.ndarray], sizes: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order one shared queue opens them, until they hold `enough` rows.  margins: of one query."""
        inner = 2**self.depth - 1
        queue = [(-math.inf, t, 0) for t in range(len(margins))]
        held, found = 0, []
        while queue and held < enough:
            worst, tree, node = heapq.heappop(queue)
            own = margins[tree]
            while node < inner:
                cut = own[node]
                near, far = (2 * node + 2, 2 * node + 1) if cut > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(worst, abs(cut)), tree, far))
                node = near
            n = sizes[tree, node - inner]
            if n:
                found.append((tree, node - inner))
                held += n
        return found


def fit(sample: np.ndarray, longest: float, depth: int, trees: int, seed: int) -> Forest:
    """Cuts at the medians of the sample (of two halves, one may be empty: the cut is then the parent's projection)."""
    forest = Forest(seed, depth, sample.shape[1], longest, [])
    x = forest.lengthened(sample, query=False)
    for t in range(trees):
        medians, node, normal = np.zeros(2**depth - 1, dtype=np.float32), np.zeros(len(x), dtype=np.int64), directions(seed, t, depth, x.shape[1])
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            projected = np.einsum("ij,ij->i", x, normal[node])
            order = np.lexsort((projected, node))
            bounds = np.searchsorted(node[order], np.arange(first, first + width + 1))
            for i in range(width):
                own = projected[order[bounds[i]:bounds[i + 1]]]
                if own.size:
                    medians[first + i] = np.median(own)
            node = 2 * node + 1 + (projected > medians[node])
        forest.medians.append(medians)
    return forest


def _matrix(vectors: pd.Series, kind=np.float64) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=kind) for v in vectors]) if len(vectors) else np.empty((0, 0), kind)


def neighbours(rows: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, leaf: int = LEAF, searched: int = SEARCHED, share: float = SHARE,
               sample: int = SAMPLE, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of `rows` (vec_id, embedding) that is_query, its k nearest found.

    Nearness is the inner product in double precision; ties go to the smaller vec_id; a
    query is no candidate of its own, other rows with its vector are.  Vectors that are
    null, zero or hold null or non-finite components, and rows without id, take no part;
    neither do vectors of another length than the most common one.  A repeated id with
    one vector is one row; with several it is several candidates.  With fewer than k candidates all are given, and with no more
    candidates than a query searches anyway, every answer is exact.  An empty table
    gives no rows.
    """
    spark = rows.sparkSession
    real = rows.select("vec_id", F.col("embedding").alias("v"), is_query.alias("asks"))
    real = real.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = real.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    out = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], out)
    real = stage(real.filter(F.size("v") == lengths["n"]).dropDuplicates(["vec_id", "v"]))

    # Classes of equal vectors: the smallest k + 1 ids of each, in two steps so that no task meets all copies.
    salted = W.partitionBy("v", (F.xxhash64("vec_id") % 32)).orderBy("vec_id")
    per_class = W.partitionBy("v").orderBy("vec_id")
    few = real.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(per_class)).filter(F.col("r") <= k + 1)
    classes = few.groupBy("v").agg(F.min("vec_id").alias("c"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asking = real.filter("asks").select("v").distinct().withColumn("asks", F.lit(True))
    classes = stage(classes.join(asking, "v", "left").fillna(False, ["asks"]))

    kind = classes.schema["v"].dataType.simpleString()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    total, longest = classes.agg(F.count(F.lit(1)), F.max(norm)).first()
    enough = max(searched, math.ceil(share * total))
    size = max(leaf, share * total / VISITS)   # a query opens few leaves, each of which gives back few rows
    depth = max(1, min(DEEPEST, math.floor(math.log2(max(2.0, total / size)))))
    chosen = classes.orderBy(F.xxhash64("c"), "c").limit(sample).select("v").toPandas()
    forest = fit(_matrix(chosen["v"]), float(longest), depth, trees, seed)
    model = spark.sparkContext.broadcast(cloudpickle.dumps(forest))   # the class goes along by value

    @F.pandas_udf("array<int>")
    def filed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = pickle.loads(model.value)
        for vectors in batches:
            x = f.lengthened(_matrix(vectors), query=False)
            yield pd.Series(list(np.stack([f.leaves(x, t) for t in range(trees)], axis=1).astype(np.int32)))

    index = stage(classes.select("c", "v", F.posexplode(filed("v")).alias("tree", "leaf")))
    sizes = np.zeros((trees, 2**depth), dtype=np.int64)
    for r in index.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect():   # at most trees * 2**DEEPEST
        sizes[r["tree"], r["leaf"]] = r["n"]
    counts = spark.sparkContext.broadcast(sizes)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, n = pickle.loads(model.value), counts.value
        for queries in batches:
            for at in range(0, len(queries), 256):
                part = queries.iloc[at:at + 256]
                margins = f.margins(f.lengthened(_matrix(part["v"]), query=True))
                found = [f.reached([m[i] for m in margins], n, enough) for i in range(len(part))]
                times = [len(x) for x in found]
                pairs = np.array([p for x in found for p in x], dtype=np.int32).reshape(-1, 2)
                yield pd.DataFrame({"q": np.repeat(part["c"].to_numpy(), times), "tree": pairs[:, 0], "leaf": pairs[:, 1], "v": np.repeat(part["v"].to_numpy(), times)})

    visits = classes.filter("asks").select("c", "v").mapInPandas(search, f"q long, tree int, leaf int, v {kind}")
    # A leaf's rows and its visitors are cut into blocks by hash; each block of rows meets each block of visitors.
    n_rows = index.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("row_blocks"))
    visits = stage(visits)
    n_visits = visits.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("visit_blocks"))
    blocks = stage(n_rows.join(n_visits, ["tree", "leaf"]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("long")).cast("int")
    left = visits.join(blocks, ["tree", "leaf"]).select("tree", "leaf", every("row_blocks").alias("rb"), own("q", "visit_blocks").alias("vb"), F.col("q").alias("id"), "v", F.lit(True).alias("asks"))
    right = index.join(blocks, ["tree", "leaf"]).select("tree", "leaf", own("c", "row_blocks").alias("rb"), every("visit_blocks").alias("vb"), F.col("c").alias("id"), "v", F.lit(False).alias("asks"))

    def best(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        queries, held = group[asks], group[~asks]
        if queries.empty or held.empty:
            return pd.DataFrame({"q": np.empty(0, np.int64), "c": np.empty(0, np.int64), "rough": np.empty(0)})
        ids, x = held["id"].to_numpy(np.int64), _matrix(held["v"])
        keep = min(k + 1, len(ids))
        parts = []
        for at in range(0, len(queries), 256):
            part = queries.iloc[at:at + 256]
            scores = _matrix(part["v"]) @ x.T
            # All that reach the keep-th score stay, so that equal scores are told apart by id later.
            least = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep, None]
            i, j = np.nonzero(scores >= least - 1e-9 * np.abs(least))
            parts.append(pd.DataFrame({"q": part["id"].to_numpy(np.int64)[i], "c": ids[j], "rough": scores[i, j]}))
        return pd.concat(parts)

    scored = left.unionByName(right).groupBy("tree", "leaf", "rb", "vb").applyInPandas(best, "q long, c long, rough double")
    scored = stage(scored.dropDuplicates(["q", "c"]))
    # Few rough winners a query remain to be scored in the order of components, as the contract's measure is.
    near = scored.withColumn("r", F.rank().over(W.partitionBy("q").orderBy(F.desc(F.round("rough", 9))))).filter(F.col("r") <= k + 1).select("q", "c")
    there = classes.select(F.col("c"), F.col("v").alias("there"), "ids")
    here = classes.filter("asks").select(F.col("c").alias("q"), F.col("v").alias("here"))
    dot = F.aggregate(F.zip_with("here", "there", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    listed = near.join(there, "c").join(here, "q").select("q", dot.alias("score"), F.explode("ids").alias("vec_id"))
    top = listed.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    top = stage(top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top")))
    ids = real.filter("asks").select("vec_id", "v").join(classes.select("v", F.col("c").alias("q")), "v").select(F.col("vec_id").alias("query_id"), "q")
    others = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    answers = ids.join(top, "q").select("query_id", F.posexplode(others).alias("r", "t"))
    return answers.select("query_id", (F.col("r") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")
