"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample and broadcast; every vector is put in a leaf by descending to the nearest
centre. A query orders the leaves by a priority queue of nodes: the nearest node is taken, a leaf is visited, an inner
node puts its children in the queue. How many leaves to visit is calibrated: for a bounded set of queries the true
neighbours are found by comparison with all rows, and the visits widen until the neighbours' leaves, in each query's own
order, give the wished recall. A query whose leaves hold too few vectors goes on to further ones. Leaves are dealt to shards of bounded size, large ones over several; a query goes to
the shards that hold its leaves, and their answers merge.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, partitions, stash, table
from .vectors import packed, rows, unpacked, usable

SHARD = 20_000


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres; empty ones are left out."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        centres = np.stack([x[near == j].mean(axis=0) for j in range(len(centres)) if (near == j).any()])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * x @ centres.T, axis=1)


@dataclass
class Tree:
    centres: list[np.ndarray] = field(default_factory=list)  # of a node's children
    children: list[list[int]] = field(default_factory=list)  # node numbers; negative: -1 - leaf
    leaves: int = 0

    @classmethod
    def fit(cls, x: np.ndarray, branching: int, leaf_size: int) -> Tree:
        tree, rng = cls(), np.random.default_rng(7)

        def grow(part: np.ndarray) -> int:
            if len(part) > leaf_size and len(np.unique(part[: 50 * branching], axis=0)) > branching:
                centres = kmeans(part, min(branching, len(part)), rng)
                near = nearest(part, centres)
                if len(centres) > 1 and (near != near[0]).any():
                    node = len(tree.centres)
                    tree.centres.append(centres)
                    tree.children.append([])
                    tree.children[node] = [grow(part[near == j]) if (near == j).any() else tree._leaf() for j in range(len(centres))]
                    return node
            return tree._leaf()

        if grow(x) < 0:  # one leaf
            tree.centres, tree.children = [x[:1] if len(x) else np.zeros((1, 1))], [[-1]]
        return tree

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, open_ = np.zeros(len(x), int), [(0, np.arange(len(x)))]
        while open_:
            node, at = open_.pop()
            near = nearest(x[at], self.centres[node])
            for j, child in enumerate(self.children[node]):
                part = at[near == j]
                if len(part) and child < 0:
                    out[part] = -1 - child
                elif len(part):
                    open_.append((child, part))
        return out

    def best_first(self, q: np.ndarray):
        """All leaves, as the priority queue gives them out."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
            else:
                for d, child in zip(((self.centres[node] - q) ** 2).sum(axis=1).tolist(), self.children[node], strict=True):
                    heapq.heappush(queue, (d, child))


def closest(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k rows nearest to q by distance and id, of distances from the differences themselves."""
    rough = (x * x).sum(axis=1) - 2 * x @ q
    if len(rough) > 4 * k:
        cut = np.partition(rough, k)[k]
        part = np.flatnonzero(rough <= cut + 1e-9 * (1 + abs(cut) + float(q @ q)))
    else:
        part = np.arange(len(rough))
    d = np.sqrt(((x[part] - q) ** 2).sum(axis=1))
    best = np.lexsort((ids[part], d))[:k]
    return list(zip(ids[part][best].tolist(), d[best].tolist(), strict=True))


def search(vectors: DataFrame, every: int = 100, k: int = 10, recall: float = 0.97, sample: int = 20_000, branching: int = 8, leaf_size: int = 40, calibrate: int = 96) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each usable vector whose vec_id is divisible by ``every``, the k nearest others found.

    ``sample`` bounds the vectors that the tree is fitted on, ``calibrate`` the queries that set the number of leaves
    to visit (both by a hash of vec_id). Ties in distance go to the smaller vec_id. Of equal vectors only the k + 1
    smallest ids can be in an answer, so the index keeps those. A vec_id that several rows share is one candidate by
    its smallest vector in order. An empty table, or one without usable vectors, gives an empty result.
    """
    spark = vectors.sparkSession
    good = stash(usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    # first by value and salt, then by value: no group of equal vectors is one task's work
    salted = Window.partitionBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = good.withColumn("n", F.row_number().over(salted)).where(f"n <= {k + 1}").withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(f"n <= {k + 1}")
    by_hash = lambda df, n: [np.array(r["embedding"]) for r in df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect()]
    queries = good.where(F.col("vec_id") % every == 0)
    fitted = by_hash(good, sample)
    tree = Tree.fit(np.stack(fitted) if fitted else np.zeros((0, 1)), branching, leaf_size)

    def place(batch):
        x = rows(batch.column("embedding"))
        return {"leaf": tree.place(x), "vec_id": batch.column("vec_id"), "x": packed(x)}

    index = stash(map_batches(few.select("vec_id", "embedding"), place, "leaf int, vec_id long, x binary"))
    sizes = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # bounded by the tree
    visits = calibrated(index, by_hash(queries, calibrate), tree, k, recall, sizes)

    # leaves to shards: small ones share, large ones are dealt over several by a hash of the id
    shards, at, room = {}, 0, SHARD
    target = max(200, min(SHARD, sum(sizes.values()) // (2 * partitions(spark)) + 1))
    for leaf in sorted(sizes):
        n = -(-sizes[leaf] // SHARD)
        if n > 1 or sizes[leaf] > room:
            at, room = at + 1, target
        shards[leaf] = (at, n)
        at, room = (at + n, target) if n > 1 else (at, room - sizes[leaf])

    def to_shards(batch):
        leaf, ids = batch.column("leaf").to_numpy(), batch.column("vec_id").to_numpy()
        first, n = (np.array([shards[v][j] for v in leaf], int) for j in (0, 1))
        return {"shard": first + (ids * 2654435761 % 2**31) % n, "leaf": leaf, "vec_id": ids, "x": batch.column("x")}

    def ask(batch):
        x, made = rows(batch.column("embedding")), []
        for query, q in zip(batch.column("vec_id").to_pylist(), x, strict=True):
            by: dict[int, list[int]] = {}
            held = 0
            for n, leaf in enumerate(v for v in tree.best_first(q) if v in shards):
                if n >= visits and held > k:  # k without the query itself
                    break
                held += sizes[leaf]
                for shard in range(shards[leaf][0], sum(shards[leaf])):
                    by.setdefault(shard, []).append(leaf)
            made += [(shard, query, sorted(leaves), q.tobytes()) for shard, leaves in by.items()]
        shard, query, leaves, q = zip(*made, strict=True) if made else ((), (), (), ())
        return {"shard": shard, "query_id": query, "leaves": leaves, "q": q}

    dealt = map_batches(index, to_shards, "shard int, leaf int, vec_id long, x binary")
    asked = map_batches(queries, ask, "shard int, query_id long, leaves array<int>, q binary")

    def answer(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(own) and len(asking):
            own = own.sort_values(["leaf", "vec_id"])
            ids, leaf, x = own["vec_id"].to_numpy(), own["leaf"].to_numpy(), unpacked(own["x"])
            for query, leaves, q in zip(asking["query_id"], asking["leaves"], unpacked(asking["q"]), strict=True):
                lo, hi = np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, side="right")
                part = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
                part = part[ids[part] != query]
                made += [(query, i, d) for i, d in closest(q, ids[part], x[part], k)]
        return pd.DataFrame(made, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = dealt.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(answer, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def calibrated(index: DataFrame, queries: list[np.ndarray], tree: Tree, k: int, recall: float, sizes: dict[int, int]) -> int:
    """The least number of leaves that holds ``recall`` of the queries' true neighbours (the nearest may be the query itself)."""
    if not queries:
        return 1

    def best(batch):
        ids, leaf, x = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy(), unpacked(batch.column("x").to_pylist())
        leaf_of = dict(zip(ids.tolist(), leaf.tolist(), strict=True))
        made = [(j, i, d, leaf_of[i]) for j, q in enumerate(queries) for i, d in closest(q, ids, x, k + 1)]
        query, vec_id, score, leaves = zip(*made, strict=True)
        return {"query": query, "vec_id": vec_id, "score": score, "leaf": leaves}

    near = map_batches(index, best, "query int, vec_id long, score double, leaf int")
    top = near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(f"n <= {k + 1}")
    ranks: list[int] = []
    order = [{leaf: n for n, leaf in enumerate(v for v in tree.best_first(q) if v in sizes)} for q in queries]
    for r in top.select("query", "leaf").collect():  # bounded by calibrate and k
        ranks.append(order[r["query"]][r["leaf"]])
    ranks.sort()
    return ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)] + 1


def op2_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
