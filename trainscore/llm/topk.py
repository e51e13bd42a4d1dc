"""Exact top-k by integer inner product: a KD-tree per shard, searched best box first.

A shard's vectors are split at the median of the widest component until ``LEAF`` are left; each
node has the tight bounding box of its vectors. No product with a vector of a box exceeds the sum
over components of the larger product with the box's two sides, so nodes are opened in order of
that bound, and a search ends when the best bound left is under the kth score found. A query
first searches one shard; its kth score there goes along to all others.

Components become floor(scale * x), at most the largest long. Products and sums are exact: in double
precision up to 2**53, beyond that in integers, and the bounds of boxes are rounded outwards there. A score
beyond a long counts as the largest, or least but one, long. How rows without a usable vector are treated: ``vectors``.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch
from .vectors import UNFILLED, best, blank, meeting, ranked, shards_and_blocks

LEAF = 256
SHARD_ROWS = 16384
BLOCK_ROWS = 1024
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def exact_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as longs; only rows that doubles cannot multiply exactly take another way."""
    with np.errstate(over="ignore"):
        most = np.abs(vectors).max(axis=1, initial=0) * np.abs(query).max(initial=0) * vectors.shape[1]
    found = np.zeros(len(vectors), np.int64)
    plain = most <= EXACT
    found[plain] = vectors[plain] @ query
    # Half of a long's range leaves room for the rounding of ``most`` itself.
    large = ~plain & (most < 2.0**62)
    if large.any():
        found[large] = vectors[large].astype(np.int64) @ query.astype(np.int64)
    for row in np.flatnonzero(~plain & ~large):
        total = sum(int(a) * int(b) for a, b in zip(vectors[row], query, strict=True))
        found[row] = max(-LONG, min(LONG, total))
    return found


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        low, high, children, leaves = [], [], [], []
        rows = np.arange(len(ids))
        todo = [(rows, -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            part = vectors[rows]
            node = len(low)
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            children.append([-1, -1])
            leaves.append(None)
            if parent >= 0:
                children[parent][side] = node
            if len(rows) <= LEAF:
                leaves[node] = (ids[rows], part)
                continue
            widest = int((high[-1] - low[-1]).argmax())
            order = np.argsort(part[:, widest], kind="stable")
            half = len(rows) // 2
            todo += [(rows[order[:half]], node, 0), (rows[order[half:]], node, 1)]
        self.low, self.high, self.children, self.leaves = np.array(low), np.array(high), children, leaves

    def search(self, own: np.ndarray, queries: np.ndarray, bounds: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        near, scores = blank(len(own), k, np.int64)
        # What each node can give each query at most; sums that doubles round are rounded outwards.
        with np.errstate(over="ignore", invalid="ignore"):
            most = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
            size = np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.high)).T
            most = np.where(size > EXACT / 2, most + size * (queries.shape[1] + 2) * 2.0**-51, most)
        most[~np.isfinite(size)] = np.inf
        for i, query in enumerate(queries):
            least = int(bounds[i]) if bounds is not None and bounds[i] > UNFILLED else -np.inf
            ids, values = np.empty(0, np.int64), np.empty(0, np.int64)
            bound = most[i].tolist()
            heap = [(-bound[0], 0)]
            while heap and -heap[0][0] >= least:
                _, node = heapq.heappop(heap)
                if self.leaves[node] is None:
                    for child in self.children[node]:
                        if bound[child] >= least:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                there, vectors = self.leaves[node]
                products = exact_products(vectors, query)
                wanted = (products >= least) & (there != own[i])
                if wanted.any():
                    ids, values = best(np.concatenate([ids, there[wanted]]), np.concatenate([values, products[wanted]]), k)
                    if len(values) == k:
                        least = max(least, int(values[-1]))
            near[i, : len(ids)], scores[i, : len(ids)] = ids, values
        return near, scores


def top(table: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the queries, the rows whose id is divisible by ``every``."""
    scratch = Scratch(table.sparkSession)
    rounded = lambda rows: rows.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double")))
    shards, blocks, count = shards_and_blocks(scratch, table, id_column, vector, every, SHARD_ROWS, BLOCK_ROWS, nonzero=False, prepare=rounded)
    search = lambda index, ids, queries, bounds: index.search(ids, queries, bounds, k)
    at = blocks.withColumn("shard", F.pmod(F.col("block"), F.lit(count)))
    home = scratch.keep(meeting(shards, at, Tree, search, k, np.int64), "first")
    every_shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("other")
    # A block whose first shard held other lengths only goes everywhere without a bound.
    bound = blocks.join(home.groupBy("block").agg(F.max("scores").alias("scores")), "block", "left").withColumn("first", F.pmod(F.col("block"), F.lit(count)))
    rest = bound.select("*", every_shard).filter("other != first").withColumn("shard", F.col("other"))
    found = home.unionByName(meeting(shards, rest, Tree, search, k, np.int64))
    return ranked(found, k, np.int64)
