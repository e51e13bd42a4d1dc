"""Approximate nearest neighbours by largest inner product: a hash-prefix forest per shard.

Vectors are lifted by one component so that all of a shard have one length; then the largest
inner product is the smallest angle. Each of ``TREES`` trees is a sorted array of
``BITS``-bit strings, the sides of random hyperplanes through the shard's mean. A query
descends in each tree to its longest matching prefix; then all trees ascend together, a bit at
a time, until the matches of that prefix length are ``WANTED`` times the shard's rows.
These are scored exactly, in double precision, on the original vectors; where they are fewer
than asked for, all rows of the shard are.

Measured recall and how rows without a usable vector are treated: README and ``vectors``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch
from .vectors import best, blank, meeting, ranked, shards_and_blocks

TREES, BITS = 16, 64
SHARD_ROWS = 8192
BLOCK_ROWS = 1024
WANTED = 1.5  # matches over all trees, as a share of the shard's rows, before doubles are merged


class Forest:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        norms = (vectors * vectors).sum(axis=1)
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))])
        self.mean = lifted.mean(axis=0)
        self.planes = np.random.default_rng(11).standard_normal((TREES * BITS, lifted.shape[1]))
        strings = self.strings(lifted)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def strings(self, lifted: np.ndarray) -> np.ndarray:
        """The hash strings of vectors, a row for each tree."""
        out = np.zeros((TREES, len(lifted)), np.uint64)
        for start in range(0, len(lifted), 1024):
            sides = (lifted[start : start + 1024] - self.mean) @ self.planes.T > 0
            for tree in range(TREES):
                bits = np.packbits(sides[:, tree * BITS : (tree + 1) * BITS], axis=1)
                out[tree, start : start + 1024] = np.ascontiguousarray(bits).view(">u8").ravel()
        return out

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ranges of the trees at the longest prefix that has enough matches."""
        asked = self.strings(np.column_stack([queries, np.zeros(len(queries))]))
        low, high = np.zeros((TREES, len(queries)), np.int64), np.full((TREES, len(queries)), len(self.ids))
        going = np.arange(len(queries))
        # Ascend from the longest prefix that can still have several matches.
        for length in range(min(BITS, 4 + int(np.log2(len(self.ids) + 1))), 0, -1):
            first = asked[:, going] >> np.uint64(BITS - length) << np.uint64(BITS - length)
            last = first | np.uint64((1 << (BITS - length)) - 1)
            a = np.stack([np.searchsorted(self.sorted[t], first[t], "left") for t in range(TREES)])
            b = np.stack([np.searchsorted(self.sorted[t], last[t], "right") for t in range(TREES)])
            enough = (b - a).sum(axis=0) >= WANTED * len(self.ids)
            low[:, going[enough]], high[:, going[enough]] = a[:, enough], b[:, enough]
            going = going[~enough]
        return low, high

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        near, scores = blank(len(own), k)
        low, high = self.ranges(queries)
        for i in range(len(own)):
            found = np.zeros(len(self.ids), bool)
            for tree in range(TREES):
                found[self.order[tree, low[tree, i] : high[tree, i]]] = True
            others = self.ids != own[i]
            rows = np.flatnonzero(found & others)
            if len(rows) < k:  # ascend to the roots: all rows match the empty prefix
                rows = np.flatnonzero(others)
            ids, values = best(self.ids[rows], (self.vectors[rows] * queries[i]).sum(axis=1), k)
            near[i, : len(ids)], scores[i, : len(ids)] = ids, values
        return near, scores


def nearest(table: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the queries, the rows whose id is divisible by ``every``."""
    scratch = Scratch(table.sparkSession)
    shards, blocks, count = shards_and_blocks(scratch, table, id_column, vector, every, SHARD_ROWS, BLOCK_ROWS, nonzero=True)
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    return ranked(meeting(shards, blocks, Forest, lambda index, ids, queries, _: index.search(ids, queries, k), k), k)
