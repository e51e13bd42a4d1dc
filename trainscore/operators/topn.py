"""Exact top-N items per user from the two factor tables of a recommender.

Scoring all items for a user is a matrix product. Users are cut into blocks by a hash
of their ids, items into packs of a bounded number of rows, one row each, and packs into chunks. A task takes
one block and one chunk: it holds its users and their best N so far while the packs stream by. Only packs are
replicated, once to each block, and users, once to each chunk; where there are several chunks, the lists of a user are
merged by a shuffle. What a task holds and rates is bounded, whatever the number of users and items. Among equal
ratings the smaller item id is better.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USERS_PER_BLOCK = 262_144
ITEMS_PER_CHUNK = 262_144
# Users go to each chunk and lists come from each: where blocks make enough tasks, so many chunks are one.
CHUNKS_TOGETHER = 4
TASKS_PER_CORE = 4
# A user may be done with the items after any pack: small ones spare more pairs.
ITEMS_PER_PACK = 2_048
# Fewer users than this are not worth a task of their own.
MIN_USERS_PER_BLOCK = 1_024
# Users and items multiplied at a time: the score matrix, 4 MB, stays in a cache.
USERS_PER_STEP = 512
ITEMS_PER_STEP = 2_048
# Packs that most users need are multiplied together up to this number of items.
ITEMS_TOGETHER = 2_048
# With more candidates a user than this in a step, whole rows are ordered.
FEW = 8

PACKS = "ids binary, factors binary, norm double"
# Ratings are sums of 32-bit products: what rounding may add to one, as a share of its bound.
SLACK = 1e-4
LISTS = "user int, items array<int>, ratings array<float>"


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)


def packs(items: DataFrame, size: int) -> DataFrame:
    """``id, features`` rows packed by their length, at most ``size`` to a row, with the greatest length."""
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda total, x: total + x.cast("double") * x)).alias("norm")
    by_norm = items.select("id", "features", norm).repartitionByRange(F.desc("norm")).sortWithinPartitions(F.desc("norm"), "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                ids = part.column(0).to_numpy().astype(np.int64)
                values = [pa.array([x.tobytes()], pa.binary()) for x in (ids, _matrix(part.column(1)))]
                yield pa.RecordBatch.from_arrays([*values, part.column(2).slice(0, 1)], names=["ids", "factors", "norm"])

    return by_norm.mapInArrow(run, PACKS)


class Best:
    """The best N items of each user of a block, over the packs seen so far."""

    def __init__(self, ids: np.ndarray, factors: np.ndarray, n: int) -> None:
        self.ids, self.factors, self.n = ids, factors, n
        self.norms = np.linalg.norm(factors.astype(np.float64), axis=1)
        self.items = np.empty((len(ids), 0), np.int64)
        self.ratings = np.empty((len(ids), 0), np.float32)

    def needing(self, norm: float) -> np.ndarray:
        """The users, by place, whose lists an item no longer than ``norm`` can better."""
        if self.items.shape[1] < self.n:
            return np.arange(len(self.ids))
        return np.flatnonzero(~(self.norms * norm * (1 + SLACK) < self.ratings[:, -1]))

    def meet(self, item_ids: np.ndarray, item_factors: np.ndarray, norm: float = np.inf) -> int:
        """Take in a pack whose items are no longer than ``norm``; returns how many pairs were rated."""
        pairs = 0
        for first in range(0, len(item_ids), ITEMS_PER_STEP):
            some, factors = item_ids[first : first + ITEMS_PER_STEP], item_factors[first : first + ITEMS_PER_STEP]
            users, had = self.needing(norm), self.items.shape[1]
            kept = min(self.n, had + len(some))
            items, ratings = self.items, self.ratings
            if had < self.n:
                items, ratings = np.empty((len(users), kept), np.int64), np.empty((len(users), kept), np.float32)
            for start in range(0, len(users), USERS_PER_STEP):
                step = users[start : start + USERS_PER_STEP]
                scores = self.factors[step] @ factors.T
                if had == self.n:
                    good = np.flatnonzero(scores >= ratings[step, -1:])
                    if len(good) <= FEW * len(step):
                        self._take_in(step, good // len(some), some[good % len(some)], scores.ravel()[good])
                        continue
                items[step], ratings[step] = self._better(step, some, scores, kept)
            self.items, self.ratings = items, ratings
            pairs += len(users) * len(some)
        return pairs

    def _take_in(self, step: np.ndarray, rows: np.ndarray, item_ids: np.ndarray, scores: np.ndarray) -> None:
        """Few candidates, each for the user at its row of the step, whose lists are full."""
        if not len(rows):
            return
        who = np.unique(rows)
        users = step[who]
        of = np.concatenate([np.repeat(who, self.n), rows])
        ids = np.concatenate([self.items[users].ravel(), item_ids])
        ratings = np.concatenate([self.ratings[users].ravel(), scores])
        order = np.lexsort((ids, -ratings, of))
        firsts = np.searchsorted(of[order], who)
        best = order[firsts[:, None] + np.arange(self.n)]
        self.items[users], self.ratings[users] = ids[best], ratings[best]

    def _better(self, step: np.ndarray, item_ids: np.ndarray, scores: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
        own = self.items[step]
        scores = np.hstack([self.ratings[step], scores])
        beyond = scores.shape[1] - kept

        def ids_at(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
            out = item_ids[np.maximum(at - own.shape[1], 0)]
            mine = at < own.shape[1]
            out[mine] = own[rows[mine], at[mine]]
            return out

        at = np.argpartition(scores, beyond, axis=1)[:, beyond:] if beyond else np.broadcast_to(np.arange(kept), (len(step), kept))
        ratings = np.take_along_axis(scores, at, 1)
        ids = ids_at(at, np.broadcast_to(np.arange(len(step))[:, None], at.shape))
        if beyond:
            # Where more items than fit reach the Nth rating, all of them are ordered, so that no tie is cut by chance.
            least = ratings.min(axis=1)
            for row in np.flatnonzero((scores >= least[:, None]).sum(axis=1) > kept):
                some = np.flatnonzero(scores[row] >= least[row])
                tied = ids_at(some, np.full(len(some), row))
                best = np.lexsort((tied, -scores[row, some]))[:kept]
                ids[row], ratings[row] = tied[best], scores[row, some[best]]
        order = np.lexsort((ids, -ratings), axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(ratings, order, 1)

    def lists(self) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(self.ids) + 1, dtype=np.int32) * self.items.shape[1])
        items = pa.ListArray.from_arrays(ends, pa.array(self.items.ravel().astype(np.int32)))
        ratings = pa.ListArray.from_arrays(ends, pa.array(self.ratings.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(self.ids.astype(np.int32)), items, ratings], names=["user", "items", "ratings"])


def top_items(
    users: DataFrame,
    items: DataFrame,
    n: int,
    n_users: int,
    items_per_pack: int = ITEMS_PER_PACK,
    rated: Accumulator[int] | None = None,
    n_items: int | None = None,
) -> DataFrame:
    """``user, recommendations array<struct<item int, rating float>>``, best first.

    ``users`` and ``items`` are ``id int, features array<float>``; ``items`` may be
    ``packs`` already. ``n_users`` and ``n_items`` (counted, unless told) only set the number of blocks and
    chunks. ``rated`` counts the pairs that were rated.
    """
    cores = users.sparkSession.sparkContext.defaultParallelism
    if n_items is None:
        n_items = items.agg(F.sum(F.length("ids") / 8)).first()[0] or 0 if "factors" in items.columns else items.count()
    blocks = max(1, math.ceil(n_users / USERS_PER_BLOCK), min(cores, math.ceil(n_users / MIN_USERS_PER_BLOCK)))
    chunks = min(math.ceil(n_items / ITEMS_PER_CHUNK), math.ceil(TASKS_PER_CORE * cores / blocks))
    chunks = max(1, chunks, math.ceil(n_items / (ITEMS_PER_CHUNK * CHUNKS_TOGETHER)))
    packed = items if "factors" in items.columns else packs(items, items_per_pack)

    def every(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    # The cell of a block and a chunk is a partition. Chunks hold packs of all lengths, so that each soon has good lists.
    nothing = F.lit(None).cast("binary")
    unset = F.lit(None).cast("double").alias("norm")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = users.select("id", "features", every(chunks).alias("chunk")).select(
        (block * chunks + F.col("chunk")).alias("cell"), F.lit(0).alias("kind"), "id", "features", nothing.alias("ids"), nothing.alias("factors"), unset
    )
    none = F.lit(None)
    chunk = F.pmod(F.xxhash64("ids"), F.lit(chunks)).cast("int")
    right = packed.select("ids", "factors", "norm", every(blocks).alias("block")).select(
        (F.col("block") * chunks + chunk).alias("cell"), F.lit(1).alias("kind"), none.cast("int").alias("id"), none.cast("array<float>").alias("features"), "ids", "factors", "norm"
    )
    rows = left.unionByName(right).repartitionById(blocks * chunks, "cell").sortWithinPartitions("kind", F.desc("norm"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids, factors = None, [], []
        waiting: list[tuple[np.ndarray, np.ndarray, float]] = []

        def meet() -> None:
            pairs = best.meet(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), waiting[0][2])
            waiting.clear()
            if rated is not None:
                rated.add(pairs)

        for batch in batches:
            split = int((batch.column(1).to_numpy() == 0).sum())
            if split:
                part = batch.slice(0, split)
                ids.append(part.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
                factors.append(_matrix(part.column(3)))
            if batch.num_rows and not ids:
                return  # a chunk without users
            for row in batch.slice(split).select([4, 5, 6]).to_pylist():
                best = best or Best(np.concatenate(ids), np.concatenate(factors), n)
                needing = len(best.needing(row["norm"]))
                if needing:
                    item_ids = np.frombuffer(row["ids"], np.int64)
                    waiting.append((item_ids, np.frombuffer(row["factors"], np.float32).reshape(len(item_ids), -1), row["norm"]))
                    full = best.items.shape[1] == n and 2 * needing > len(best.ids)
                    if not full or sum(len(w[0]) for w in waiting) >= ITEMS_TOGETHER:
                        meet()
        if best is not None:
            if waiting:
                meet()
            yield best.lists()

    lists = rows.mapInArrow(run, LISTS)
    zipped = F.arrays_zip(F.col("items").alias("item"), F.col("ratings").alias("rating")).cast("array<struct<item:int,rating:float>>")
    found = lists.select("user", zipped.alias("recommendations"))
    if chunks == 1:
        return found
    # Each list holds the best of its chunk: among them are the best of all.
    swapped = F.transform("recommendations", lambda x: F.struct((-x["rating"]).alias("less"), x["item"].alias("item")))
    merged = found.groupBy("user").agg(F.flatten(F.collect_list(swapped)).alias("all"))
    best_of = F.slice(F.array_sort("all"), 1, n)
    ordered = F.transform(best_of, lambda x: F.struct(x["item"].alias("item"), (-x["less"]).alias("rating")))
    return merged.select("user", ordered.alias("recommendations"))
