"""Vectors in shards, query vectors in blocks, and the meeting of the two.

A shard is a run of at most ``rows`` vectors of one length, packed into one row; a block is the
same for queries. Every block meets every shard in a task of bounded size. A vector
that is null, empty, or holds a null or non-finite component takes no part, nor does a row
without an id. Every row is a candidate of its own, also where ids or vectors repeat; a query
is not its own neighbour, nor is any row with its id. Of repeated query ids the one with the least
vector asks. Vectors of different lengths never meet. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch
from .words import column

PACKED = "dim int, ids binary, vectors binary"
FOUND = "block long, shard long, dim int, ids binary, vectors binary, near binary, scores binary"


def usable(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``id, v`` of the rows that take part."""
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & (F.size("v") > 0) & finite)


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows ``id, v`` in packs of at most ``size`` vectors of one length, as they lie in the partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def pack(dim: int, last: bool) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([i for i, _ in held[dim]])
            vectors = np.concatenate([v for _, v in held[dim]])
            upto = len(ids) if last else len(ids) // size * size
            for start in range(0, upto, size):
                part = slice(start, min(start + size, upto))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([ids[part].tobytes()], pa.binary()), pa.array([vectors[part].tobytes()], pa.binary())],
                    names=["dim", "ids", "vectors"],
                )
            held[dim] = [(ids[upto:], vectors[upto:])]

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = column(batch, "v")
            ids, sizes = column(batch, "id").to_numpy(), lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy()
            begins = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                held.setdefault(dim, []).append((ids[own], flat[begins[own, None] + np.arange(dim)]))
                if sum(len(i) for i, _ in held[dim]) >= size:
                    yield from pack(dim, last=False)
        for dim in held:
            if sum(len(i) for i, _ in held[dim]):
                yield from pack(dim, last=True)

    return rows.mapInArrow(run, PACKED)


def numbered(packs: DataFrame, name: str) -> DataFrame:
    """Packs with a number from 0 on; only the few keys of the packs are ordered in one task."""
    keyed = packs.withColumn("key", F.xxhash64("ids", "vectors"))
    order = keyed.groupBy("key").count().select("key", (F.row_number().over(Window.orderBy("key")) - 1).cast("long").alias("group"))
    # Equal packs (the same rows again) share a key: each gets a number of its own below it.
    return keyed.join(order, "key").withColumn(name, F.col("group")).drop("key", "group")


# The score of a place not filled, where scores are integers.
UNFILLED = np.iinfo(np.int64).min


def shards_and_blocks(scratch: Scratch, table: DataFrame, id_column: str, vector: str, every: int, shard_rows: int, block_rows: int, nonzero: bool, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame, int]:
    rows = prepare(usable(table, id_column, vector))
    if nonzero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    shards = scratch.keep(numbered(scratch.keep(packed(rows, shard_rows), "packs"), "shard"), "shards")
    asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks = scratch.keep(numbered(scratch.keep(packed(asked, block_rows), "packs"), "block"), "blocks")
    return shards, blocks, (shards.agg(F.max("shard").alias("n")).first()["n"] or 0) + 1


Search = Callable[[object, np.ndarray, np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]]


def meeting(shards: DataFrame, blocks: DataFrame, build: Callable[[np.ndarray, np.ndarray], object], search: Search, k: int, kind: type = np.float64) -> DataFrame:
    """Search every block's queries in the index of the shard it is sent to (``blocks`` has a ``shard``).

    ``search(index, ids, queries, bounds)`` returns ids and scores, k for each query, best first;
    places not filled have id -1. ``scores`` of the block, if any, bound what is wanted;
    ``kind`` is their type.
    """
    some = "scores" in blocks.columns
    both = shards.select("shard", F.lit(-1).cast("long").alias("block"), "dim", "ids", "vectors", F.lit(None).cast("binary").alias("scores"))
    both = both.unionByName(blocks.select("shard", "block", "dim", "ids", "vectors", (F.col("scores") if some else F.lit(None).cast("binary")).alias("scores")))
    both = both.repartition("shard").sortWithinPartitions("shard", "block")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, indexes = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != now:
                    now, indexes = row["shard"], []
                ids = np.frombuffer(row["ids"], np.int64)
                vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["dim"])
                if row["block"] < 0:
                    indexes.append((row["dim"], build(ids, vectors)))
                    continue
                bounds = np.frombuffer(row["scores"], kind).reshape(len(ids), k)[:, -1] if row["scores"] is not None else None
                for dim, index in indexes:
                    if dim == row["dim"]:
                        near, scores = search(index, ids, vectors, bounds)
                        values = [row["block"], now, dim, row["ids"], row["vectors"], near.tobytes(), scores.tobytes()]
                        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["block", "shard", "dim", "ids", "vectors", "near", "scores"])

    return both.mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int, kind: type = np.float64) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best over all shards, ties to the smaller id."""

    def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["ids", "near", "scores"]).to_pylist():
                asked = np.repeat(np.frombuffer(row["ids"], np.int64), k)
                near, scores = np.frombuffer(row["near"], np.int64), np.frombuffer(row["scores"], kind)
                real = np.isfinite(scores) if kind is np.float64 else scores > UNFILLED
                yield pa.RecordBatch.from_arrays([pa.array(x[real]) for x in (asked, near, scores)], names=["query_id", "vec_id", "score"])

    rows = found.mapInArrow(unpacked, f"query_id long, vec_id long, score {'double' if kind is np.float64 else 'long'}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, ties to the smaller id, exactly."""
    if len(scores) > 4 * k:
        some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[some], scores[some]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def blank(count: int, k: int, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    return np.full((count, k), -1, np.int64), np.full((count, k), -np.inf if kind is np.float64 else UNFILLED, kind)
