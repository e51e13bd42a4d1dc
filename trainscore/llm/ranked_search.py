"""Ranked lexical search: a document tree per shard, branch and bound per item.

Documents are read once and reduced to the terms that items use: a vector of terms and counts, and
the number of all terms. Document frequencies, the number of documents and of terms are sums over
all documents. Each task then takes shards of documents; a shard's vectors, most frequent
term first, are the paths of a trie (an FP-tree): documents that begin alike share a path, and a
path without branches is one node. Small siblings share a leaf. Each node holds, for every
term below it, the largest count, and the least length value ``m`` of its documents: what an item
scores with these is no less than any score below. An item's search goes depth first, the better
bounded child first, and leaves out what cannot beat the item's k-th score; that score is carried
from shard to shard of the task. Leaves are scored exactly; no document is left out otherwise.

A score is the sum over an item's terms, repeats included, of ``w * (10^9 tf div (1000 tf + 8 m))``
with ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and ``m = 25 + 75 n N div L``.

Items are searched in blocks of at most ``BLOCK_BYTES`` of distinct texts (one text at least),
so what is sent to the executors is bounded; each block is one pass over the documents.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, only A-Z lowered. Null and
empty texts have no terms: such documents are not counted, such items have no rows. Each row of
documents is a document of its own and each row of items an item of its own, whatever their ids; equal scores
go by ascending id, null ids last. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Scratch
from .words import Words, bounded, column, whole

BLOCK_BYTES = 8 << 20  # of distinct item texts in one pass
LEAF = 64  # documents
SHARD_ROWS, SHARD_ENTRIES = 16_384, 4 << 20
TASK_ROWS = 1 << 18  # documents of one task, in several shards
LEVELS = 24  # of a trie; what lies deeper is cut into leaves as it is ordered

# Every byte of a term as it counts, any other as a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(texts: pa.Array) -> Words:
    """The terms of texts, text after text."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int32)
    letters = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes().translate(TERM_BYTES) if data else b""
    return Words(pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(letters)))


class Items(NamedTuple):
    """A block of items: distinct terms, and each distinct text's digest with its terms and their repeats."""

    vocabulary: pa.Array
    keys: list[str]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def block_of(texts: list[str]) -> Items:
    found = terms(pa.array(texts, pa.string()))
    parts = [np.unique(row, return_counts=True) for row in found.rows(found.numbers)]
    keys = [hashlib.sha256(text.encode()).hexdigest() for text in texts]
    return Items(pa.array(found.distinct.tolist(), pa.string()), keys, [p[0] for p in parts], [p[1] for p in parts])


def restricted(docs: DataFrame, vocabulary: pa.Array, text: str, id_column: str) -> DataFrame:
    """``id, n, terms, counts``: a document's number of terms, and those of the vocabulary with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = shared.value, max(len(shared.value), 1)
        for rows_in in batches:
            for batch in bounded(rows_in):
                words = terms(column(batch, "text"))
                place = pc.index_in(pa.array(words.distinct, pa.string()), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                numbers = place[words.numbers] if len(place) else words.numbers
                row = np.repeat(np.arange(batch.num_rows), words.lengths)
                used = numbers >= 0
                pairs, counts = np.unique(row[used] * size + numbers[used], return_counts=True)
                offsets = pa.array(np.searchsorted(pairs, np.arange(batch.num_rows + 1) * size), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "id"),
                        pa.array(words.lengths, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(pairs % size, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
                    ],
                    names=["id", "n", "terms", "counts"],
                )

    rows = docs.select(F.col(id_column).alias("id"), whole(text).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, terms array<int>, counts array<int>")


class Tree:
    """The trie of a shard: documents in the order of its paths, and its nodes with their bounds."""

    def __init__(self, ids: list[Any], m: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, counts: np.ndarray):
        row = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(row.astype(np.int64) << 32 | ranks, kind="stable")
        ranks, counts = ranks[order], counts[order]
        begin = np.cumsum(sizes) - sizes
        paths = ranks.astype(">u4")
        key = [paths[s : s + n].tobytes() for s, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
        by_path = np.array(sorted(range(len(ids)), key=key.__getitem__), np.int64)
        sizes, begin = sizes[by_path], begin[by_path]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(self.starts[-1]) + np.repeat(begin - self.starts[:-1], sizes)
        self.terms, counts = ranks[take], counts[take].astype(np.int64)
        self.row = np.repeat(np.arange(len(ids)), sizes)
        self.ids, self.m = [ids[i] for i in by_path.tolist()], m[by_path]
        self.gain = 1_000_000_000 * counts // (1000 * counts + 8 * self.m[self.row])
        self._grow()
        self._bound(counts)

    def _grow(self) -> None:
        """Nodes as ranges of documents; a node's children have consecutive numbers."""
        count = len(self.ids)
        self.nodes, self.children, self.level = [(0, count)], {}, [0]
        sizes, open_ = np.diff(self.starts), [(0, 0)]
        while open_:
            node, depth = open_.pop()
            a, b = self.nodes[node]
            if b - a <= LEAF:
                continue
            first, last = (self.terms[self.starts[i] + depth : self.starts[i + 1]] for i in (a, b - 1))
            n = min(len(first), len(last))
            differ = np.flatnonzero(first[:n] != last[:n])
            depth += int(differ[0]) if len(differ) else n  # a path without branches
            more = sizes[a:b] > depth
            branch = np.full(b - a, -1, np.int64)
            branch[more] = self.terms[self.starts[a:b][more] + depth]
            edges = [0, *(np.flatnonzero(np.diff(branch)) + 1).tolist(), b - a]
            if len(edges) == 2 or self.level[node] >= LEVELS:
                cuts = [*range(a, b, LEAF), b]  # equal paths, or deep enough
                parts = [(s, e, False) for s, e in zip(cuts, cuts[1:], strict=False)]
            else:
                parts, held = [], 0
                for s, e in zip(edges, edges[1:], strict=False):
                    if e - held > LEAF and s > held:
                        parts.append((a + held, a + s, False))
                        held = s
                    if e - s > LEAF:
                        parts.append((a + s, a + e, True))
                        held = e
                if held < b - a:
                    parts.append((a + held, b, False))
            self.children[node] = (len(self.nodes), len(self.nodes) + len(parts))
            for s, e, grows in parts:
                if grows:
                    open_.append((len(self.nodes), depth + 1))
                self.nodes.append((s, e))
                self.level.append(self.level[node] + 1)

    def _bound(self, counts: np.ndarray) -> None:
        """For each node the least m, for each of its terms the largest count; kept term by term."""
        spans, level = np.array(self.nodes), np.array(self.level)
        self.least = np.array([self.m[a:b].min() for a, b in self.nodes])
        order = np.argsort(self.terms, kind="stable")  # by term, then in the order of paths: a node's entries stand together
        term, row, counts = self.terms[order].astype(np.int64), self.row[order], counts[order]
        entries = []
        for k in range(int(level.max()) + 1) if len(term) else ():
            at = np.flatnonzero(level == k)
            width = np.diff(spans[at], axis=1)[:, 0]
            owner = np.full(len(self.ids), -1, np.int64)
            owner[np.arange(width.sum()) + np.repeat(spans[at, 0] - (np.cumsum(width) - width), width)] = np.repeat(at, width)
            owner = owner[row]
            heads = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(owner, prepend=-2) != 0))
            most = np.maximum.reduceat(counts, heads)
            kept = owner[heads] >= 0
            entries.append((term[heads][kept], owner[heads][kept], most[kept]))
        term, node, most = (np.concatenate(x) for x in zip(*entries, strict=True)) if entries else (np.empty(0, np.int64),) * 3
        order = np.argsort(term, kind="stable")
        term, self.node_of, most = term[order], node[order], most[order]
        self.node_gain = 1_000_000_000 * most // (1000 * most + 8 * self.least[self.node_of])
        self.held_terms, at = np.unique(term, return_index=True)
        self.held_ends = np.append(at, len(term))

    def bounds(self, ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What an item can score in each node at most."""
        at = np.searchsorted(self.held_terms, ranks)
        here = np.flatnonzero((at < len(self.held_terms)) & (self.held_terms[np.minimum(at, len(self.held_terms) - 1)] == ranks))
        first, last = self.held_ends[at[here]], self.held_ends[at[here] + 1]
        width = last - first
        take = np.arange(width.sum()) + np.repeat(first - (np.cumsum(width) - width), width)
        out = np.zeros(len(self.nodes), np.int64)
        np.add.at(out, self.node_of[take], np.repeat(weights[here], width) * self.node_gain[take])
        return out

    def search(self, ranks: np.ndarray, weights: np.ndarray, weight_of: np.ndarray, best: list, k: int) -> int:
        """Improve an item's ``best`` (score, id, in order); returns how many documents were scored."""
        if not len(self.held_terms):
            return 0
        bound, scored, open_ = self.bounds(ranks, weights), 0, [0]
        weight_of[ranks] = weights
        while open_:
            node = open_.pop()
            if bound[node] <= 0 or (len(best) == k and bound[node] < best[-1][0]):
                continue
            if node in self.children:
                first, last = self.children[node]
                open_ += (first + np.argsort(bound[first:last], kind="stable")).tolist()
                continue
            a, b = self.nodes[node]
            scored += b - a
            span = slice(self.starts[a], self.starts[b])
            value = weight_of[self.terms[span]] * self.gain[span]
            scores = np.zeros(b - a, np.int64)
            np.add.at(scores, self.row[span] - a, value)
            good = np.flatnonzero(scores >= (best[-1][0] if len(best) == k else 1))
            if len(good):
                best += [(int(scores[i]), self.ids[a + i]) for i in good.tolist()]
                best.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
                del best[k:]
        weight_of[ranks] = 0
        return scored


def _batches_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Shards: as many rows as the bounds of a shard allow, a row at least."""
    held: list[pa.RecordBatch] = []
    rows = entries = 0
    for batch in batches:
        upto = np.asarray(column(batch, "terms").offsets, np.int64)
        at = 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(upto, upto[at] + SHARD_ENTRIES - entries, "right")) - 1
            end = max(at + (not rows), min(fits, at + SHARD_ROWS - rows, batch.num_rows))
            if end > at:
                held.append(batch.slice(at, end - at))
                rows, entries = rows + end - at, entries + int(upto[end] - upto[at])
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, rows, entries = [], 0, 0
            at = end
    if held:
        yield pa.Table.from_batches(held)


def _best(spark: SparkSession, rows: DataFrame, items: Items, k: int) -> DataFrame:
    """``key, id, score``: each item's k best of every task."""
    total = rows.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms"), F.count_if(F.size("terms") > 0).alias("used")).first()
    documents, all_terms = total["documents"], total["terms"] or 0
    # As many rows as the vocabulary at most.
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toPandas()
    df = np.zeros(len(items.vocabulary), np.int64)
    df[held["term"].to_numpy(np.int64)] = held["df"].to_numpy(np.int64)
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    order = np.argsort(-df, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by_item = [(key, rank[t], weight[t] * n) for key, t, n in zip(items.keys, items.terms, items.repeats, strict=True) if len(t)]
    shared = spark.sparkContext.broadcast((rank, by_item))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, by_item = shared.value
        weight_of, best = np.zeros(len(rank), np.int64), [[] for _ in by_item]
        kind = pa.int64()
        for shard in _batches_of(batches):
            shard = shard.combine_chunks()
            kind = shard.schema.field("id").type
            lists = shard["terms"].combine_chunks()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            m = np.array([25 + 75 * n * documents // all_terms for n in shard["n"].to_pylist()], np.int64)
            counts = shard["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            tree = Tree(shard["id"].to_pylist(), m, sizes, rank[lists.flatten().to_numpy(zero_copy_only=False)], counts)
            for (_, ranks, weights), found in zip(by_item, best, strict=True):
                tree.search(ranks, weights, weight_of, found, k)
        found = [(key, i, score) for (key, *_), rows in zip(by_item, best, strict=True) for score, i in rows]
        if found:
            keys, ids, scores = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, kind), pa.array(scores, pa.int64())], names=["key", "id", "score"])

    parts = max(math.ceil(total["used"] / TASK_ROWS), min(2 * spark.sparkContext.defaultParallelism, math.ceil(total["used"] / LEAF / LEAF)), 1)
    dealt = rows.filter(F.size("terms") > 0).repartition(parts)
    return dealt.mapInArrow(run, f"key string, id {rows.schema['id'].dataType.simpleString()}, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", id_column: str = "doc_id", item_column: str = "item_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k best documents with a score above 0."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    asked = items.select(F.col(item_column).alias("item"), whole(text).alias("text"))
    distinct = asked.select("text").distinct()
    stored = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(stored / BLOCK_BYTES))
    found = []
    for block in range(blocks):
        part = block_of([r.text for r in distinct.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()])
        rows = scratch.keep(restricted(docs, part.vocabulary, text, id_column), "terms")
        found.append(_best(spark, rows, part, k))
    place = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    asked = asked.select("item", F.sha2("text", 256).alias("key"))
    return asked.join(best, "key").select(F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score")
