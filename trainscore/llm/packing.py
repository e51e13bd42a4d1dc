"""Packing documents into windows: each seed draws its lexical neighbours from a BM25 index.

Document frequencies, their number and mean length are those of all documents. Each document has
a key, two terms drawn by a hash in proportion to their BM25 weights among those that another
document has too: the more weight two documents share, the likelier they draw the same. All
documents are range-partitioned and sorted by it, so that neighbours meet wherever they lay. A
shard is a run of about ``SHARD_TOKENS`` tokens in that order; it has an inverted index
of its own, whose terms are token ids. A window starts with what is left of
a cut document, or with the first unused one, its seed; the unused documents of the shard that
score best for the seed's terms follow until the window is full, and the last is cut. What remains of a
shard is cut into sequences whose lengths are powers of two, so no sequence is padded.

Ids are written once and shuffled once; documents of one key are told apart by a hash, so that
a common key spreads over partitions. A shard is packed in one task, whose memory a
shard, or the longest document, bounds; the frequencies are bounded by the vocabulary. Sequence ids hold the partition and a number in it.

A null text counts as empty: one token, the end. Repeated rows and ids are packed row by row;
ties go to the document that is earlier in the shard. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, encoder, forget_encoders, send_vocabulary, spread
from .tables import Scratch
from .words import bounded, column, mixed, whole

WINDOW = 2048
END = 1
SHARD_TOKENS = 1 << 20
SHARDS = 4  # of a partition
K1, B = 1.2, 0.75

Piece = tuple[int, int, int, int, int]  # document, start, length, sequence, offset


@dataclass
class Corpus:
    """Of all documents: how many have each term, their number, their mean length."""

    df: np.ndarray
    count: int
    mean: float

    @cached_property
    def idf(self) -> np.ndarray:
        return np.log1p((self.count - self.df + 0.5) / (self.df + 0.5))

    @cached_property
    def draw(self) -> np.ndarray:
        """An exponential number for each term, the same in every document."""
        return -np.log((mixed(np.arange(1, len(self.df) + 1)) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 1e-17)


class Bm25:
    """The inverted index of a shard: for each term its documents and their weights, by the corpus's statistics if given.

    Terms that more than one document in ``OFTEN`` has are rows of a matrix too, with a weight for each document.
    """

    OFTEN = 4

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        self.sizes = np.array([len(d) for d in docs], np.int64)
        owner = np.repeat(np.arange(len(docs)), self.sizes)
        coded, tf = np.unique(np.concatenate(docs).astype(np.int64) << 32 | owner, return_counts=True)
        term, self.owner = coded >> 32, coded & 0xFFFFFFFF
        self.terms, self.first, df = np.unique(term, return_index=True, return_counts=True)
        self.last = self.first + df
        everywhere = df if corpus is None else corpus.df[self.terms]
        count, mean = (len(docs), self.sizes.mean()) if corpus is None else (corpus.count, corpus.mean)
        idf = Corpus(everywhere, count, mean).idf
        damp = K1 * (1 - B + B * self.sizes[self.owner] / mean)
        self.weights = np.repeat(idf, df) * tf * (K1 + 1) / (tf + damp)
        self.count = len(docs)
        often = df * self.OFTEN > self.count
        self.place = np.repeat(np.arange(len(df)), df)  # each posting's term
        row = np.where(often, np.cumsum(often) - 1, -1)
        self.matrix = np.zeros((int(often.sum()), self.count))
        frequent = often[self.place]
        self.matrix[row[self.place[frequent]], self.owner[frequent]] = self.weights[frequent]
        self.row = row

    def by_document(self) -> tuple[np.ndarray, np.ndarray]:
        """The postings, document by document, and where each document's begin."""
        sizes = np.bincount(self.owner, minlength=self.count)
        return np.argsort(self.owner, kind="stable"), np.concatenate([[0], np.cumsum(sizes)])

    def scores(self, at: np.ndarray) -> np.ndarray:
        """Of all documents for distinct terms, given by their places in ``terms``."""
        row = self.row[at]
        rare, frequent = at[row < 0], np.zeros(len(self.matrix))
        frequent[row[row >= 0]] = 1
        first = self.first[rare]
        postings = spread(first, self.last[rare] - first)
        return np.bincount(self.owner[postings], self.weights[postings], self.count) + frequent @ self.matrix


def keys(docs: list[np.ndarray], corpus: Corpus) -> np.ndarray:
    """Two terms of each document, of those that another document has: a weighted MinHash."""
    sizes = np.array([len(d) for d in docs], np.int64)
    coded, tf = np.unique(np.repeat(np.arange(len(docs)), sizes) << 32 | np.concatenate(docs), return_counts=True)
    owner, term = coded >> 32, coded & 0xFFFFFFFF
    weight = corpus.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[owner] / corpus.mean))
    draw = np.where(corpus.df[term] > 1, corpus.draw[term] / weight, np.inf)
    out = np.zeros((len(docs), 2), np.int64)
    first = np.searchsorted(owner, np.arange(len(docs)))
    for place in (0, 1):
        least = np.minimum.reduceat(draw, first)
        at = np.flatnonzero(draw == least[owner])
        drawn, chosen = np.unique(owner[at], return_index=True)  # of equal draws the least term
        at = at[chosen]
        out[drawn, place] = np.where(draw[at] < np.inf, term[at] + 1, 0)
        draw[at] = np.inf
    return out[:, 0] << 32 | out[:, 1]


def packed(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[Piece]:
    """Pieces that cover each document's ids once, in full windows and then powers of two."""
    index = Bm25(docs, corpus)
    postings, begins = index.by_document()
    unused = np.ones(len(docs), bool)
    pieces: list[Piece] = []
    sequence = filled = earliest = 0
    neighbours: Iterator[int] = iter(())
    opened = []  # where the pieces of the window that is not full begin

    def seed() -> int:
        nonlocal earliest
        while earliest < len(docs) and not unused[earliest]:
            earliest += 1
        return earliest if earliest < len(docs) else -1

    def ranked(doc: int) -> Iterator[int]:
        open_ = np.flatnonzero(unused)
        scores = index.scores(index.place[postings[begins[doc] : begins[doc + 1]]])[open_]
        return (i for i in open_[np.argsort(-scores, kind="stable")].tolist() if unused[i])

    doc, start = -1, 0
    while True:
        if doc < 0:
            # Within a window the seed's next neighbour, at its beginning a new seed.
            doc, start = (next(neighbours, -1) if filled else -1), 0
            if doc < 0:
                doc = seed()
                if doc < 0:
                    break
            unused[doc] = False
        if not filled:
            opened = []
            left = len(docs[doc]) - start
            neighbours = ranked(doc) if left < window else iter(())
        length = min(window - filled, len(docs[doc]) - start)
        opened.append(len(pieces))
        pieces.append((doc, start, length, sequence, filled))
        filled, start = filled + length, start + length
        if start == len(docs[doc]):
            doc = -1
        if filled == window:
            sequence, filled = sequence + 1, 0
    if filled:
        rest = [pieces[i] for i in opened]
        del pieces[opened[0] :]
        sizes = [1 << bit for bit in range(filled.bit_length() - 1, -1, -1) if filled >> bit & 1]
        offset = 0
        for doc, start, length, _, _ in rest:
            while length:
                part = min(length, sizes[0] - offset)
                pieces.append((doc, start, part, sequence, offset))
                start, length, offset = start + part, length - part, offset + part
                if offset == sizes[0]:
                    sizes.pop(0)
                    sequence, offset = sequence + 1, 0
    return pieces


def pack(docs: DataFrame, vocabulary: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """A row for each piece: id, ``start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    scratch, name = Scratch(spark), send_vocabulary(spark, vocabulary)
    rows = docs.select(F.col(id_column).alias("id"), whole(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    size = max(len(Vocabulary(vocabulary).text), END + 1)

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of each document; a task's last row has the documents that hold each term, their number and tokens instead."""
        coder = encoder(name)
        df, count, tokens = np.zeros(size, np.int64), 0, 0
        for rows_in in batches:
            for batch in bounded(rows_in, size=8 << 20):
                held = [np.append(i, END).astype("<u4") for i in coder.encode(column(batch, "text"))]
                flat, sizes = np.concatenate(held), np.array([len(h) for h in held], np.int64)
                pairs = np.sort(np.repeat(np.arange(len(held)), sizes) << 32 | flat)
                df += np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] & 0xFFFFFFFF, minlength=size)
                count, tokens = count + len(held), tokens + len(flat)
                ids = pa.array([h.tobytes() for h in held], pa.binary())
                yield pa.RecordBatch.from_arrays([column(batch, "id"), ids, pa.nulls(len(held), pa.binary())], names=["id", "ids", "sums"])
        if count:
            sums = pa.array([np.concatenate([df, [count, tokens]]).astype("<i8").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, column(batch, "id").type), pa.nulls(1, pa.binary()), sums], names=["id", "ids", "sums"])

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of a task, number by number."""
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            for sums in column(batch, "sums").to_pylist():
                total += np.frombuffer(sums, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for rows_in in batches:
            for batch in bounded(rows_in, "ids", 4 << 20):
                yield batch, [np.frombuffer(i, "<u4") for i in column(batch, "ids").to_pylist()]

    texts = scratch.keep(rows.mapInArrow(coded, f"id {kind}, ids binary, sums binary"), "coded")
    counts = texts.select("sums").filter("sums is not null").mapInArrow(summed, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size + 2, np.int64)
    total[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    count, tokens = map(int, total[size:])
    corpus = Corpus(total[:size], count, tokens / max(count, 1))

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch, held in read(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys(held, corpus))], names=["id", "ids", "key"])

    order = ["key", "salt", "row"]
    near = texts.filter("ids is not null").select("id", "ids").mapInArrow(keyed, f"id {kind}, ids binary, key long").select("*", F.xxhash64("id", "ids").alias("salt"), F.monotonically_increasing_id().alias("row"))
    near = near.repartitionByRange(max(1, math.ceil(tokens / SHARD_TOKENS / SHARDS)), *order).sortWithinPartitions(*order).select("id", "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        first = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        ids: list[pa.Array] = []

        def shard() -> pa.RecordBatch:
            nonlocal first
            found = packed(held, corpus=corpus)
            doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*found, strict=True))
            crcs = [zlib.crc32(held[d][s : s + n].tobytes()) for d, s, n, _, _ in found]
            tokens = np.array([len(h) for h in held], np.int64)[doc]
            out = [pa.chunked_array(ids).combine_chunks().take(pa.array(doc)), *map(pa.array, (start, length)), pa.array(crcs, pa.int64()), *map(pa.array, (tokens, sequence + first, offset))]
            first += int(sequence[-1]) + 1
            held.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays(out, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch, some in read(batches):
            held += some
            ids.append(column(batch, "id"))
            if sum(map(len, held)) >= SHARD_TOKENS:
                yield shard()
        if held:
            yield shard()

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return near.mapInArrow(run, schema).withColumnRenamed("id", id_column)
