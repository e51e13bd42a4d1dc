"""Passages that repeat across documents, removed word by word: level-wise doubling.

A window of ``window`` consecutive words is removed where its word sequence starts anywhere
else. Windows are found by lengths that double up to the whole one (18, then 35): only
what repeats at one length is extended to the next. At a shorter length a
window is judged by one of its sub-windows, the one of least hash: equal windows choose
the same, so when that one starts nowhere else in the corpus, the window cannot repeat. This
leaves about one sub-window in ten to count at the first length, and none is lost.
At the last length all surviving windows are counted as they are.

Documents with the same words are one content: counted once, removed whole if there are
several rows. Counts are pre-aggregated sums over hashes; each level is a shuffle of what
survives. Windows are compared by 64-bit hashes of word sequences.

A null or empty text has no words; its digest is that of nothing. Repeated rows are copies of
each other, whatever their ids; a null id stays null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch
from .words import Words, bounded, column, grams, lists, whole

WINDOW = 35
FIRST = 18


def lengths(window: int, first: int) -> list[int]:
    """The lengths of the levels: halves of the window, rounded up, down to ``first``."""
    found = [window]
    while found[0] > first:
        found.insert(0, (found[0] + 1) // 2)
    return found


def least_of(values: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` values the place of its least one, the last of equals."""
    count = len(values) - span + 1
    if count <= 0:
        return np.empty(0, np.int64)
    best, length = np.arange(len(values)), 1
    while length < span:
        step = min(length, span - length)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] <= values[left], right, left)
        length += step
    return best


def picks(hashes: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the sub-windows of a length, and each window's chosen place among them."""
    subs = grams(hashes, length)
    return subs, least_of(subs, window - length + 1) if len(hashes) >= window else np.empty(0, np.int64)


def split_texts(texts: pa.Array) -> Words:
    return Words(pc.ascii_trim_whitespace(texts))


def digests(texts: pa.Array) -> list[bytes]:
    """SHA-256 of each text's words joined by one space."""
    joined = pc.binary_join(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts)), " ")
    return [hashlib.sha256(t.as_buffer()).digest() for t in joined]


def repeating(rows: DataFrame, hashes: str) -> DataFrame:
    """``cid, found``: of each content's hashes those that occur more than once in all rows."""
    each = rows.select("cid", F.explode(hashes).alias("hash"))
    several = each.groupBy("hash").count().filter("count > 1").select("hash")
    return each.join(several, "hash").groupBy("cid").agg(F.collect_set("hash").alias("found"))


def without_repeats(docs: DataFrame, window: int = WINDOW, first: int = FIRST, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Each row's id with ``n_words, n_removed, kept_sha256`` and ``kept``, the words left joined by one space (null: all)."""
    scratch = Scratch(docs.sparkSession)
    key = F.concat_ws(" ", F.col(id_column).cast("string"), F.xxhash64(whole(text)).cast("string")).alias("key")
    rows = docs.select(F.col(id_column).alias("id"), key, whole(text).alias("text"))
    levels = lengths(window, first)
    kind = rows.schema["id"].dataType.simpleString()

    def described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_in in batches:
            for batch in bounded(rows_in):
                words = split_texts(column(batch, "text"))
                chosen = []
                for hashes in words.rows(words.hashes()[words.numbers]):
                    subs, place = picks(hashes, window, levels[0])
                    chosen.append(subs[np.unique(place)].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "id"), column(batch, "key"), pa.array(words.lengths), pa.array(digests(column(batch, "text")), pa.binary()), lists(chosen, np.int64)],
                    names=["id", "key", "n_words", "content", "hashes"],
                )

    all_rows = scratch.keep(rows.mapInArrow(described, f"id {kind}, key string, n_words long, content binary, hashes array<long>"), "contents")
    # One row for each content; the hashes of one of its rows are those of all.
    cid = F.xxhash64("content").alias("cid")
    contents = all_rows.filter(F.col("n_words") >= window).groupBy("content").agg(F.min("key").alias("key"), F.count("*").alias("copies"), F.first("hashes").alias("hashes"))
    contents = contents.select(cid, "content", "key", "copies", "hashes")
    alive = scratch.keep(contents, "windows")
    described_rows, all_rows = all_rows, scratch.keep(all_rows.drop("hashes"), "contents")
    scratch.drop(described_rows)
    for level, length in enumerate(levels[:-1]):
        longer = levels[level + 1]
        found = repeating(alive, "hashes")
        # The texts of contents in which something survives; the same words may come with other white space.
        if "text" in alive.columns:
            source = alive.drop("hashes").join(found, "cid")
        else:
            # Several rows under a key are copies: their content is removed whole, however often it is counted.
            source = alive.drop("hashes").join(found, "cid").join(rows.select("key", "text"), "key")

        def extended(batches: Iterable[pa.RecordBatch], length: int = length, longer: int = longer) -> Iterator[pa.RecordBatch]:
            """The windows whose chosen sub-window repeats, by what they choose at the next length."""
            for rows_in in batches:
                for batch in bounded(rows_in):
                    words = split_texts(column(batch, "text"))
                    starts, chosen, mine = [], [], np.ones(len(words.lengths), bool)
                    names, shas = column(batch, "found"), digests(column(batch, "text"))
                    for i, hashes in enumerate(words.rows(words.hashes()[words.numbers])):
                        mine[i] = shas[i] == column(batch, "content")[i].as_py()
                        subs, place = picks(hashes, window, length)
                        survives = np.isin(subs, names[i].values.to_numpy().view(np.uint64))[place]
                        subs, place = picks(hashes, window, longer)
                        starts.append(np.flatnonzero(survives).astype(np.int32))
                        chosen.append(subs[np.unique(place[survives])].view(np.int64))
                    kept = [column(batch, c) for c in ("cid", "content", "key", "copies", "text")]
                    yield pa.RecordBatch.from_arrays([*kept, lists(starts, np.int32), lists(chosen, np.int64)], names=["cid", "content", "key", "copies", "text", "starts", "hashes"]).filter(pa.array(mine))

        source = source.select("cid", "content", "key", "copies", "text", "found")
        after = scratch.keep(source.mapInArrow(extended, "cid long, content binary, key string, copies long, text string, starts array<int>, hashes array<long>"), "windows")
        scratch.drop(alive)
        alive = after
    found = repeating(alive, "hashes")

    def removed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_in in batches:
            for batch in bounded(rows_in):
                texts = pc.ascii_trim_whitespace(column(batch, "text"))
                words, gone = Words(texts), []
                names = column(batch, "found")
                for i, hashes in enumerate(words.rows(words.hashes()[words.numbers])):
                    starts = np.flatnonzero(np.isin(grams(hashes, window), names[i].values.to_numpy().view(np.uint64)))
                    change = np.zeros(len(hashes) + 1, np.int64)
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + window, -1)
                    gone.append(np.cumsum(change[:-1]) > 0)
                split = pc.ascii_split_whitespace(texts)
                keep = ~np.concatenate(gone)
                counts = np.array([len(g) - g.sum() for g in gone])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), split.flatten().filter(pa.array(keep))), " ")
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "content"), pa.array([int(g.sum()) for g in gone], pa.int64()), kept], names=["content", "n_removed", "kept"]
                )

    marked = alive.filter("copies = 1").join(found, "cid").select("content", "text", "found")
    marked = marked.mapInArrow(removed, "content binary, n_removed long, kept string")
    copies = contents_with_copies(all_rows, window)
    changed = marked.unionByName(copies).select("content", "n_removed", F.sha2("kept", 256).alias("sha"), "kept")
    changed = scratch.keep(changed, "removed")
    scratch.drop(alive)
    result = all_rows.select("id", "key", "n_words", "content").join(changed, "content", "left")
    columns = [
        F.col("id").alias(id_column),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("sha", F.lower(F.hex("content"))).alias("kept_sha256"),
        "kept",
    ]
    return result.select(*columns)


def contents_with_copies(all_rows: DataFrame, window: int) -> DataFrame:
    """Contents of several rows, long enough for a window: nothing is left of them."""
    several = all_rows.filter(F.col("n_words") >= window).groupBy("content").agg(F.count("*").alias("copies"), F.max("n_words").alias("n_removed"))
    return several.filter("copies > 1").select("content", "n_removed", F.lit("").alias("kept"))
