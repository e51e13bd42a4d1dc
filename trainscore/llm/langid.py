"""Language identification by the nearest of several centroids per language.

A text's letters, lower-cased, with one space for whatever lies between them, give
character n-grams of one to three; their hashed counts, damped and weighted by rarity, form a
vector of length one. The labelled texts of a language are clustered into a few centroids
(spherical k-means); a text gets the language of the centroid with the largest cosine.
A text is rejected whose cosine is below ``SLACK`` times the ``LOW``-th percentile of what
beginnings of that language's training texts with like many n-grams have, by powers of two:
short texts are judged more mildly.

Centroids are fitted on a sample of at most about ``PER_LANGUAGE`` labelled texts of each
language, drawn row by row (a hash of id, text and place in the input, so rows that share an id or are
equal are drawn apart); it reaches the driver as sparse counts and one language at a time is made dense.
Predictions read every text whole, in one narrow pass. Without labelled texts every text is ``und``.

A null text, or one without a letter, is ``und`` with score 0 and rejected. Rows are
judged one by one, so repeated rows get equal results; ties go to the first language in
order of name. A null id counts as an empty one for the fold. Other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import bounded, column, whole

BUCKETS = 1 << 13
PER_LANGUAGE = 400
CENTROIDS = 3
ROUNDS = 10
LOW, SLACK = 5, 0.5  # percentile of the cosines with a training text's own language, and its share that is enough
LEVELS = 32
UNKNOWN = "und"


@cache
def letter_codes() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def buckets(text: str) -> np.ndarray:
    """Hash buckets of all n-grams of a text; none if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = letter_codes()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # a letter, or what ends a word
    codes = np.where(letter, codes, 32)[kept].astype(np.uint32)
    if not letter.any():
        return np.empty(0, np.uint32)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    is_letter = codes != 32
    two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:]
    three = two[:-1] * np.uint32(0x85EBCA77) + codes[2:]
    grams = np.concatenate([codes[is_letter] * np.uint32(0xC2B2AE3D), two[is_letter[:-1] | is_letter[1:]] * np.uint32(0x27D4EB2F), three[is_letter[1:-1]] * np.uint32(0x165667B1)])
    return (grams ^ grams >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def counts(text: str) -> np.ndarray:
    return np.bincount(buckets(text), minlength=BUCKETS)


def levels(rows: np.ndarray) -> np.ndarray:
    """The power of two in each text's number of n-grams."""
    return np.minimum(np.log2(np.maximum(rows.sum(axis=1), 1)).astype(np.int64), LEVELS - 1)


def limits(level: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The least cosine for each level; a level without texts has that of the one below."""
    out = np.zeros(LEVELS)
    for i in range(LEVELS):
        some = cosines[level == i]
        out[i] = SLACK * np.percentile(some, LOW) if len(some) else out[max(i - 1, 0)]
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=-1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


@dataclass
class LanguageModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    rarity: np.ndarray
    least: np.ndarray  # cosine below which a text is too far, for each centroid and level of its length

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return unit(np.log1p(rows.astype(np.float32)) * self.rarity)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosines = self.vectors(rows) @ self.centroids.T
        best = cosines.argmax(axis=1)
        return best, np.clip(cosines[np.arange(len(rows)), best], 0, 1)


def clusters(vectors: np.ndarray, k: int) -> np.ndarray:
    """Centroids of spherical k-means, started from texts far from each other."""
    chosen = [int((vectors @ unit(vectors.mean(axis=0))).argmax())]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int((vectors @ vectors[chosen].T).max(axis=1).argmin()))
    centroids = vectors[chosen]
    for _ in range(ROUNDS):
        own = (vectors @ centroids.T).argmax(axis=1)
        centroids = unit(np.stack([vectors[own == i].mean(axis=0) if (own == i).any() else centroids[i] for i in range(len(centroids))]))
    return centroids


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> LanguageModel | None:
    """Fit on the rows given (the caller leaves held-out ones away); None without any."""
    rows = labelled.select(F.col(id_column).alias("id"), whole(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & (F.col("text") != ""))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return None
    share = F.create_map(*[F.lit(x) for name, n in totals.items() for x in (name, min(1.0, PER_LANGUAGE / n))])
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text", "place"), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.minimum(counts(t), np.iinfo(np.uint32).max).astype("<u4") for t in column(batch, "text").to_pylist()]
            places = [np.flatnonzero(f) for f in found]
            values = [pa.array([f[p].tobytes() for f, p in zip(found, places, strict=True)], pa.binary())]
            places = [pa.array([p.astype("<u4").tobytes() for p in places], pa.binary())]
            yield pa.RecordBatch.from_arrays([column(batch, "lang"), *places, *values], names=["lang", "places", "counts"])

    drawn = rows.filter(draw < share[F.col("lang")])
    by_name: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    texts_with = np.zeros(BUCKETS, np.int64)
    for r in drawn.select("text", "lang").mapInArrow(run, "lang string, places binary, counts binary").collect():
        places = np.frombuffer(r["places"], "<u4")
        if len(places):
            by_name.setdefault(r["lang"], []).append((places, np.frombuffer(r["counts"], "<u4")))
            texts_with[places] += 1
    if not by_name:
        return None
    drawn_texts = sum(map(len, by_name.values()))
    rarity = (np.log((1 + drawn_texts) / (1 + texts_with)) + 1).astype(np.float32)

    def dense(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(texts), BUCKETS), np.float32)
        for row, (places, n) in zip(out, texts, strict=True):
            row[places] = n
        return unit(np.log1p(out) * rarity)

    languages: list[str] = []
    found: list[np.ndarray] = []
    for name in sorted(by_name):
        centroids = clusters(dense(by_name[name]), CENTROIDS)
        languages += [name] * len(centroids)
        found.append(centroids)
    model = LanguageModel(languages, np.concatenate(found).astype(np.float32), rarity, np.zeros((len(languages), LEVELS)))

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cosines of the beginnings of each text, of 1, 2, 4... characters and the whole, with its own language."""
        for batch in batches:
            for name, whole_text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                seen = np.stack([counts(whole_text[: 1 << bit]) for bit in range(len(whole_text).bit_length() + 1)])
                seen = seen[seen.any(axis=1)]
                own = np.array([x == name for x in model.languages])
                if len(seen) and own.any():
                    cosines = (model.vectors(seen) @ model.centroids[own].T).max(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen)), pa.array(levels(seen)), pa.array(cosines.astype(np.float64))], names=["lang", "level", "cosine"])

    seen_levels = drawn.mapInArrow(measured, "lang string, level long, cosine double").toArrow()
    of, level, cosine = (seen_levels.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "level", "cosine"))
    for name in set(languages):
        model.least[np.array(languages) == name] = limits(level[of == name], cosine[of == name])
    return model


def predict(docs: DataFrame, model: LanguageModel | None, *columns: Column, text: str = "text") -> DataFrame:
    """The chosen columns with ``lang_pred``, ``score`` (cosine) and ``rejected`` for every row."""
    rows = docs.select(*columns, whole(text).alias("__text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_in in batches:
            for batch in bounded(rows_in, "__text", 1 << 20):
                seen = np.stack([counts(t) for t in column(batch, "__text").to_pylist()])
                lettered = seen.any(axis=1)
                names, scores, rejected = np.full(len(seen), UNKNOWN, object), np.zeros(len(seen)), np.ones(len(seen), bool)
                if model is not None and lettered.any():
                    best, cosines = model.nearest(seen[lettered])
                    names[lettered] = np.array(model.languages, object)[best]
                    scores[lettered] = cosines
                    rejected[lettered] = cosines < model.least[best, levels(seen[lettered])]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)],
                    names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")


def held_out(id_column: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether the row's id falls into the fold that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds == fold
