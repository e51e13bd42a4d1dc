"""Helpers that several operators of this subpackage share: words, hashes, arrays as columns.

A word is ``[^\\x20\\x09-\\x0D]+``, which is what Arrow's ASCII split yields; its ASCII lower
case lowers A-Z alone. Texts stay in Arrow until a letter matters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import ship_package

MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbouring inputs give unrelated outputs."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(30)
    values *= MIX_B
    values ^= values >> np.uint64(27)
    values *= MIX_C
    values ^= values >> np.uint64(31)
    return values


class Words:
    """The words of many texts: numbers into a list of distinct words, text after text."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        self.distinct: np.ndarray = coded.dictionary.to_numpy(zero_copy_only=False)
        numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        lengths = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        empty = np.flatnonzero(self.distinct == "")  # beside white space at a text's ends
        if len(empty):
            kept = numbers != empty[0]
            upto = np.concatenate([[0], np.cumsum(kept)])
            ends = np.cumsum(lengths)
            lengths = upto[ends] - upto[ends - lengths]
            numbers = numbers[kept]
        self.numbers, self.lengths = numbers, lengths

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each distinct word."""
        return pd.util.hash_array(self.distinct, categorize=False) if len(self.distinct) else np.empty(0, np.uint64)

    def rows(self, values: np.ndarray) -> list[np.ndarray]:
        """``values`` (one per word) cut into texts."""
        return np.split(values, np.cumsum(self.lengths)[:-1]) if len(self.lengths) else []


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words (none when there are fewer), by doubling."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    base, length = int(MIX_A), 1
    run = hashes
    for bit in bin(n)[3:]:  # from the highest bit down: twice as long, and one word more
        run = run[: len(run) - length] * np.uint64(pow(base, length, 1 << 64)) + run[length:]
        length *= 2
        if bit == "1":
            run = run[:-1] * MIX_A + hashes[length:]
            length += 1
    return mixed(run)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ints(values: np.ndarray | Sequence[int]) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))


def lists(arrays: Sequence[np.ndarray], dtype: Any) -> pa.Array:
    """One list per row from numpy arrays, without a Python object per value."""
    ends = np.zeros(len(arrays) + 1, np.int64)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays).astype(dtype, copy=False) if arrays else np.empty(0, dtype)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.from_numpy_dtype(np.dtype(dtype))))


def bounded(batch: pa.RecordBatch, text: str = "text", size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` text bytes, a row at least, so that memory follows the largest text only."""
    lengths = np.asarray(pc.binary_length(column(batch, text)).fill_null(0)).astype(np.int64)
    block = (np.cumsum(lengths) - lengths) // size
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(block)], strict=True):
        yield batch.slice(start, end - start)


def groups_of(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys as one table each; rows must arrive sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = np.asarray(column(batch, key).to_numpy(zero_copy_only=False))
            change[1:] |= values[1:] != values[:-1]
        first = tuple(column(batch, key)[0].as_py() for key in keys)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        starts = [0, *np.flatnonzero(change).tolist()]
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if start and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
        last = tuple(column(batch, key)[batch.num_rows - 1].as_py() for key in keys)
    if held:
        yield pa.Table.from_batches(held)
