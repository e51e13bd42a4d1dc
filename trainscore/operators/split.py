"""Dividing parsed rows into a training and a verification part.

``keyed_split`` decides each row by a hash of its key columns. It is a narrow
filter, needs no copy of the data, and gives the same parts on every cluster.

``keyed_split`` also serves where no key is named but rows have a place of their own:
``with_row_key`` adds file and row number to a Parquet scan.

``random_split`` has neither to hold on to. Drawing a random number in two separate
scans would draw twice, and a lost executor or another number of cores changes
the draw, so rows could land in both parts or in neither. The draw is therefore
written down once, in a table on shared storage partitioned by part; each part
then reads only its own files.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import check_weights
from ..storage import delete_path, fresh_path

SIDE = "__side"
ROW_KEY = ("__file", "__row")
TRAIN, VERIFY = "train", "verify"


@dataclass(frozen=True)
class Split:
    train: DataFrame
    verify: DataFrame
    staged: str | None = None


def _train_share(weights: Sequence[float]) -> float:
    """Weights are normalised: those that sum to less than 1 drop no rows."""
    train, verify = check_weights(list(weights))
    return train / (train + verify)


def _any_null(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [p.isNull() for p in parts])


def side_of_key(keys: Sequence[str], weights: Sequence[float], seed: int = 0, others: Sequence[str] = ()) -> Column:
    """``'train'`` or ``'verify'``, from the first 32 bits of the key's md5.

    A row trains if those bits are below ``share * 2^32``; hex digits of equal
    width sort like the numbers they stand for, so they are compared as text.
    Seed 0 hashes the key alone; any other seed is prepended to it. ``others`` are the
    columns that rows with a null in their key are divided by.
    """
    limit = math.ceil(_train_share(weights) * 2**32)
    parts = [F.col(k).cast("string") for k in keys]
    text = F.concat_ws("|", *([F.lit(str(seed))] if seed else []), *parts)
    # Nulls would vanish from the text: where there is one, each part says what it is. Such
    # rows are told apart by all that the row holds, so they are divided like others.
    if others:
        marked = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("null")) for p in parts]
        whole = F.concat_ws("|", F.lit(str(seed)), *marked, F.xxhash64(*[F.col(f"`{c}`") for c in others]).cast("string"))
        text = F.when(_any_null(parts), whole).otherwise(text)
    if limit >= 2**32:
        return F.lit(TRAIN)
    return F.when(F.substring(F.md5(text), 1, 8) < f"{limit:08x}", TRAIN).otherwise(VERIFY)


def keyed_split(df: DataFrame, keys: Sequence[str], weights: Sequence[float], seed: int = 0) -> Split:
    if float(weights[1]) == 0:
        check_weights(list(weights))
        return Split(df, df)
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.UserDefinedType))]
    if any(isinstance(f.dataType, VectorUDT) for f in df.schema.fields):
        vectors = {f.name: vector_to_array(f.name) for f in df.schema.fields if isinstance(f.dataType, VectorUDT)}
        wide = df.withColumns({f"__array_{n}": v for n, v in vectors.items()})
        side = side_of_key(keys, weights, seed, [*hashable, *[f"__array_{n}" for n in vectors]])
        extra = [f"__array_{n}" for n in vectors]
        return Split(wide.where(side == TRAIN).drop(*extra), wide.where(side == VERIFY).drop(*extra))
    side = side_of_key(keys, weights, seed, hashable)
    return Split(df.where(side == TRAIN), df.where(side == VERIFY))


def with_row_key(scan: DataFrame) -> DataFrame:
    """The rows of a Parquet scan with the file (hashed) and row number each came from."""
    file, row = ROW_KEY
    place = F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)
    return scan.select("*", *place)


def row_split(df: DataFrame, weights: Sequence[float], seed: int = 0) -> Split:
    """Split rows that still carry their ``ROW_KEY``, and drop it.

    Copies of a row lie in different places, so they are divided like any others.
    Nobody needs to find these parts again by other means, so the cheaper hash does.
    """
    limit = math.ceil(_train_share(weights) * 2**53)
    in_train = F.shiftrightunsigned(F.xxhash64(*ROW_KEY, F.lit(seed)), 11) < limit
    return Split(df.where(in_train).drop(*ROW_KEY), df.where(~in_train).drop(*ROW_KEY))


def random_split(df: DataFrame, weights: Sequence[float], seed: int = 0) -> Split:
    """Bernoulli split by ``weights``; verify on the training rows at weight 0.

    ``Split.staged`` names the table holding the draw: ``drop_sides`` removes it.
    """
    share = _train_share(weights)
    if float(weights[1]) == 0:
        return Split(df, df)
    spark = df.sparkSession
    path = fresh_path(spark, "split")
    side = F.when(F.rand(seed) < share, TRAIN).otherwise(VERIFY)
    df.withColumn(SIDE, side).write.partitionBy(SIDE).parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField(SIDE, T.StringType())])
    table = spark.read.schema(schema).parquet(path)
    return Split(
        table.where(F.col(SIDE) == TRAIN).drop(SIDE),
        table.where(F.col(SIDE) == VERIFY).drop(SIDE),
        path,
    )


def drop_sides(split: Split) -> None:
    """Remove what ``random_split`` wrote, once both parts have been used."""
    if split.staged:
        delete_path(split.train.sparkSession, split.staged)
