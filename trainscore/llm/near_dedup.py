"""Near-duplicate documents by MinHash signatures in an LSH forest, links confirmed on full sets.

1. A document's set of word shingles is hashed to 64 bits each; equal sets are one class
   from here on, so that a group of exact copies costs one row.
2. A class has ``HASHES`` minima. The forest is ``TREES`` sorted orders of the classes, each
   by the signature from another place on. Neighbours in an order that share a prefix of at
   least ``DEPTH`` minima are a run, and candidates for each other. In a run of up to
   ``DENSE`` classes those whose signatures agree as often as a link makes sure (five and a
   half standard deviations allowed) are joined; a denser run is joined as a whole. Every
   edge leads to the least class of its run, or of its part, so trees that find the same group
   give the same edges. Joined classes are a region. No pairs are listed: a run has as many edges as classes.
   (The prefix that makes a run has the same depth everywhere; a dense run is not split by longer ones.)
3. Within a region all pairs are compared on the full sets, in blocks of a bounded size,
   each pair of blocks in one task; a block emits a spanning tree of its links only.
4. Links join classes to components.

Every pair of classes that shares a run in any tree is decided, so what can be lost is a
link whose signatures share no prefix in all trees: for similarity 0.85 less than one in a
million links, for 0.8 one in a hundred thousand.

Empty and null texts have an empty set and are linked with nothing. Repeated rows are copies of each other.
A null id counts as larger than any other; a row without an id in a component of such rows
alone has a null component and is kept. Other columns are not read, or pass through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, connected
from .words import MIX_A, Words, bounded, column, grams, groups_of, mixed, whole

TREES, DEPTH, STEP = 16, 3, 4
HASHES = TREES * STEP
ORDER = 8  # minima in a sort key
DENSE = 4096
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 2_000_000
COLUMNS = 4096

_draw = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * MIX_A)
MULTIPLY, ADD = _draw[:HASHES] | np.uint64(1), _draw[HASHES:]


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes; a shorter text is one shingle."""
    if 0 < len(hashes) < n:
        return grams(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(grams(hashes, n))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    words = Words(pc.ascii_lower(texts))
    return [shingle_set(h, n) for h in words.rows(words.hashes()[words.numbers])]


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[start : start + 2048, None] * MULTIPLY + ADD).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(">u4")  # big-endian: bytes sort as the numbers do


def class_of(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signed(docs: DataFrame, n: int) -> DataFrame:
    """``id, key, n, class, sig`` of rows ``id, key, text``; class and signature are null for empty sets."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_in in batches:
            for batch in bounded(rows_in):
                sets = shingle_sets(column(batch, "text"), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "id"),
                        column(batch, "key"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([class_of(s) for s in sets], pa.binary()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["id", "key", "n", "class", "sig"],
                )

    return docs.mapInArrow(run, f"id {kind}, key string, n long, class binary, sig binary")


def spanning(joined: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the least index reachable from each index."""
    root = np.full(len(joined), -1)
    for start in range(len(joined)):
        if root[start] >= 0:
            continue
        root[start] = start
        edge = np.array([start])
        while len(edge):
            edge = np.flatnonzero(joined[edge].any(axis=0) & (root < 0))
            root[edge] = start
    return root


def agreeing(signatures: np.ndarray, least: int) -> np.ndarray:
    """Which signatures agree in at least so many places."""
    count = len(signatures)
    out = np.zeros((count, count), bool)
    step = max(1, (1 << 22) // (count * HASHES))
    for start in range(0, count, step):
        out[start : start + step] = (signatures[start : start + step, None] == signatures).sum(axis=2) >= least
    return out


def star(members: list[bytes], root: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    others = np.flatnonzero(root != np.arange(len(root)))
    return [members[i] for i in others], [members[root[i]] for i in others]


def regions(classes: DataFrame, least_shared: float) -> DataFrame:
    """Edges ``a, b`` that join the classes which must be compared."""
    slack = 5.5 * math.sqrt(least_shared * (1 - least_shared) / HASHES)
    least = math.floor(HASHES * (least_shared - slack))
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    around = F.concat("sig", F.substring("sig", 1, 4 * ORDER))
    placed = classes.select("class", "sig", tree)
    prefix = F.expr(f"substring(sig, {4 * STEP} * tree + 1, {4 * DEPTH})").alias("prefix")
    # A run's centre is its least class, whatever the order: near copies have the same centre in most trees, and few edges.
    runs = placed.select("tree", prefix, "class").groupBy("tree", "prefix").agg(F.count("*").alias("m"), F.min("class").alias("centre"))
    shared = runs.filter("m > 1").select("tree", "prefix", "centre")
    members = placed.select("class", "tree", prefix).join(shared, ["tree", "prefix"]).select("class", "tree", "centre")
    key = F.expr(f"substring(around, {4 * STEP} * tree + 1, {4 * ORDER})").alias("key")
    rows = members.join(classes.select("class", "sig", around.alias("around")), "class").select("tree", key, "class", "sig", "centre")
    rows = rows.repartitionByRange("tree", "key", "class").sortWithinPartitions("tree", "key", "class")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        now, centre, first, dense = None, b"", True, False

        def edges(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (a, b)], names=["a", "b"])

        def closed(whole: bool) -> pa.RecordBatch:
            """The run that is held, joined where signatures agree; with its centre where it may go on in another partition."""
            if not whole:
                return edges([c for c, _ in held], [centre] * len(held))
            held.sort()  # so that a part's root is its least class
            root = spanning(agreeing(np.frombuffer(b"".join(s for _, s in held), ">u4").reshape(len(held), HASHES), least))
            return edges(*star([c for c, _ in held], root))

        for batch in batches:
            columns = [column(batch, c).to_pylist() for c in ("tree", "key", "class", "sig", "centre")]
            more: list[tuple[bytes, bytes]] = []  # of a dense run
            for t, key, name, sig, middle in zip(*columns, strict=True):
                place = (t, key[: 4 * DEPTH])
                if place != now:
                    if now is not None:
                        if not dense:
                            yield closed(not first)
                        first = False
                    held, now, centre, dense = [], place, middle, False
                if dense:
                    more.append((name, centre))
                    continue
                held.append((name, sig))
                if len(held) > DENSE:
                    yield closed(False)
                    held, dense = [], True
            if more:
                yield edges(*map(list, zip(*more, strict=True)))
        if now is not None and not dense:
            yield closed(False)

    return rows.mapInArrow(run, "a binary, b binary")


def thinned(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges ``a, b``: each class leads to the least of its centres, and so do the others of them.

    A class has one edge a tree at most, so what is gathered for it is bounded.
    """
    least_first = F.array_sort(F.collect_set("b")).alias("bs")
    centres = edges.filter("a != b").groupBy("a").agg(least_first)
    ends = F.array(F.struct("a", F.col("bs")[0].alias("b")))
    more = F.transform(F.slice("bs", 2, TREES), lambda c: F.struct(c.alias("a"), F.col("bs")[0].alias("b")))
    return centres.select(F.inline(F.concat(ends, more))).distinct()


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For sorted sets, the matrix of pairs with 100 * intersection >= percent * union."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(count), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    shared = ~new | ~np.concatenate([new[1:], [True]])  # in more than one set
    owner, place = owner[shared], np.cumsum(new[shared]) - 1
    common = np.zeros((count, count))
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        inside = slice(*np.searchsorted(place, [start, start + COLUMNS]))
        has = np.zeros((count, min(COLUMNS, int(place[-1]) + 1 - start)), np.float32)
        has[owner[inside], place[inside] - start] = 1
        common += has @ has.T
    common = np.rint(common).astype(np.int64)
    return 100 * common >= percent * (sizes[:, None] + sizes - common)


def links(members: DataFrame, percent: int) -> DataFrame:
    """Spanning links ``a, b`` of rows ``region, class, n, set``; every pair of a region is compared."""
    size = members.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    rows = members.join(size.select("region", blocks.alias("blocks")), "region")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("region", "class", "set", "block", other)
    rows = rows.select("region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "class", "set")
    rows = rows.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j", "class")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["region", "i", "j"]):
            names = group.column("class").to_pylist()
            root = spanning(linked([np.frombuffer(s, "<u8") for s in group.column("set").to_pylist()], percent))
            a, b = star(names, root)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def components(docs: DataFrame, n: int, percent: int, text: str, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``id, key, n, class`` and, for each class, its component's ``first``: no id or not, least id, its key."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), row_key(id_column, text).alias("key"), whole(text).alias("text"))
    signs = scratch.keep(signed(rows, n), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    one = signs.filter("class is not null").groupBy("class").agg(first, F.first("sig").alias("sig"))
    classes = scratch.keep(one, "classes")
    found = scratch.keep(thinned(regions(classes, percent / 100)), "forest")
    region = scratch.keep(connected(scratch, found), "regions")
    # The sets of the classes in regions, made again from the text of one row of each.
    wanted = region.join(classes.select(F.col("class").alias("node"), "first.key"), "node").select("key", "node", F.col("root").alias("region"))
    sources = wanted.join(rows.select("key", "text"), "key")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_in in batches:
            for batch in bounded(rows_in):
                out = shingle_sets(column(batch, "text"), n)
                made = [column(batch, "region"), column(batch, "node"), pa.array([len(s) for s in out], pa.int64()), pa.array([s.tobytes() for s in out], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["region", "class", "n", "set"])

    members = sources.mapInArrow(sets, "region binary, class binary, n long, set binary").dropDuplicates(["region", "class"])
    members = scratch.keep(members, "sets")
    root = scratch.keep(connected(scratch, links(members, percent)), "components")
    scratch.drop(members, found, region)
    place = classes.join(root.select(F.col("node").alias("class"), "root"), "class", "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    least = place.groupBy("root").agg(F.min("first").alias("first"))
    return signs.drop("sig"), place.select("class", "root").join(least, "root").select("class", "first")


def row_key(id_column: str, text: str) -> Column:
    """What a row is found again by: its id and a hash of its text."""
    return F.concat_ws(" ", F.col(id_column).cast("string"), F.xxhash64(whole(text)).cast("string"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Each row's id with ``n_shingles``, ``component_id`` (least id reachable over links) and ``kept``.

    Rows are linked when 100 * intersection >= percent * union of their sets of distinct
    shingles of n words (A-Z lower-cased; a shorter text is one shingle).
    """
    signs, place = components(docs, n, percent, text, id_column)
    result = signs.select("id", F.col("n").alias("n_shingles"), "class").join(place, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id")
    result = result.select("id", "n_shingles", component)
    return result.select(F.col("id").alias(id_column), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of all columns that stay: one of each component, and all with an empty set.

    The row of least id stays, of several with that id the one of least key; of rows alike in both, one.
    """
    signs, place = components(docs, n, percent, text, id_column)
    keys = place.select("first.key").unionByName(signs.filter("class is null").select("key")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(id_column, text).alias("key"))
    kept = packed.join(keys, "key", "left_semi")
    empty = F.trim(F.regexp_replace(F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit("")), r"[ \t\n\r\x0B\f]+", " ")) == ""
    some = kept.filter(~empty).groupBy("key").agg(F.first("row").alias("row")).select("row")
    return some.unionByName(kept.filter(empty).select("row")).select("row.*")
