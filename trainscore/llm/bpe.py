"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The vocabulary file is a parameter (a ``tokenizers`` JSON file with a BPE model, byte-level
letters, an end-of-word suffix, lower case and white space dropped). A word's pieces
are the leaves of a segment tree whose values are the ranks of adjacent pairs; the root
yields the leftmost pair of lowest rank, a merge changes three leaves and the nodes
above them, until no pair that can be merged is left. Short words are merged many at a
time, one tree per row of a numpy array; a long word has a tree of its own. Within a worker
a word is encoded once and kept in a bounded table: texts become rows of word numbers.

Nulls count as empty texts: no tokens, the digests of nothing. Repeated rows and ids are
encoded row by row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import MIX_A, Words, bounded, column, whole

NONE = 1 << 30  # the rank of a pair that is not merged
POSITION = 7  # low bits of a leaf's value: the place, so that the leftmost of equal ranks wins
LONG = 64  # letters; longer words are merged one by one
BLOCK = 4096  # trees side by side


def byte_letters() -> list[str]:
    """The printable letter for each byte: itself where printable, else the next free code from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class PairTable:
    """Ranks of pairs in a hash table that is searched for many pairs at once; a pair lies at its place or soon after."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(len(keys), 1).bit_length() + 3
        self.shift = np.uint64(64 - bits)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        place, left = self._places(keys), np.arange(len(keys))
        while len(left):  # the first of those at one free place stays there, the others move on
            at = place[left]
            free = np.flatnonzero(self.keys[at] == -1)
            at, first = np.unique(at[free], return_index=True)
            put = left[free[first]]
            self.keys[at], self.ranks[at] = keys[put], ranks[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            place[left] = (place[left] + 1) % (1 << bits)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * MIX_A >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE for pairs that are not there or have a negative part."""
        at = self._places(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], NONE)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            at[left] = (at[left] + 1) % len(self.keys)
            there = self.keys[at[left]]
            match = there == keys[left]
            out[left[match]] = self.ranks[at[left[match]]]
            left = left[~match & (there != -1)]
        return np.where(keys < 0, NONE, out)


def cut(pieces: list, line: str | bytes, lines: int) -> tuple[list, np.ndarray]:
    """The pieces without the line breaks, and how many each line has."""
    if not lines:
        return [], np.zeros(0, np.int64)
    breaks = [i for i, piece in enumerate(pieces) if piece == line]
    return [piece for piece in pieces if piece != line], np.diff([-1, *breaks, len(pieces)]) - 1


class Vocabulary:
    """A BPE vocabulary read from a file, with the merges of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tokens = {token: i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = 1 + max([*self.tokens.values(), *self.special.values()])
        self.text = [b""] * size
        for token, i in self.tokens.items():
            self.text[i] = token.encode()
        for token, i in self.special.items():
            self.text[i] = token.encode()
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        if len(merges) >= NONE >> POSITION:
            raise ValueError("the vocabulary has too many merges")
        keys = np.array([self.tokens[a] << 32 | self.tokens[b] for a, b in merges], np.int64)
        made = np.array([self.tokens[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self.pairs, self.made = PairTable(keys[order], order.astype(np.int32)), made
        self.rank_of = {int(k): int(r) for k, r in zip(keys[order], order, strict=True)}
        letters = byte_letters()
        self.inner = np.array([self.tokens[c] for c in letters], np.int32)
        self.last = np.array([self.tokens[c + self.suffix] for c in letters], np.int32)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # Words go through the pattern together, a line each.
        self.pieces = regex.compile(rf"\n|{pattern}").findall
        ascii_pattern = pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        self.ascii_pieces = regex.compile(rf"\n|{ascii_pattern}".encode()).findall
        self.splits = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    # ---- a word's pieces before any merge

    def parts(self, words: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The parts of words without white space that are merged on their own, and how many each word has."""
        plain = np.fromiter(map(str.isascii, words), bool, len(words))
        found, counts = cut(self.ascii_pieces("\n".join(compress(words, plain)).lower().encode()), b"\n", int(plain.sum()))
        if plain.all():
            return found, counts
        text = unicodedata.normalize("NFC", "\n".join(compress(words, ~plain)))
        # A final sigma depends on its neighbours in a string, but not here: letters are lowered one by one.
        text = "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()
        others, sizes = cut(self.pieces(text), "\n", int((~plain).sum()))
        both = [*found, *map(str.encode, others)]
        # Back into the order of the words.
        all_sizes = np.concatenate([counts, sizes])
        place = np.empty(len(words), np.int64)
        place[np.argsort(~plain, kind="stable")] = np.arange(len(words))
        counts = all_sizes[place]
        order = spread((np.cumsum(all_sizes) - all_sizes)[place], counts)
        return list(map(both.__getitem__, order.tolist())), counts

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE for pairs that are not merged."""
        return self.pairs.find(left.astype(np.int64) << 32 | right)

    # ---- merging

    def merged_many(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, one after the other, and how many each piece has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        codes = np.frombuffer(b"".join(pieces), np.uint8)
        letters = self.inner[codes]
        if len(codes):
            letters[ends - 1] = self.last[codes[ends - 1]]
        starts, counts = ends - lengths, np.zeros(len(pieces), np.int64)
        results: list[tuple[np.ndarray, np.ndarray]] = []
        width = 1
        while width <= LONG:
            fits = np.flatnonzero((lengths > width // 2) & (lengths <= width))
            for first in range(0, len(fits), BLOCK):
                part = fits[first : first + BLOCK]
                results.append((part, self._merge_block(letters, starts[part], lengths[part], width, counts, part)))
            width *= 2
        for i in np.flatnonzero(lengths > LONG):
            ids = self.merged_long(letters[starts[i] : ends[i]])
            counts[i] = len(ids)
            results.append((np.array([i]), ids))
        flat, begins = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for part, ids in results:
            n = counts[part]
            flat[np.arange(len(ids)) + np.repeat(begins[part] - (np.cumsum(n) - n), n)] = ids
        return flat, counts

    def _merge_block(self, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, counts: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Merge pieces of at most ``width`` letters side by side, one segment tree per row."""
        count, wide = len(starts), width + 2  # two spare places: no next, no one before
        place = np.arange(wide)
        filled = place < lengths[:, None]
        ids = np.full((count, wide), -1, np.int32)
        ids[filled] = letters[(starts[:, None] + place)[filled]]
        if width > 1:
            after = np.where(place < lengths[:, None] - 1, place + 1, width).astype(np.int32).ravel()
            before = np.where(place > 0, place - 1, width + 1).astype(np.int32)
            before = np.broadcast_to(before, (count, wide)).copy().ravel()
            tree = np.full((count, 2 * width), NONE, np.int32)
            row, at = np.nonzero(place[:width] < lengths[:, None] - 1)
            ranks = self.ranks(ids[row, at], ids[row, at + 1])
            tree[row, width + at] = np.where(ranks < NONE, ranks << POSITION | at, NONE)
            for node in range(width - 1, 0, -1):
                np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
            flat, tree = ids.ravel(), tree.ravel()
            rows = np.flatnonzero(tree[1 :: 2 * width] < NONE)
            while len(rows):
                base, root = rows * wide, tree[rows * (2 * width) + 1]
                at = root & ((1 << POSITION) - 1)
                here = base + at
                gone = after[here]
                then, prior = after[base + gone], before[here]
                flat[here] = merged = self.made[root >> POSITION]
                flat[base + gone] = -1
                after[here] = then
                before[base + then] = at
                follow, lead = flat[base + then], flat[base + prior]  # -1 where there is none: no such pair
                right, left = self.ranks(merged, follow), self.ranks(lead, merged)
                self._set_leaf(tree, width, rows, gone, NONE)
                self._set_leaf(tree, width, rows, at, np.where(right < NONE, right << POSITION | at, NONE))
                led = prior < width
                self._set_leaf(tree, width, rows[led], prior[led], np.where(left < NONE, left << POSITION | prior, NONE)[led])
                rows = rows[tree[rows * (2 * width) + 1] < NONE]
            ids = flat.reshape(count, wide)
        kept = ids[:, :width] >= 0
        counts[part] = kept.sum(axis=1)
        return ids[:, :width][kept]

    @staticmethod
    def _set_leaf(tree: np.ndarray, width: int, rows: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
        base, node = rows * (2 * width), at + width
        tree[base + node] = value
        while width > 1:
            node = node >> 1
            below = base + 2 * node
            tree[base + node] = np.minimum(tree[below], tree[below + 1])
            width >>= 1

    def merged_long(self, symbols: np.ndarray) -> np.ndarray:
        """Merge one word of any length: the same tree as a plain list, n log n steps in all."""
        ids, n = symbols.tolist(), len(symbols)
        width = 1 << max(n - 1, 1).bit_length()
        none, rank_of, made = (NONE, 0), self.rank_of.get, self.made
        tree = [none] * (2 * width)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def value(i: int) -> tuple[int, int]:
            rank = rank_of(ids[i] << 32 | ids[after[i]]) if after[i] < n else None
            return none if rank is None else (rank, i)

        def put(i: int, leaf: tuple[int, int]) -> None:
            node = i + width
            tree[node] = leaf
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        for i in range(n - 1):
            tree[width + i] = value(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != none:
            rank, at = tree[1]
            gone = after[at]
            ids[at] = int(made[rank])
            ids[gone] = -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, none)
            put(at, value(at))
            if before[at] >= 0:
                put(before[at], value(before[at]))
        return np.array([i for i in ids if i >= 0], np.int32)


class WordEncoder:
    """Word to token ids, each distinct word merged once while it stays in the bounded table."""

    LIMIT = 600_000

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.ends = np.empty(1 << 20, np.int32), np.zeros(1 << 19, np.int64)

    def _add(self, words: list[str]) -> None:
        parts, sizes = self.vocabulary.parts(words)
        added, counts = self.vocabulary.merged_many(parts)
        upto = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)]
        known, used = len(self.number), int(self.ends[len(self.number)])
        if used + len(added) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.empty(len(self.flat) + len(added), np.int32)])
        if known + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends[: known + 1], np.zeros(len(self.ends) + len(words), np.int64)])
        self.flat[used : used + len(added)] = added
        self.ends[known + 1 : known + 1 + len(words)] = used + upto
        self.number.update(zip(words, range(known, known + len(words)), strict=True))

    def numbers(self, words: Words) -> np.ndarray:
        """The table's numbers of the words; they hold until the next call."""
        return self.known(words.distinct)[words.numbers]

    def known(self, words: np.ndarray) -> np.ndarray:
        """The table's numbers of distinct words, which are put there if need be."""
        distinct = words.tolist()
        found = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if len(self.number) + len(missing) > self.LIMIT:
                self._clear()
                missing = np.arange(len(distinct))
            fresh = list(map(distinct.__getitem__, missing.tolist()))
            for start in range(0, len(fresh), 50_000):
                self._add(fresh[start : start + 50_000])
            found[missing] = np.arange(len(self.number) - len(fresh), len(self.number))
        return found

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """Token ids of a row of word numbers."""
        start = self.ends[numbers]
        count = self.ends[numbers + 1] - start
        total = np.cumsum(count)
        if not len(numbers) or not total[-1]:
            return np.empty(0, np.int32)
        return self.flat[np.arange(total[-1]) + np.repeat(start - (total - count), count)]

    def tokens(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct words, one after the other, and how many each has."""
        numbers = self.known(words)
        return self.ids(numbers), self.ends[numbers + 1] - self.ends[numbers]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Token ids of whole texts."""
        special = self.vocabulary.special
        raw = texts.buffers()[2]
        raw = raw.to_pybytes() if raw else b""
        marked = [i for mark in special if mark.encode() in raw for i in np.flatnonzero(pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)).tolist()]
        words = Words(texts)
        out = [self.ids(n) for n in words.rows(self.numbers(words))]
        for i in dict.fromkeys(marked):
            # Special tokens are cut out of the raw text first.
            parts = self.vocabulary.splits(texts[i].as_py())
            words = Words(pa.array(parts[::2], texts.type))
            plain = iter([self.ids(n) for n in words.rows(self.numbers(words))])
            out[i] = np.concatenate([np.array([special[p]], np.int32) if k % 2 else next(plain) for k, p in enumerate(parts)])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts joined by one space, as a vocabulary file without a decoder has it."""
        return b" ".join(map(self.vocabulary.text.__getitem__, ids.tolist()))


_encoders: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file, built once per process.

    The name is that of a file sent with ``send_vocabulary``.
    """
    if vocabulary not in _encoders:
        _encoders[vocabulary] = WordEncoder(Vocabulary(SparkFiles.get(vocabulary)))
    return _encoders[vocabulary]


def forget_encoders() -> None:
    """Free the worker's tables of words, when a stage that encodes has ended."""
    _encoders.clear()
    pa.default_memory_pool().release_unused()


def send_vocabulary(spark: SparkSession, path: str) -> str:
    """Send the file to every executor, now and later ones; returns the name that ``encoder`` takes."""
    name = path.rsplit("/", 1)[-1]
    if not any(known.endswith(f"/{name}") for known in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return name


def coded(docs: DataFrame, vocabulary: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Each row's id, token ids (little-endian 32-bit, as binary), count and decoded text's digest."""
    name = send_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name)
        for rows_in in batches:
            for batch in bounded(rows_in):
                all_ids = coder.encode(column(batch, "text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "id"),
                        pa.array([len(ids) for ids in all_ids], pa.int64()),
                        pa.array([hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in all_ids]),
                        pa.array([hashlib.sha256(coder.decode(ids)).hexdigest() for ids in all_ids]),
                    ],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_column).alias("id"), whole(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)


def encode_column(docs: DataFrame, vocabulary: str, *columns: Column, text: str = "text") -> DataFrame:
    """The chosen columns and ``ids``, the token ids as little-endian unsigned 32-bit binary."""
    name = send_vocabulary(docs.sparkSession, vocabulary)
    rows = docs.select(*columns, whole(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name)
        for rows_in in batches:
            for batch in bounded(rows_in):
                ids = pa.array([i.astype("<u4").tobytes() for i in coder.encode(column(batch, "text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*batch.schema.names[:-1], "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, ids binary")


def decode_column(rows: DataFrame, vocabulary: str, *columns: Column, ids: str = "ids") -> DataFrame:
    """The chosen columns and ``text``, decoded from ``ids``; null ids decode to an empty text."""
    name = send_vocabulary(rows.sparkSession, vocabulary)
    chosen = rows.select(*columns, F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name)
        for batch in batches:
            texts = [coder.decode(np.frombuffer(i, "<u4")).decode() for i in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{fields}, text string")
