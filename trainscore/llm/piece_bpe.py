"""SentencePiece encoding and decoding of merge-type vocabularies with a score-ordered agenda.

The model file is a parameter. A text becomes symbols, one for each character, with a space
symbol before it and in place of each space. The agenda holds one entry for each pair of
neighbours that together are a piece, ordered by the piece's score, the leftmost first
where scores are equal; the best entry is taken, its pair becomes one symbol and the entries of
the new symbol's two pairs take their place, until the agenda is empty. A character that is no
piece becomes the pieces of its bytes.

No piece holds a space symbol behind another letter, and some letters are part of no longer
piece, so a text falls into stretches that never merge with each other. A stretch is encoded once
per worker while it stays in a bounded table. Short stretches have their agendas side by side, one
per row of a numpy array; a long one has a heap, n log n steps in all.

With ``check`` each Arrow batch is encoded and decoded once more by the sentencepiece library
and ``agrees`` tells whether ids and text are the same; results are always the agenda's own.

Nulls count as empty texts: begin and end id alone, decoded to nothing. Repeated rows and ids are
encoded row by row; other columns are not read. Models of another type, with a table of character
replacements, removal of white space, user-defined or unused pieces, or without pieces for bytes are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WordEncoder, send_vocabulary
from .words import bounded, column, whole

# Fixed values of the model file's format: field numbers, kinds of pieces, the space symbol, the text of the unknown piece.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
MODEL_TYPE, SUFFIX_SPACE, BYTE_FALLBACK, UNKNOWN_TEXT = 3, 24, 35, 44
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
SPACE = "▁"
UNKNOWN_DEFAULT = " ⁇ "

NONE = np.int32(1 << 30)  # the rank of a pair that is no piece
STRANGE = 1 << 25  # symbols from here on are characters that are no piece
LONG = 64  # characters; longer stretches are merged one by one
BLOCK = 8192  # agendas side by side
SLICE = 4 << 20  # bytes of text at a time


def fields(message: bytes) -> Iterator[tuple[int, Any]]:
    """Field numbers and values of one encoded message: whole numbers, or raw bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else number()
        yield key >> 3, message[at : at + size]
        at += size


class Model:
    """A merge-type vocabulary read from a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            parts = list(fields(file.read()))
        trainer = dict(pair for key, part in parts if key == TRAINER for pair in fields(part))
        normalizer = dict(pair for key, part in parts if key == NORMALIZER for pair in fields(part))
        pieces = [dict(fields(part)) for key, part in parts if key == PIECES]
        kinds = np.array([p.get(KIND, NORMAL) for p in pieces])
        plain = trainer.get(MODEL_TYPE) == BPE and not trainer.get(SUFFIX_SPACE) and not normalizer.get(CHARACTER_MAP)
        plain = plain and normalizer.get(DUMMY_PREFIX, 1) and not normalizer.get(REMOVE_SPACES, 1) and normalizer.get(ESCAPE_SPACES, 1)
        if not plain or not trainer.get(BYTE_FALLBACK) or not set(kinds.tolist()) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: only merge-type models with pieces for bytes and texts kept as they are can be used")
        texts = [p[PIECE].decode() for p in pieces]
        scores = np.array([struct.unpack("<f", p[SCORE])[0] if SCORE in p else 0.0 for p in pieces])
        self.number = {text: i for i, text in enumerate(texts) if kinds[i] == NORMAL}
        self.begin, self.end = texts.index("<s>"), texts.index("</s>")
        self.bytes = np.zeros(256, np.int32)
        for i in np.flatnonzero(kinds == BYTE):
            self.bytes[int(texts[i][1:-1], 16)] = i
        self._pairs(scores)
        self._letters()
        self._texts(texts, kinds, trainer.get(UNKNOWN_TEXT, UNKNOWN_DEFAULT.encode()))

    def _symbol(self, text: str) -> int | None:
        """The symbol that a part of a piece can be."""
        return self.number.get(text, STRANGE + ord(text) if len(text) == 1 else None)

    def _pairs(self, scores: np.ndarray) -> None:
        """All pairs of symbols that together are a piece; equal scores have equal ranks."""
        rank = np.unique(-scores, return_inverse=True)[1]
        found = {}
        for text, i in self.number.items():
            for cut in range(1, len(text)):
                left, right = self._symbol(text[:cut]), self._symbol(text[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = i
        self.pair = {key: (int(rank[i]), i) for key, i in found.items()}
        self.keys = np.array(sorted(found), np.int64)
        self.made = np.array([found[k] for k in self.keys.tolist()], np.int32)
        self.ranks = rank[self.made].astype(np.int32)

    def _letters(self) -> None:
        """Symbols of characters, and where texts may be cut."""
        letters = {ord(text): i for text, i in self.number.items() if len(text) == 1 and text != SPACE}
        letters[32] = self._symbol(SPACE)  # a space stands for the space symbol
        self.points = np.array(sorted(letters), np.int64)
        self.symbols = np.array([letters[p] for p in self.points.tolist()], np.int32)
        self.cut_at_spaces = not any(a != SPACE and b == SPACE for text in self.number for a, b in zip(text, text[1:], strict=False))
        merged = {c for text in self.number if len(text) > 1 for c in text.replace(SPACE, " ")}
        self.alone = np.array([b < 128 and chr(b) not in merged for b in range(256)])

    def _texts(self, texts: list[str], kinds: np.ndarray, unknown: bytes) -> None:
        """What each piece decodes to, one after the other."""
        spelt = [text.replace(SPACE, " ").encode() if kind == NORMAL else b"" for text, kind in zip(texts, kinds.tolist(), strict=True)]
        for i in np.flatnonzero(kinds == UNKNOWN):
            spelt[i] = unknown
        for byte, i in enumerate(self.bytes.tolist()):
            spelt[i] = bytes([byte])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.sizes = np.array(list(map(len, spelt)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.is_byte, self.is_control = kinds == BYTE, kinds == CONTROL
        self.leads = np.array([kind == NORMAL and text.startswith(SPACE) for text, kind in zip(texts, kinds.tolist(), strict=True)])

    # ---- merging; what WordEncoder asks of a vocabulary

    @staticmethod
    def parts(stretches: list[str]) -> tuple[list[str], np.ndarray]:
        return stretches, np.ones(len(stretches), np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair, NONE for pairs that are no piece."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE), self.made[at]

    def merged_many(self, stretches: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all stretches, one after the other, and how many each has."""
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        points = np.frombuffer("".join(stretches).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        symbols = np.where(self.points[at] == points, self.symbols[at], STRANGE + points).astype(np.int32)
        ends = np.cumsum(lengths)
        starts, counts = ends - lengths, np.zeros(len(stretches), np.int64)
        results: list[tuple[np.ndarray, np.ndarray]] = []
        width = 1
        while width <= LONG:
            fits = np.flatnonzero((lengths > width // 2) & (lengths <= width))
            for first in range(0, len(fits), BLOCK):
                part = fits[first : first + BLOCK]
                ids, counts[part] = self._side_by_side(symbols, starts[part], lengths[part], width)
                results.append((part, ids))
            width *= 2
        for i in np.flatnonzero(lengths > LONG):
            ids = self.merged_long(symbols[starts[i] : ends[i]])
            counts[i] = len(ids)
            results.append((np.array([i]), ids))
        flat, begins = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for part, ids in results:
            n = counts[part]
            flat[np.arange(len(ids)) + np.repeat(begins[part] - (np.cumsum(n) - n), n)] = ids
        return self._as_bytes(flat, counts)

    def _side_by_side(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge stretches of at most ``width`` characters: row by row the symbols, and an agenda entry for each that has a next one."""
        place = np.arange(width + 1)
        filled = place < lengths[:, None]
        rows = np.full((len(starts), width + 1), -1, np.int32)
        rows[filled] = symbols[(starts[:, None] + place)[filled]]
        done = rows
        agenda, pieces = self.look_up(rows[:, :-1], rows[:, 1:])
        agenda, pieces = np.pad(agenda, ((0, 0), (0, 1)), constant_values=NONE), np.pad(pieces, ((0, 0), (0, 1)))
        index = np.arange(len(rows))  # the rows that still have entries
        while True:
            best = agenda.argmin(axis=1)  # the first, that is leftmost, of the best rank
            live = np.flatnonzero(agenda[np.arange(len(rows)), best] < NONE)
            if len(live) < len(rows):
                done[index] = rows
                rows, agenda, pieces, index, best = rows[live], agenda[live], pieces[live], index[live], best[live]
            if not len(rows):
                break
            here = np.arange(len(rows))
            piece = pieces[here, best]
            move = np.minimum(place + (place > best[:, None]), width)
            rows, agenda, pieces = (np.take_along_axis(a, move, axis=1) for a in (rows, agenda, pieces))
            rows[here, best] = piece
            agenda[here, best], pieces[here, best] = self.look_up(piece, rows[here, best + 1])
            led = np.flatnonzero(best > 0)
            before = best[led] - 1
            agenda[led, before], pieces[led, before] = self.look_up(rows[led, before], piece[led])
        kept = done >= 0
        return done[kept], kept.sum(axis=1)

    def merged_long(self, symbols: np.ndarray) -> np.ndarray:
        """Merge one stretch of any length with a heap as the agenda; entries whose symbols have changed are passed over."""
        ids, n, pair = symbols.tolist(), len(symbols), self.pair
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            found = pair.get(ids[left] << 32 | ids[right])
            if found:
                heapq.heappush(agenda, (found[0], left, ids[left], ids[right], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, was_left, was_right, piece = heapq.heappop(agenda)
            right = after[left]
            if ids[left] != was_left or right >= n or ids[right] != was_right:
                continue
            ids[left], ids[right] = piece, -1
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return np.array([i for i in ids if i >= 0], np.int32)

    def _as_bytes(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece as the pieces of their bytes."""
        strange = np.flatnonzero(flat >= STRANGE)
        if not len(strange):
            return flat, counts
        points = flat[strange] - STRANGE
        spelt = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        sizes = np.ones(len(flat), np.int64)
        sizes[strange] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        out = np.repeat(flat, sizes)
        out[out >= STRANGE] = self.bytes[spelt]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        return out, upto[ends] - upto[ends - counts]

    # ---- decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of any row of ids, as the library's ``decode`` gives it; a control id ends a character's bytes."""
        cuts = np.flatnonzero(self.is_control[ids])
        parts = [part for part in np.split(ids, np.unique(np.concatenate([cuts, cuts + 1]))) if len(part) and not self.is_control[part[0]]]
        return "".join(self._spelt(part, not i) for i, part in enumerate(parts))

    def _spelt(self, ids: np.ndarray, first: bool) -> str:
        size = self.sizes[ids]
        ends = np.cumsum(size)
        text = self.spelt[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - size), size)].tobytes()
        if first and self.leads[ids[0]]:
            text = text[1:]
        try:
            return text.decode()
        except UnicodeDecodeError:
            return self._mended(text)

    @staticmethod
    def _mended(text: bytes) -> str:
        """Bytes that are no character become a replacement character each."""
        out, at = [], 0
        while at < len(text):
            for size in (1, 2, 3, 4):
                try:
                    out.append(text[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class PieceEncoder(WordEncoder):
    """Texts to ids; each distinct stretch is merged once while it stays in the bounded table."""

    LETTERS = 16 << 20

    def __init__(self, model: Model):
        self.held = 0
        super().__init__(model)

    def known(self, words: np.ndarray) -> np.ndarray:
        self.held += sum(map(len, words.tolist()))
        if self.held > self.LETTERS:  # at most, as some of them are known already
            self.held = 0
            self._clear()
        return super().known(words)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of whole texts, with begin and end."""
        model = self.vocabulary
        texts = pc.replace_substring(texts, SPACE, " ")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        letters = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        cut = model.alone[letters]
        cut[1:] |= model.alone[letters[:-1]]
        if model.cut_at_spaces:
            space = letters == 32
            cut[1:] |= space[1:] & ~space[:-1]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(letters)).astype(np.int32)
        stretches = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters)).dictionary_encode()
        distinct = stretches.dictionary.to_numpy(zero_copy_only=False)
        numbers = self.known(distinct)[stretches.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.empty(0, np.int64)
        first, last = np.array([model.begin], np.int32), np.array([model.end], np.int32)
        rows = np.split(numbers, np.searchsorted(starts, offsets[1:-1])) if len(texts) else []
        return [np.concatenate([first, self.ids(row), last]) for row in rows]


_encoders: dict[str, PieceEncoder] = {}
_libraries: dict[str, sentencepiece.SentencePieceProcessor] = {}


def encoder(model: str) -> PieceEncoder:
    """The worker's encoder for a file sent with ``send_vocabulary``, built once per process."""
    if model not in _encoders:
        _encoders[model] = PieceEncoder(Model(SparkFiles.get(model)))
    return _encoders[model]


def library(model: str) -> sentencepiece.SentencePieceProcessor:
    if model not in _libraries:
        _libraries[model] = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(model))
    return _libraries[model]


def coded(docs: DataFrame, model: str, text: str = "text", id_column: str = "doc_id", check: bool = False) -> DataFrame:
    """Each row's id, number of ids, digests of ids and of the decoded text; ``agrees`` (null unless checked)."""
    name = send_vocabulary(docs.sparkSession, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name)
        for rows_in in batches:
            for batch in bounded(rows_in, size=SLICE):
                all_ids = coder.encode(column(batch, "text"))
                decoded = [coder.vocabulary.decode(ids) for ids in all_ids]
                agrees: list[bool | None] = [None] * len(all_ids)
                if check:
                    theirs = library(name).encode(column(batch, "text").to_pylist(), add_bos=True, add_eos=True, num_threads=1)
                    again = library(name).decode(theirs, num_threads=1)
                    agrees = [np.array_equal(a, b) and c == d for a, b, c, d in zip(all_ids, theirs, decoded, again, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "id"),
                        pa.array([len(ids) for ids in all_ids], pa.int64()),
                        pa.array([hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in all_ids], pa.string()),
                        pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                        pa.array(agrees, pa.bool_()),
                    ],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"],
                )

    rows = docs.select(F.col(id_column).alias("id"), whole(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean").withColumnRenamed("id", id_column)


def encode_column(docs: DataFrame, model: str, *columns: str, text: str = "text") -> DataFrame:
    """The chosen columns and ``ids array<int>``."""
    name = send_vocabulary(docs.sparkSession, model)
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], whole(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name)
        for rows_in in batches:
            for batch in bounded(rows_in, size=SLICE):
                ids = pa.array(coder.encode(column(batch, "text")), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*batch.schema.names[:-1], "ids"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, ids array<int>")


def decode_column(rows: DataFrame, model: str, *columns: str, ids: str = "ids") -> DataFrame:
    """The chosen columns and ``text`` decoded from ``ids``; null ids decode to an empty text, ids beyond the vocabulary fail."""
    name = send_vocabulary(rows.sparkSession, model)
    chosen = rows.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name)
        for batch in batches:
            texts = [coder.vocabulary.decode(np.array(row, np.int64)) for row in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{kinds}, text string")
