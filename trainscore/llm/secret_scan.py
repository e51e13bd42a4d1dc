"""Secrets in texts: fixed patterns, and random strings told by how badly a tokenizer packs them.

A vocabulary learned from natural text spends few characters per token on random strings.
A run of key-like characters of at least ``MIN_LENGTH`` that mixes letters and digits, and is
no known digest or identifier, is a secret when it has fewer than ``MAX_CHARS_PER_TOKEN``
characters per token. Every text is read whole, whatever its length.

A null text is an empty one and has no spans. Rows are judged one by one: repeated rows
and ids give repeated results, ties cannot arise. Other columns are not read, or pass
through unchanged where a whole row is returned.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import send_vocabulary
from .words import bounded, column, whole

# Fixed by the contract of the query: kinds in order, their patterns, what a match must have.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_MARKS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this finds what [0-9a-f]+ finds, less the short ones
MIN_ASSIGNED, MIN_ACCESS = 6, 20

MIN_LENGTH = 20
MAX_CHARS_PER_TOKEN = 2.2
KEY_LIKE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.DOTALL)
# Digests and identifiers that are random by nature and no secrets: digest lengths in hex
# (either case), UUIDs, words and plain numbers joined by - _ or /.
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
JOINED = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/=+]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[-_/=+]*")

MASK = "[SECRET]"
SLICE = 4 << 20  # bytes of text masked at a time

# The split of text before merges, as the vocabulary's own description gives it.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(name: str) -> tiktoken.Encoding:
    """The worker's tiktoken vocabulary, from the file sent under this name."""
    if name not in _encodings:
        with open(SparkFiles.get(name), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encodings[name] = tiktoken.Encoding(name, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def is_random(run: str, tokens: tiktoken.Encoding) -> bool:
    if not MIXED.match(run) or DIGEST.fullmatch(run) or UUID.fullmatch(run) or JOINED.fullmatch(run):
        return False
    return len(run) < MAX_CHARS_PER_TOKEN * len(tokens.encode_ordinary(run))


Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, by start and kind; places are code points."""
    found: list[Span] = []
    low = text.lower()
    if any(mark in low for mark in ASSIGN_MARKS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str, base: list[Span], tokens: tiktoken.Encoding) -> list[Span]:
    """The base spans and the random strings that touch none of them; both lists are gone through once, side by side."""
    more: list[Span] = []
    at = reach = 0
    for m in KEY_LIKE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and is_random(m[0], tokens):
            more.append((m.start(), 3, m.end()))
    return sorted([*base, *more])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def masked(text: str, spans: list[Span], mask: str = MASK) -> str:
    """The text with the mask in place of each span (of overlapping ones together)."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def found(docs: DataFrame, vocabulary: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Each row's id, its number of spans of each fixed kind, their digest, and all its spans."""
    name = send_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(name)
        for rows_in in batches:
            for batch in bounded(rows_in):
                texts = column(batch, "text").to_pylist()
                base = [base_spans(t) for t in texts]
                counts = [pa.array([sum(k == kind for _, k, _ in spans) for spans in base], pa.int64()) for kind in range(3)]
                digests = pa.array([hashlib.sha256(written(spans).encode()).hexdigest() for spans in base], pa.string())
                spans = pa.array([written(all_spans(t, b, tokens)) for t, b in zip(texts, base, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "id"), *counts, digests, spans], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
                )

    rows = docs.select(F.col(id_column).alias("id"), whole(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def redacted(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """All rows and columns, with every secret in the text replaced by ``MASK``; null texts stay null."""
    name = send_vocabulary(docs.sparkSession, vocabulary)
    place = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(name)
        for rows_in in batches:
            for batch in bounded(rows_in, text, SLICE):
                texts = batch.column(place).to_pylist()
                clean = [t if t is None else masked(t, all_spans(t, base_spans(t), tokens)) for t in texts]
                columns = [*batch.columns]
                columns[place] = pa.array(clean, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
