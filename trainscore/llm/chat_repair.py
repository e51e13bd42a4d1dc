"""Conversation structure repair by iterative-deepening A*.

A conversation's rows are kept, given another role, deleted, or joined by rows with an empty
text until the roles' initials read ``(s?(ua)+)?``. Keep (``K``) costs 0, Rerole (``R``, to user or assistant) 2,
Delete (``D``) 3, Insert (``I``, user or assistant) 2; a truncated row that stays adds 1; blank and
repeated rows must go. The answer is the cheapest row of edits, of equally cheap ones the
least in ASCII order. The search goes depth first in the order D, I, K, R under a bound of the
cost, which rises to the least cost that went beyond it; a path's rest costs at least what its
blank, repeated and truncated rows cost by themselves. A place in the rows and a role's turn that failed
with some cost to spare is not searched again with no more to spare. So the first path that
reaches the end is the answer.

Rows are range-partitioned by conversation and turn, so a conversation of any size is spread
over tasks; within one task it is searched stretch by stretch (``STRETCH`` rows). A conversation that
lies inside one partition is answered there. The others (two a partition at most, and those too
long for one) go through tables: their first occurrences of role and text are a pre-aggregated
minimum, each stretch is searched once for each pair of turns it can begin and end with, and
stretches are joined by their costs and edits, which takes some bytes a row; the repaired
text is hashed as a stream.

Defined cases: null roles and texts are one space, a null conversation is one conversation, null turns come
first. Rows of equal turn are taken in the order of a hash of role and text. Repeated rows are rows of their own: all but the
first are duplicates. A conversation without rows after damage has zeros, an empty audit and the digest of nothing.
Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch
from .words import column, groups_of

STRETCH = 48  # rows searched at once

# Whose turn it is: nothing yet, after a system row, after a user row, after an assistant row.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
TURNS = (START, AFTER_S, AFTER_U, AFTER_A)
ENDS = (START, AFTER_A)
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
DUE = {START: "u", AFTER_S: "u", AFTER_A: "u", AFTER_U: "a"}
ROLE = {"u": "user", "a": "assistant"}
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
LEGAL = {"su", "ua", "au"}

NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]")


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str


# ---- faults


def fault_of(row: Row, repeated: bool) -> str:
    """``b``, ``d`` or ``t`` for a blank, repeated or truncated row, else nothing."""
    kept = row.text.strip(" \t\n\v\f\r")
    if not kept:
        return "b"
    if repeated:
        return "d"
    return "" if kept[-1] in ".!?" else "t"


def faults_of(rows: list[Row]) -> list[str]:
    """The first fault of each row of a whole conversation."""
    seen: set[tuple[str, str]] = set()
    out = []
    for row in rows:
        key = row.role, row.text
        out.append(fault_of(row, key in seen))
        seen.add(key)
    return out


# ---- the search


def cheapest(initials: list[str], faults: list[str], begin: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and edits of the cheapest, then ASCII-least way through the rows, or None if there is none."""
    n = len(initials)
    rest = [0] * (n + 1)  # what the rows from here on cost at least
    if set(ends) <= {START, AFTER_S}:
        # All rows go, but for one that a system row's turn may keep.
        kept = [i for i in range(n) if initials[i] == "s" and faults[i] not in ("b", "d") and AFTER_S in ends and begin == START]
        if begin not in ends and not kept:
            return None
        rest = [DELETE * (n - i - (bool(kept) and i <= kept[-1])) for i in range(n + 1)]
    else:
        for i in range(n - 1, -1, -1):
            rest[i] = rest[i + 1] + (DELETE if faults[i] in ("b", "d") else CUT if faults[i] else 0)
    failed: dict[tuple[int, int], int] = {}
    bound = rest[0]
    # Beyond this no path can be needed: all rows but those that must stay are deleted and three inserted.
    most = DELETE * n + 3 * INSERT
    while bound <= most:
        beyond = None
        path: list[str] = []
        # A frame: place, turn, cost so far, the edits still to be tried.
        open_ = [(0, begin, 0, _edits(0, begin, initials, faults))]
        while open_:
            i, turn, cost, edits = open_[-1]
            if i == n and turn in ends:
                return cost, "".join(path)
            step = next(edits, None)
            if step is None:
                spare = bound - cost
                if failed.get((i, turn), -1) < spare:
                    failed[i, turn] = spare
                open_.pop()
                if path:
                    path.pop()
                continue
            edit, to, then, price = step
            so_far = cost + price
            least = so_far + rest[to]
            if least > bound:
                beyond = least if beyond is None else min(beyond, least)
            elif failed.get((to, then), -1) < bound - so_far:
                path.append(edit)
                open_.append((to, then, so_far, _edits(to, then, initials, faults)))
            else:
                # It failed with as much to spare, for lack of at least one more.
                beyond = bound + 1
        if beyond is None:
            return None
        bound = beyond
    return None


def _edits(i: int, turn: int, initials: list[str], faults: list[str]) -> Iterator[tuple[str, int, int, int]]:
    """Edit, place and turn after it, price: in ASCII order."""
    due = DUE[turn]
    here = i < len(initials)
    if here:
        yield "D", i + 1, turn, DELETE
    yield "I", i, NEXT[turn, due], INSERT
    if here and faults[i] not in ("b", "d"):
        cut = CUT if faults[i] else 0
        kept = NEXT.get((turn, initials[i]))
        if kept is not None:
            yield "K", i + 1, kept, cut
        yield "R", i + 1, NEXT[turn, due], REROLE + cut


class Way(NamedTuple):
    cost: int
    audit: str


Ways = dict[tuple[int, int], Way]


def ways(initials: list[str], faults: list[str]) -> Ways:
    """For each turn to begin and to end with, the best way through a stretch."""
    out = {}
    for begin in TURNS:
        for end in TURNS:
            found = cheapest(initials, faults, begin, (end,))
            if found:
                out[begin, end] = Way(*found)
    return out


def joined(stretches: Iterable[Ways]) -> list[tuple[int, int, Way]]:
    """The best way through consecutive stretches: each one's turns at its ends and its way.

    From the last to the first, the best rest for each turn is kept; equal costs are told apart by all edits that follow.
    """
    stretches = list(stretches)
    after: dict[int, Way] = {turn: Way(0, "") for turn in ENDS}
    choice: list[dict[int, int]] = []
    for found in reversed(stretches):
        best: dict[int, tuple[int, str, int]] = {}
        for (begin, end), way in found.items():
            if end in after:
                whole = way.cost + after[end].cost, way.audit + after[end].audit, end
                if begin not in best or whole[:2] < best[begin][:2]:
                    best[begin] = whole
        choice.append({begin: end for begin, (_, _, end) in best.items()})
        after = {begin: Way(cost, audit) for begin, (cost, audit, _) in best.items()}
    turn, out = START, []
    for found, to in zip(stretches, reversed(choice), strict=True):
        out.append((turn, to[turn], found[turn, to[turn]]))
        turn = to[turn]
    return out


def repaired(rows: Iterable[Row], audit: str, turn: int) -> Iterator[str]:
    """``role:text`` of the rows that an audit leaves, beginning with a turn."""
    rows = iter(rows)
    for edit in audit:
        row = next(rows) if edit != "I" else None
        if edit == "D":
            continue
        if edit == "K":
            turn = NEXT[turn, row.role[:1]]
            yield f"{row.role}:{row.text}"
        else:
            due = DUE[turn]
            turn = NEXT[turn, due]
            yield f"{ROLE[due]}:{row.text if row else ''}"


# ---- what is counted


class Counts(NamedTuple):
    """Of consecutive rows; ``merged`` adds what follows."""

    least: int | None = None
    most: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None  # initials of the first and last row, None without rows
    last: str | None = None

    @classmethod
    def of(cls, rows: list[Row], faults: list[str]) -> Counts:
        if not rows:
            return cls()
        turns = [r.turn for r in rows if r.turn is not None]
        initials = [r.role[:1] for r in rows]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        kinds = (faults.count("b"), faults.count("d"), faults.count("t"))
        return cls(min(turns, default=None), max(turns, default=None), len(set(turns)), *kinds, illegal, initials[0], initials[-1])

    def merged(self, then: Counts) -> Counts:
        if self.first is None or then.first is None:
            return self if then.first is None else then
        shared = self.most is not None and self.most == then.least
        return Counts(
            then.least if self.least is None else self.least,
            self.most if then.most is None else then.most,
            self.turns + then.turns - shared,
            self.blank + then.blank,
            self.duplicate + then.duplicate,
            self.truncated + then.truncated,
            self.illegal + then.illegal + (self.last + then.first not in LEGAL),
            self.first,
            then.last,
        )

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


def answer(rows: list[Row]) -> tuple:
    """The result of one whole conversation: counts, cost, audit, digest."""
    faults = faults_of(rows)
    counts = Counts.of(rows, faults)
    initials = [r.role[:1] for r in rows]
    if len(rows) <= STRETCH:
        cost, audit = cheapest(initials, faults, START, ENDS)
    else:
        cuts = range(0, len(rows), STRETCH)
        way = [w for _, _, w in joined(ways(initials[i : i + STRETCH], faults[i : i + STRETCH]) for i in cuts)]
        cost, audit = sum(w.cost for w in way), "".join(w.audit for w in way)
    digest = hashlib.sha256("\n".join(repaired(rows, audit, START)).encode()).hexdigest()
    return counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, audit, digest


# ---- over tables

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
WAYS = "begins array<int>, ends array<int>, costs array<long>, audits array<string>"
COUNTS = "least long, most long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, there``: the rows after damage by the checksum of ``conv:turn``; dropped ones are not ``there``."""

    def part(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = conversations.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        part(role).alias("role"),
        part(text).alias("text"),
        (F.crc32(F.concat(part(conv), F.lit(":"), part(turn)).cast("binary")) % 20).alias("draw"),
    )
    harmed = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    there = F.col("draw") != 0
    return rows.select(
        "conv",
        "turn",
        F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(there, harmed).otherwise(F.lit("")).alias("text"),
        there.alias("there"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


KEY = ["known", "key"]  # a conversation, told apart without nulls


def _key() -> list[Column]:
    return [F.col("conv").isNotNull().alias("known"), F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("key")]


def _rows_of(run: pa.Table) -> list[Row]:
    return [Row(t, r, x) for t, r, x, there in zip(*(run[c].to_pylist() for c in ("turn", "role", "text", "there")), strict=True) if there]


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows of a conversation side by side in the order of their turns, over as many partitions as it takes."""
    tie = F.xxhash64("role", "text")
    marked = rows.select("*", *_key(), tie.alias("tie"), F.monotonically_increasing_id().alias("place"))
    order = [*KEY, F.col("turn").asc_nulls_first(), "tie", "place"]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order).select(*KEY, "conv", "turn", "role", "text", "there")


def _answered(rows: DataFrame) -> DataFrame:
    """Answers of the conversations inside one partition, and the rows of all others with their place."""
    kind = rows.schema["conv"].dataType.simpleString()
    fields = f"conv {kind}, split boolean, part long, place long, turn long, role string, text string, there boolean, {RESULT}"
    names = re.findall(r"(\w+) \S+(?:, |$)", fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema: pa.Schema | None = None
        types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.string()]

        def table(conv: list, *columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([conv, *columns], schema.types, strict=True)], schema=schema)

        def apart(conv: Any, rows_in: pa.Table, place: int) -> pa.RecordBatch:
            n = rows_in.num_rows
            own = [rows_in[c].to_pylist() for c in ("turn", "role", "text", "there")]
            return table([conv] * n, [True] * n, [part] * n, [*range(place, place + n)], *own, *[[None] * n] * 8)

        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            convs, answers = [h[0] for h in held], list(zip(*(h[1] for h in held), strict=True))
            n = len(held)
            held.clear()
            return table(convs, [False] * n, *[[None] * n] * 6, *map(list, answers))

        place, first, waiting = 0, True, None
        for rows_in in groups_of(batches, KEY):
            conv = rows_in["conv"][0].as_py()
            schema = schema or pa.schema(list(zip(names, [rows_in.schema.field("conv").type, *types], strict=True)))
            if waiting is not None:
                # Neither the partition's first nor its last conversation: it lies here whole.
                if first:
                    yield apart(*waiting)
                    first = False
                else:
                    held.append((waiting[0], answer(_rows_of(waiting[1]))))
                    if len(held) == 1000:
                        yield flush()
            waiting = (conv, rows_in, place)
            place += rows_in.num_rows
        if held:
            yield flush()
        if waiting is not None:
            yield apart(*waiting)

    return rows.mapInArrow(run, fields)


def _stretches(rows: DataFrame, kind: str) -> DataFrame:
    """Counts and ways of each stretch of rows that carry their faults; sorted by conversation and place."""
    fields = f"conv {kind}, part long, stretch long, {COUNTS}, {WAYS}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in groups_of(batches, [*KEY, "part", "stretch"]):
            rows_in = _rows_of(some)
            again = [a for a, there in zip(some["again"].to_pylist(), some["there"].to_pylist(), strict=True) if there]
            faults = [fault_of(r, a) for r, a in zip(rows_in, again, strict=True)]
            found = ways([r.role[:1] for r in rows_in], faults)
            own = [*Counts.of(rows_in, faults), [b for b, _ in found], [e for _, e in found], [w.cost for w in found.values()], [w.audit for w in found.values()]]
            head = [some[c].slice(0, 1).combine_chunks() for c in ("conv", "part", "stretch")]
            types = [*[pa.int64()] * 7, pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]
            names = ["conv", "part", "stretch", *Counts._fields, "begins", "ends", "costs", "audits"]
            yield pa.RecordBatch.from_arrays([*head, *[pa.array([v], t) for v, t in zip(own, types, strict=True)]], names=names)

    return rows.mapInArrow(run, fields)


def _joined(stretches: DataFrame, kind: str) -> DataFrame:
    """For each conversation its counts, cost and audit (``part`` null), and for each stretch its own audit and first turn."""
    fields = f"conv {kind}, part long, stretch long, turn int, audit string, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"
    names = re.findall(r"(\w+) \S+(?:, |$)", fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in groups_of(batches, KEY):
            found = [
                {(b, e): Way(c, a) for b, e, c, a in zip(*row, strict=True)}
                for row in zip(*(some[c].to_pylist() for c in ("begins", "ends", "costs", "audits")), strict=True)
            ]
            counts = Counts()
            for row in zip(*(some[c].to_pylist() for c in Counts._fields), strict=True):
                counts = counts.merged(Counts(*row))
            path = joined(found)
            n, conv = len(path), some["conv"]
            totals = [sum(w.cost for *_, w in path), counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal]
            columns = [
                pa.concat_arrays([conv.combine_chunks(), conv.slice(0, 1).combine_chunks()]),
                pa.array([*some["part"].to_pylist(), None], pa.int64()),
                pa.array([*some["stretch"].to_pylist(), None], pa.int64()),
                pa.array([*[turn for turn, _, _ in path], None], pa.int32()),
                pa.array([*[w.audit for *_, w in path], "".join(w.audit for *_, w in path)], pa.string()),
                *[pa.array([*[None] * n, total], pa.int64()) for total in totals],
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return stretches.mapInArrow(run, fields)


def _digests(rows: DataFrame, kind: str) -> DataFrame:
    """``conv, repaired_sha256`` of stretches' repaired texts, sorted by conversation and place, as a stream."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, at, conv, empty = hashlib.sha256(), None, None, True

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([conv, pa.array([digest.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])

        for batch in batches:
            for i in range(batch.num_rows):
                known, key, text = (column(batch, c)[i].as_py() for c in (*KEY, "text"))
                if (known, key) != at:
                    if at is not None:
                        yield done()
                    digest, at, conv, empty = hashlib.sha256(), (known, key), column(batch, "conv").slice(i, 1), True
                if text is not None:
                    digest.update(text if empty else b"\n" + text)
                    empty = False
        if at is not None:
            yield done()

    return rows.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def _texts(rows: DataFrame, kind: str) -> DataFrame:
    """``conv, text, part, stretch``: each stretch's repaired rows as bytes, null if none is left."""
    fields = f"conv {kind}, text binary, part long, stretch long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in groups_of(batches, [*KEY, "part", "stretch"]):
            left = list(repaired(_rows_of(some), some["audit"][0].as_py(), some["begin"][0].as_py()))
            text = "\n".join(left).encode() if left else None
            head = [some[c].slice(0, 1).combine_chunks() for c in ("conv", "part", "stretch")]
            yield pa.RecordBatch.from_arrays([head[0], pa.array([text], pa.binary()), *head[1:]], names=["conv", "text", "part", "stretch"])

    return rows.mapInArrow(run, fields)


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", harm: bool = True) -> DataFrame:
    """A row for each conversation: its faults, the cost and initials of its edits, the digest of what is repaired.

    ``harm`` damages the rows first; without it they are repaired as they are.
    """
    scratch = Scratch(conversations.sparkSession)
    if harm:
        rows = damaged(conversations, conv, turn, role, text)
    else:
        plain = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
        rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), *plain, F.lit(True).alias("there"))
    first = scratch.keep(_answered(_in_order(rows)), "conversations")
    kind = first.schema["conv"].dataType.simpleString()
    results = [f.split()[0] for f in RESULT.split(", ")]
    whole = first.filter("not split").select("conv", *results)

    apart = first.filter("split").select("*", *_key(), F.floor(F.col("place") / STRETCH).alias("stretch"))
    # The first row of each role and text: a minimum that is pre-aggregated, then joined back.
    apart = apart.withColumn("same", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    where = F.struct("part", "place")
    firsts = apart.filter("there").groupBy(*KEY, "same").agg(F.min(where).alias("at"))
    stretch = [*KEY, "part", "stretch"]
    marked = apart.join(firsts, [*KEY, "same"], "left").withColumn("again", F.coalesce(F.col("at") != where, F.lit(False)))
    kept = scratch.keep(marked.select(*stretch, "conv", "place", "turn", "role", "text", "there", "again"), "stretches")
    parts = _stretches(kept.repartition(*stretch).sortWithinPartitions(*stretch, "place"), kind)
    paths = scratch.keep(_joined(parts.select("*", *_key()).repartition(*KEY).sortWithinPartitions(*stretch), kind), "paths").select("*", *_key())

    own = paths.filter("part is not null").select(*stretch, F.col("turn").alias("begin"), "audit")
    # Dealt by a hash of its own: a repartition by the join's keys is left out by the optimizer, whose split of skewed joins then cuts stretches.
    told = kept.join(own, stretch).repartition(F.xxhash64(*stretch)).sortWithinPartitions(*stretch, "place")
    texts = _texts(told, kind).select("*", *_key()).repartition(*KEY).sortWithinPartitions(*stretch)
    digests = _digests(texts, kind).select(*_key(), "repaired_sha256")
    totals = paths.filter("part is null").join(digests, KEY)
    return whole.unionByName(totals.select("conv", *results)).withColumnRenamed("conv", conv)
