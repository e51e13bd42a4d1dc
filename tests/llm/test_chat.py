"""Conversation repair against brute force."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from trainscore.llm import chat_repair
from trainscore.llm.queries import QUERIES

NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]")
ACCEPTED = re.compile(r"(s?(ua)+)?")


def harmed(rows):
    """Rows (conv, turn, role, text) after damage, and every conversation."""
    convs = {r[0] for r in rows}
    out = defaultdict(list)
    blank = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out[conv] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return convs, out


def best_way(rows, faults):
    """Cheapest, then ASCII-least audit, with its text: uniform-cost search over whole audits."""
    n = len(rows)
    open_, done = [(0, "", 0, "", ())], set()
    while open_:
        cost, audit, i, roles, left = heapq.heappop(open_)
        if i == n and ACCEPTED.fullmatch(roles):
            return cost, audit, "\n".join(left)
        if (i, state := (roles[-1:], len(roles) > 0)) in done:
            continue
        done.add((i, state))
        due = "a" if roles.endswith("u") else "u"
        name = {"a": "assistant", "u": "user"}[due]
        heapq.heappush(open_, (cost + 2, audit + "I", i, roles + due, (*left, f"{name}:")))
        if i < n:
            _, role, text = rows[i]
            heapq.heappush(open_, (cost + 3, audit + "D", i + 1, roles, left))
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                if role[:1] == due or (role[:1] == "s" and not roles):
                    heapq.heappush(open_, (cost + cut, audit + "K", i + 1, roles + role[:1], (*left, f"{role}:{text}")))
                heapq.heappush(open_, (cost + cut + 2, audit + "R", i + 1, roles + due, (*left, f"{name}:{text}")))


def brute(rows, order=None):
    convs, kept = harmed(rows)
    out = []
    for conv in convs:
        mine = sorted(kept[conv], key=order or (lambda r: (r[0] is not None, r[0])))
        seen, faults = set(), []
        for _, role, text in mine:
            marks = NOT_SPACE.findall(text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "" if marks[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {r[0] for r in mine if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, text = best_way(mine, faults)
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, key string, known boolean, part long, tie int"


def made(rng, convs, size):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    texts = ["Yes.", "No!", "Why?", "And", "", " \t\n", "a\nb. ", "é…", None, "x" * 50 + "."]
    rows = []
    for conv in range(convs):
        n = size(rng)
        turns = rng.sample([*range(2 * n)], n)
        if n:
            turns[0] = rng.choice([None, turns[0]])
        rows += [(conv, t, rng.choice(roles[: rng.choice([2, 8])]), rng.choice(texts) if rng.random() < 0.3 else f"word {t}{rng.choice('.!?, ')}") for t in turns]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", True, 1, 2) for r in rows], SCHEMA)


def test_odd_conversations(spark):
    rng = random.Random(8)
    rows = made(rng, 300, lambda r: r.choice([1, 1, 2, 3, 5, 8, 12]))
    rows += [(None, i, "user" if i % 2 else "assistant", f"{i}.") for i in range(6)]
    assert got(chat_repair.repair(table(spark, rows).repartition(5))) == brute(rows)
    assert chat_repair.repair(table(spark, rows).limit(0)).count() == 0


def test_long_conversations_are_split(spark):
    """One conversation with most rows, over several partitions and many stretches."""
    rng = random.Random(9)
    rows = made(rng, 40, lambda r: r.choice([2, 4, 60]))
    roles = ["user", "assistant", "user", "assistant", "system"]
    rows += [(1000, 7 * i, rng.choice(roles) if rng.random() < 0.3 else roles[i % 2], rng.choice(["Same.", f"{i}.", f"{i}"])) for i in range(1500)]
    assert got(chat_repair.repair(table(spark, rows).repartition(7))) == brute(rows)


def test_repeated_rows_and_equal_turns(spark):
    rows = [(1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (2, None, "user", "a."), (2, None, "user", "a."), (2, None, "user", "a.")]
    assert got(chat_repair.repair(table(spark, rows))) == brute(rows)


def test_search_is_least_in_ascii_order():
    rng = random.Random(10)
    for _ in range(400):
        n = rng.randint(0, 9)
        rows = [(None, rng.choice(["user", "assistant", "system", "x"]), "") for _ in range(n)]
        faults = [rng.choice(["", "", "", "b", "d", "t"]) for _ in rows]
        names = {"b": "blank", "d": "duplicate", "t": "truncated", "": ""}
        cost, audit, _ = best_way(rows, [names[f] for f in faults])
        assert chat_repair.cheapest([r[1][:1] for r in rows], faults, chat_repair.START, chat_repair.ENDS) == (cost, audit)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_stretches_join_to_the_whole(size):
    rng = random.Random(size)
    for _ in range(200):
        n = rng.randint(0, 11)
        initials, faults = [rng.choice("uuaasx") for _ in range(n)], [rng.choice(["", "", "b", "t"]) for _ in range(n)]
        cuts = range(0, n, size)
        way = chat_repair.joined(chat_repair.ways(initials[i : i + size], faults[i : i + size]) for i in cuts)
        whole = chat_repair.cheapest(initials, faults, chat_repair.START, chat_repair.ENDS)
        assert (sum(w.cost for *_, w in way), "".join(w.audit for *_, w in way)) == whole


def test_undamaged_rows(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "u."), (1, 2, "assistant", "a.")]
    row = chat_repair.repair(table(spark, rows), harm=False).first()
    assert (row.cost, row.audit, row.gaps, row.illegal) == (0, "KKK", 0, 0)
    assert row.repaired_sha256 == hashlib.sha256(b"system:s.\nuser:u.\nassistant:a.").hexdigest()


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_chat_repair"](spark, sf_dir)) == brute(rows)
