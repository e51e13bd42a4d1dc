"""Ranked search against brute force and its SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from trainscore.llm import ranked_search
from trainscore.llm.queries import ORACLES, QUERIES

from .conftest import odd_texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Rows (item, rank, doc, score) straight from the definition."""
    counts = [(i, Counter(t), len(t)) for i, t in ((i, terms_of(text)) for i, text in docs) if t]
    n_docs, all_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        asked, rows = Counter(terms_of(text)), []
        for i, c, n in counts:
            m = 100 - 75 + 75 * n * n_docs // all_terms
            score = 0
            for t, reps in asked.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += reps * w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                rows.append((i, score))
        rows.sort(key=lambda r: (-r[1], r[0] is None, r[0]))
        out += [(item, rank, i, score) for rank, (i, score) in enumerate(rows[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms_are_those_of_the_pattern():
    rng = random.Random(1)
    letters = "aZé09 \n\t_-日\x00\x7f\x80@[`{É\xa0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    words = ranked_search.terms(pa.array(["skipped", *texts]).slice(1))
    for text, row in zip(texts, words.rows(words.numbers), strict=True):
        assert words.distinct[row].tolist() == terms_of(text)


def test_ranks_of_odd_documents_and_items(odd, empty, spark):
    texts = dict(odd_texts())
    items = [(1, texts[6]), (2, None), (3, ""), (4, "1234 x5678"), (5, " ".join(texts[100].split()[:9]) * 3), (5, texts[101]), (None, texts[102]), (7, texts[5]), (8, texts[6])]
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, key string, rank int")
    assert got(ranked_search.ranked(odd, asked)) == brute(odd_texts(), items)
    assert got(ranked_search.ranked(odd, asked, k=3)) == brute(odd_texts(), items, 3)
    assert ranked_search.ranked(empty, asked).count() == 0
    assert ranked_search.ranked(odd, asked.limit(0)).count() == 0


def test_many_small_shards_and_blocks(odd, spark, monkeypatch):
    """The k-th score carried from shard to shard, several blocks of items."""
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 500)
    items = [(i, text) for i, text in odd_texts()[-12:]]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got(ranked_search.ranked(odd, asked)) == brute(odd_texts(), items)


def corpus(rng, n):
    """Vectors with shared paths, equal ones, and a few long ones."""
    rows = []
    for _ in range(n):
        size = rng.choice([0, 1, 3, 10, 40, 200])
        rows.append(sorted({min(int(rng.expovariate(0.05)), 399) for _ in range(size)}))
    return rows + [rows[-1]] * 300


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_and_few_documents_are_scored(seed):
    rng = random.Random(seed)
    rows = corpus(rng, 3000)
    counts = [[rng.choice([1, 1, 2, 9]) for _ in row] for row in rows]
    ids = rng.sample(range(10**6), len(rows))
    m = np.array([rng.randint(25, 400) for _ in rows])
    flat = lambda x: np.array([v for row in x for v in row], np.int64)
    tree = ranked_search.Tree(ids, m, np.array([len(r) for r in rows]), flat(rows), flat(counts))
    every = {i: {t: 1_000_000_000 * c // (1000 * c + 8 * int(mm)) for t, c in zip(row, cs, strict=True)} for i, row, cs, mm in zip(ids, rows, counts, m, strict=True)}
    scored = 0
    for _ in range(20):
        ranks = np.array(sorted(rng.sample(range(400), 12)))
        weights = np.array([rng.randint(0, 9000) for _ in ranks])
        want = sorted(((sum(w * every[i].get(t, 0) for t, w in zip(ranks.tolist(), weights.tolist(), strict=True)), i) for i in ids), key=lambda x: (-x[0], x[1]))
        best = []
        scored += tree.search(ranks, weights, np.zeros(400, np.int64), best, 10)
        assert best == [x for x in want if x[0] > 0][:10]
        bound = tree.bounds(ranks, weights)
        top = dict((i, s) for s, i in want)
        for (a, b), high in zip(tree.nodes, bound.tolist(), strict=True):
            assert max(top[i] for i in tree.ids[a:b]) <= high
    assert scored < 0.8 * 20 * len(rows)


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    rows = QUERIES["op11_ranked_search"](spark, sf_dir)
    assert rows.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    want = sorted(con.execute(ORACLES["op11_ranked_search"]).fetchall(), key=repr)
    assert got(rows) == want and len(want) == 10 * len({w[0] for w in want})


def test_digests_tell_items_apart():
    block = ranked_search.block_of(["a b a", "", "c"])
    assert block.keys[1] == hashlib.sha256(b"").hexdigest() and len(block.terms[1]) == 0
    assert sorted(block.repeats[0].tolist()) == [1, 2]
