"""Vector searches against brute force."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from trainscore.llm import ann, topk
from trainscore.llm.queries import QUERIES


def lists(df):
    found = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(found[r.query_id]) + 1
        found[r.query_id].append((r.vec_id, r.score))
    return found


def embeddings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)


def by_hand(ids, x, query, k):
    scores = x @ x[query]
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[query]][:k]
    return [(int(ids[i]), scores[i]) for i in order]


def test_exact_search_equals_brute_force(spark, sf_dir, monkeypatch):
    ids, x = embeddings(spark, sf_dir)
    x = np.floor(256 * x)
    want = {int(ids[q]): by_hand(ids, x, q, 5) for q in np.flatnonzero(ids % 50 == 0)}
    assert lists(QUERIES["op7_topk"](spark, sf_dir)) == want
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    monkeypatch.setattr(topk, "LEAF", 4)
    assert lists(QUERIES["op7_topk"](spark, sf_dir)) == want


def test_approximate_search_finds_nine_of_ten(spark, sf_dir, monkeypatch):
    ids, x = embeddings(spark, sf_dir)
    for shard_rows in (ann.SHARD_ROWS, 100):
        monkeypatch.setattr(ann, "SHARD_ROWS", shard_rows)
        got = lists(QUERIES["op5_ann"](spark, sf_dir))
        found = total = 0
        for q in np.flatnonzero(ids % 20 == 0):
            want = by_hand(ids, x, q, 20)
            mine = dict(got[int(ids[q])])
            assert len(mine) == 20
            found, total = found + sum(i in mine for i, _ in want), total + 20
            assert all(s == pytest.approx(x[q] @ x[np.searchsorted(ids, i)], abs=1e-12) for i, s in mine.items())
        assert found >= 0.9 * total


ODD = [
    (0, [1.0, 0.0]),
    (50, [1.0, 0.0]),
    (50, [0.5, 0.5]),
    (3, [1.0, 0.0]),
    (4, [1.0, 0.0]),
    (5, None),
    (6, []),
    (7, [float("nan"), 1.0]),
    (8, [None, 1.0]),
    (9, [float("inf"), 1.0]),
    (None, [1.0, 0.0]),
    (10, [0.0, 0.0]),
    (100, [1.0, 2.0, 3.0]),
    (101, [1.0, 1.0, 1.0]),
]


def test_odd_vectors(spark):
    table = spark.createDataFrame([(i, v, 0, 1, 2.0) for i, v in ODD], "vec_id long, embedding array<double>, id int, shard int, score double")
    exact = lists(topk.top(table))
    assert [i for i, _ in exact[0]] == [3, 4, 50, 50, 10] and exact[0][0][1] == 256 * 256
    # Of two rows with the query's id the lesser vector asks; neither is its own neighbour.
    assert [i for i, _ in exact[50]] == [0, 3, 4, 10] and exact[100] == [(101, 6 * 65536)]
    near = lists(ann.nearest(table, every=50))
    assert [i for i, _ in near[0]] == [3, 4, 50, 50] and [i for i, _ in near[100]] == [101]
    none = table.limit(0)
    assert topk.top(none).count() == 0 and ann.nearest(none).count() == 0


def test_large_components_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sizes = rng.choice([1.0, 1e6, 1e8, 1e12, 1e15], 300)
    rows = [(i, [float(x) for x in rng.standard_normal(4) * size]) for i, size in enumerate(sizes)]
    # Products that differ in one, beyond doubles, and scores beyond a long.
    rows += [(350, [2.0**30, 1 / 256, 0.0, 0.0]), (351, [2.0**10, 1 / 256, 0.0, 0.0]), (352, [2.0**10, 2 / 256, 0.0, 0.0]), (400, [-1e300, 0.0, 0.0, 1.0])]
    whole = {i: [max(-(2**63), min(2**63, int(np.floor(256 * x)))) for x in v] for i, v in rows}
    long = 2**63 - 1
    want = {}
    for q in whole:
        if q % 50 == 0:
            scores = [(max(-long, min(long, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q]
            want[q] = [(i, s) for s, i in sorted(scores, key=lambda p: (-p[0], p[1]))[:5]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert lists(topk.top(table)) == want
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    monkeypatch.setattr(topk, "LEAF", 4)
    assert lists(topk.top(table)) == want
    plain = {350: whole[350], 351: whole[351], 352: whole[352]}
    got = topk.exact_products(np.array([plain[351], plain[352]], float), np.array(plain[350], float))
    assert got[1] - got[0] == 1 and got[0] > 2**53
