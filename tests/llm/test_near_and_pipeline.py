"""Near duplicates against all pairs, and the pipeline stage by stage."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trainscore.llm import near_dedup
from trainscore.llm.queries import QUERIES
from trainscore.llm.tables import Scratch, connected

from .conftest import SCHEMA, odd_texts, rows_of
from .test_texts import check_pieces, encoded


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if 0 < len(words) < n:
        return {tuple(words)}
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def components_by_hand(texts, n, percent):
    sets = [shingles(t, n) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(texts)):
        members[find(i)].append(texts[i][0])
    least = {r: min((m for m in ms if m is not None), default=None) for r, ms in members.items()}
    return sorted(((texts[i][0], len(sets[i]), least[find(i)], texts[i][0] == least[find(i)]) for i in range(len(texts))), key=repr)


def family(rng, size, edits, n=90):
    """Variants of one text, each with some words changed."""
    base = [f"w{rng.randint(0, 500)}" for _ in range(n)]
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(n)] = f"x{rng.randint(0, 10_000)}"
        yield " ".join(words)


def corpus():
    rng = random.Random(9)
    texts = [t for k in range(8) for t in family(rng, 12, 6)] + list(family(rng, 120, 8))
    rng.shuffle(texts)
    return [(500 + i, t) for i, t in enumerate(texts)] + odd_texts()


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, n, percent, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4)
    want = components_by_hand(texts, n, percent)
    assert sorted(map(tuple, near_dedup.near_duplicates(docs, n, percent).collect()), key=repr) == want
    # Dense runs, small blocks: the same components.
    monkeypatch.setattr(near_dedup, "DENSE", 5)
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 16)
    assert sorted(map(tuple, near_dedup.near_duplicates(docs, n, percent).collect()), key=repr) == want


def test_one_of_each_group_stays(spark, empty):
    texts = corpus()
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    by_hand = components_by_hand(texts, 5, 80)
    groups = {c for i, size, c, _ in by_hand if size and c is not None}
    assert sorted(i for i in left if i is not None and i > 3) == sorted(groups)
    assert sorted(i for i in left if i is not None and i <= 3) == [1, 2, 3] and left.count(None) == 2
    assert near_dedup.deduplicated(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0


def test_connected_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300) if i != 150]
    found = connected(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {i: 0 if i <= 150 else 151 for i in range(301)}
    assert connected(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_all_pairs(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op10_near_dedup"](spark, sf_dir).collect()), key=repr)
    assert got == components_by_hand(texts, 3, 85)


def test_stages_keep_columns_and_clean_documents(spark, sf_dir, tokenizer, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.dtypes, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.dtypes == columns
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        before = {r.doc_id: r.text for r in docs.collect()}
        left = {r.doc_id: r.text for r in after.collect()}
        assert len(left) == after.count() and set(left) <= set(before)
        assert after.filter(F.col("n_chars") != F.length("text")).count() == 0
        if name in ("language", "secrets"):
            assert set(left) == set(before)
        if name == "near_copies":
            by_hand = components_by_hand(list(before.items()), 5, 80)
            assert set(left) == {i for i, _, c, _ in by_hand if i == c}
        docs = after
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_pieces(pieces, encoded(tokenizer, texts))
    check_pieces(corpus_pipeline.run(spark, sf_dir).collect(), encoded(tokenizer, texts))
    assert seen > len(texts)


def test_pipeline_takes_odd_and_empty_tables(spark, odd, empty, sf_dir, tmp_path):
    for k, docs in enumerate((odd, empty)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, sf_dir)
            assert name == "packing" or after.dtypes == docs.dtypes
            after.write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.schema(after.schema).parquet(f"{tmp_path}/{k}-{name}")
        assert k == 1 or docs.count() > 0


def test_near_copies_have_few_edges(spark):
    """Three thousand near copies: the trees agree on their edges."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(3000):
        text = words.copy()
        for _ in range(2):
            text[rng.randrange(400)] = f"x{rng.randrange(10**9)}"
        rows.append((i, str(i), " ".join(text)))
    docs = spark.createDataFrame(rows, "id long, key string, text string")
    classes = near_dedup.signed(docs, 5).select("class", "sig")
    edges = near_dedup.thinned(near_dedup.regions(classes, 0.8))
    assert edges.count() == edges.distinct().count() <= 2 * 3000
    found = near_dedup.near_duplicates(docs.withColumnRenamed("id", "doc_id"), 5, 80)
    assert found.select("component_id").distinct().count() == 1
