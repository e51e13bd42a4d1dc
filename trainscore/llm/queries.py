"""The queries that apply the operators to whole tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat_repair, langid, line_dedup, lm, near_dedup, packing, piece_bpe, ranked_search, secret_scan, substring_dedup, topk
from .words import documents, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.coded(documents(spark, sf_dir), WORD_BPE)


@query
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.predict(docs, model, F.col("doc_id"), langid.held_out().alias("held_out"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.found(documents(spark, sf_dir), BYTE_RANKS)


@query
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), n=3, percent=85)


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(documents(spark, sf_dir)).drop("kept")


@query
def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(documents(spark, sf_dir), WORD_BPE)


@query
def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(table(spark, sf_dir, "embeddings"), k=5, every=50)


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dropped, left = line_dedup.without_recurring(documents(spark, sf_dir))
    return rows.select("doc_id", F.col(dropped).alias("n_dropped"), F.sha2(F.coalesce(left, F.lit("")), 256).alias("kept_sha256"))


ORACLES["op1_line_dedup"] = r"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents WHERE text IS NOT NULL
), spaced AS (
  SELECT doc_id, text, line, place, string_split(trim(regexp_replace(line, '[ \t\r\x0B\f]+', ' ', 'g')), ' ') AS words FROM raw
), hidden AS (
  SELECT doc_id, text, line, place, words, list_transform(words, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS tokens FROM spaced
), each AS (
  SELECT *, array_to_string(tokens, ' ') AS masked, array_to_string(list_slice(tokens, 1, 3), ' ') AS head, len(tokens) AS size,
    len(list_filter(words, lambda w: w <> '' AND NOT regexp_matches(w, '[0-9]'))) > 0 AS constant,
    array_to_string(words, ' ') AS spaced FROM hidden
), counts AS (
  SELECT size, head, masked, any_value(tokens) AS tokens, count(DISTINCT (doc_id, text)) AS n,
    size * 20 // 100 AS spare, greatest(1, size * 20 // 100 // 2) AS half FROM each WHERE constant GROUP BY size, head, masked
), shared AS (
  SELECT *, (size - 3 + half - 1) // half AS blocks FROM counts WHERE spare > 0 AND size > 3 QUALIFY count(*) OVER (PARTITION BY size, head) > 1
), opened AS (
  SELECT *, unnest(range(a, CASE WHEN spare > 1 THEN blocks ELSE a + 1 END)) AS b FROM (SELECT *, unnest(range(0, blocks)) AS a FROM shared)
), shapes AS (
  SELECT size, head, masked, n, a, b, array_to_string(list_concat(['open', CAST(a AS VARCHAR), CAST(b AS VARCHAR)],
    list_transform(tokens, lambda w, i: CASE WHEN i > 3 AND (i - 4) // half IN (a, b) THEN '' ELSE w END)), ' ') AS shape FROM opened
), votes AS (
  SELECT *, sum(n) OVER (PARTITION BY size, shape) AS total, count(*) OVER (PARTITION BY size, shape) AS m FROM shapes
), belongs AS (
  SELECT masked, shape FROM votes WHERE m > 1 QUALIFY row_number() OVER (PARTITION BY masked ORDER BY total DESC, a, b) = 1
), owned AS (
  SELECT e.*, CASE WHEN e.constant THEN coalesce('2 ' || b.shape, '1 ' || e.masked) WHEN e.spaced <> '' THEN '0 ' || e.spaced END AS template
  FROM each e LEFT JOIN belongs b ON e.constant AND e.masked = b.masked
), recurring AS (
  SELECT template, min(doc_id) AS first FROM owned WHERE template IS NOT NULL GROUP BY template HAVING count(DISTINCT (doc_id, text)) >= 5
), judged AS (
  SELECT o.doc_id, o.text, o.line, o.place, r.template IS NOT NULL AND o.doc_id <> r.first AS gone FROM owned o LEFT JOIN recurring r ON o.template = r.template
), kept AS (
  SELECT doc_id, text, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id, text
)
SELECT d.doc_id, coalesce(k.n_dropped, 0) AS n_dropped, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), WORD_BPE)


@query
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.coded(documents(spark, sf_dir), PIECE_BPE, check=True)


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), k=10)


ORACLES["op11_ranked_search"] = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sizes AS (
  SELECT doc_id, r, len(terms) AS n FROM words WHERE len(terms) > 0
), total AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes
), asked AS (
  SELECT item_id, row_number() OVER () AS i, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark
), wanted AS (
  SELECT item_id, i, term, count(*) AS reps FROM (SELECT item_id, i, unnest(terms) AS term FROM asked) GROUP BY ALL
), counts AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM words) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term, docs
), scored AS (
  SELECT w.item_id, w.i, s.doc_id, s.r,
    CAST(sum(w.reps * g.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (100 - 75 + (75 * s.n * t.docs) // t.all_terms)))) AS BIGINT) AS score
  FROM wanted w JOIN counts c ON w.term = c.term JOIN weights g ON w.term = g.term JOIN sizes s ON c.r = s.r, total t
  GROUP BY w.item_id, w.i, s.doc_id, s.r
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""


@query
def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(table(spark, sf_dir, "conversations"))
