"""The registered corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftline.llm import (
    alignment, bpe, chat, collocations, fingerprints, jaccard, packing, quality_model, quality_rules, sharding, toxicity, vectors,
    warc,
)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(_table(spark, sf_dir, "documents"), 16)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(_table(spark, sf_dir, "conversations"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), VOCABULARY)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_groups(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), VOCABULARY)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.grouped(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_table(spark, sf_dir, "documents"), VOCABULARY, PIECES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_shards, op2_chat, op3_bpe, op4_warc, op5_quality_rules, op6_quality, op7_jaccard, op8_toxicity,
        op9_packing, op10_fingerprints, op11_collocations, op12_vectors, op13_alignment,
    )
}

_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), runs AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS words FROM pieces
), totals AS (SELECT lang, sum(len(words)) AS n FROM runs GROUP BY lang
), placed AS (
  SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM runs, generate_series(1, 5) AS s(k)
), counts AS (
  SELECT lang, k, list_slice(words, i, i + k - 1) AS phrase, count(*) AS f FROM placed GROUP BY ALL
), often AS (SELECT * FROM counts WHERE k > 1 AND f >= 100
), kept AS (
  SELECT * FROM often o WHERE NOT EXISTS (
    SELECT 1 FROM often p WHERE p.lang = o.lang AND p.k > o.k AND p.f >= o.f AND contains(
      ' ' || array_to_string(p.phrase, ' ') || ' ', ' ' || array_to_string(o.phrase, ' ') || ' '))
), cuts AS (
  SELECT kept.*, j, list_slice(phrase, 1, j) AS head, list_slice(phrase, j + 1, k) AS rest
  FROM kept, generate_series(1, 4) AS s(j) WHERE j < k
), scored AS (
  SELECT c.lang, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, t.n,
    (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.head
  JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER w AS rank, array_to_string(phrase, ' ') AS phrase, a, l, r,
  n::BIGINT AS n, score::BIGINT AS score
FROM lowest WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' '))
QUALIFY rank <= 2000
"""
_VECTORS = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a
  JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reached AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
  (SELECT min(other) FROM reached r WHERE r.vec_id = e.vec_id) AS component_id,
  e.vec_id = (SELECT min(other) FROM reached r WHERE r.vec_id = e.vec_id) AS kept
FROM embeddings e
"""
#: SQL where it can express the query and is quick enough on whole tables.
ORACLE: dict[str, str] = {"op11_collocations": _COLLOCATIONS, "op12_vectors": _VECTORS}
