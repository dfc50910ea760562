"""One query per operator: thin calls with production parameters over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxlake.llm import (
    decontaminate, fertility, fp_search, hard_negatives, line_blocks, mixing, passages, perspectives, prefix_join, pseudonyms,
    repeats, url_models, warc,
)
from taxlake.llm.shared import only

#: The key of the pseudonyms; whoever runs the job for real passes a secret one.
PSEUDONYM_KEY = "taxlake-public-key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and conversion records of all pages."""
    return warc.derived(warc.responses(_table(spark, sf_dir, "pages")))


def op2_url_model_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_models.judged(_table(spark, sf_dir, "pages"))


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and benchmark item that overlap."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op5_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixing order of all documents, without their texts."""
    return mixing.mixed(only(_table(spark, sf_dir, "documents"), "doc_id", "source"))


def op7_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = fertility.fertility_rules(_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lang", "script", "n_tokens", "chars_per_token", "fallback_share", "token_entropy",
    )


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered dialogues, each whole for every participant; the mask as text, ``start-end`` joined by commas."""
    seen = perspectives.rotated(_table(spark, sf_dir, "conversations"))
    return seen.withColumn(
        "mask",
        F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ","),
    )


def op9_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return passages.scored(docs, passages.trained(docs, _table(spark, sf_dir, "labels")))


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return pseudonyms.pseudonymised(docs, PSEUDONYM_KEY, count="n_values").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "n_values"
    )


def op11_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extracted(_table(spark, sf_dir, "pages"))


def op12_fp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_threshold_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_derivatives, op2_url_model_ratio, op3_spaced_seed_decontamination, op4_run_length_repeats, op5_grouped_prefix_join, op6_pfair_mixing, op7_tokeniser_fertility,
        op8_perspective_rotation, op9_attention_quality, op10_feistel_pseudonyms, op11_line_block_text, op12_fp_tree_search,
        op13_threshold_hard_negatives,
    )
}

ORACLES: dict[str, str] = {
    "op8_perspective_rotation": """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS place FROM turns
), people AS (
  SELECT DISTINCT conv_id AS of_id, speaker AS perspective FROM turns WHERE speaker <> 'system'
), shown AS (
  SELECT p.conv_id, q.perspective, p.place,
    CASE WHEN p.speaker = 'system' THEN '<|system|>' || chr(10)
         WHEN p.speaker = q.perspective THEN '<|assistant|>' || chr(10)
         ELSE '<|user|>' || chr(10) || p.speaker || ': ' END AS head,
    p.text || '<|end|>' || chr(10) AS body, p.speaker = q.perspective AS train
  FROM placed p JOIN people q ON p.conv_id IS NOT DISTINCT FROM q.of_id
), summed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY place) AS upto FROM shown
)
SELECT conv_id, perspective, CAST(0 AS BIGINT) AS piece, count(*) AS n_turns, string_agg(head || body, '' ORDER BY place) AS text,
  coalesce(string_agg(CASE WHEN train THEN CAST(upto - length(body) AS BIGINT)::VARCHAR || '-' || CAST(upto AS BIGINT)::VARCHAR END, ',' ORDER BY place), '') AS mask
FROM summed GROUP BY conv_id, perspective
""",
    "op12_fp_tree_search": r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), sizes AS (SELECT row, doc_id, len(terms) AS n, terms FROM texts WHERE len(terms) > 0
), totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
), counts AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM sizes) WHERE term IN (SELECT term FROM wanted) GROUP BY row, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM counts, totals GROUP BY term, docs
), lengths AS (SELECT row, doc_id, 50 + (50 * n * docs) // words AS m FROM sizes, totals
), scores AS (
  SELECT item_id, doc_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM wanted JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (row) GROUP BY item_id, doc_id, row
), ranks AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, row) AS INTEGER) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 50
""",
    "op13_threshold_hard_negatives": """
WITH whole AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), near AS (
  SELECT a.id AS anchor_id, b.id AS positive_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS positive_score
  FROM whole a JOIN whole b ON a.label = b.label AND a.id <> b.id WHERE a.id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY positive_score DESC, b.id) <= 5
), far AS (
  SELECT a.id AS anchor_id, b.id AS negative_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS negative_score
  FROM whole a JOIN whole b ON a.label <> b.label WHERE a.id % 100 = 0
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank,
  negative_id, positive_score, negative_score
FROM near JOIN far USING (anchor_id)
WHERE 30 * positive_score <= 100 * negative_score AND 100 * negative_score <= 90 * positive_score
QUALIFY rank <= 10
""",
}
