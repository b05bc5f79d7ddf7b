"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversations, langid, line_dedup, merkle, minhash, mixing, piece_encoder, simhash, suffix_dedup, token_counts, token_io, url_filter
from .common import scratch_path, table, with_rid

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_rid(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "tokens")
    token_io.write_tokens(table(spark, sf_dir, "documents"), out, WORD_TOKENIZER, END_ID)
    return token_io.read_tokens(spark, out)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws("+", r["start"].cast("string"), r["length"].cast("string"))), ",")
    return out.select("doc_id", "n_units", "n_shared", "n_removed", spans.alias("removed_spans"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoder.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("score")


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    training = langid.learn(docs.where(~held_out(F.col("doc_id"))))
    out = langid.predict(docs.select("doc_id", "text"), training)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_TOKENIZER)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


# chr(1) marks the ends of units: none of the texts holds it
LINE_DEDUP_SQL = rf"""
WITH marked AS (
  SELECT doc_id, text, replace(replace(replace(coalesce(text, ''), '. ', '. ' || chr(1)), '! ', '! ' || chr(1)), '? ', '? ' || chr(1)) AS m FROM documents),
parts AS (
  SELECT doc_id, text, string_split(replace(replace(m, chr(1) || ' ', ' '), chr(10), chr(10) || chr(1)), chr(1)) AS p FROM marked),
lines AS (
  SELECT doc_id, text, n, p[n] AS unit FROM (SELECT *, unnest(range(1, len(p) + 1)) AS n FROM parts)),
units AS (
  SELECT doc_id, text, n, unit, length(unit) AS length,
    sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY n) - length(unit) AS start,
    lower(trim(regexp_replace(unit, '[ \t\r\n\x0B\f]+', ' ', 'g'))) AS clean FROM lines),
ranked AS (
  SELECT *, len(string_split(clean, ' ')) AS words, clean <> '' AND count(*) OVER (PARTITION BY clean) > 1 AS shared,
    row_number() OVER (PARTITION BY clean ORDER BY doc_id, n) > 1 AS later FROM units),
runs AS (
  SELECT *, n - row_number() OVER (PARTITION BY doc_id, shared ORDER BY n) AS run FROM ranked),
judged AS (
  SELECT *, shared AND sum(words) OVER (PARTITION BY doc_id, shared, run) >= {line_dedup.LEAST_WORDS} AS long FROM runs)
SELECT doc_id, CASE WHEN any_value(text) IS NULL THEN 0 ELSE count(*) END AS n_units, count_if(long)::BIGINT AS n_shared, count_if(long AND later)::BIGINT AS n_removed,
  coalesce(string_agg(CASE WHEN long AND later THEN start::BIGINT::VARCHAR || '+' || length::VARCHAR END, ',' ORDER BY n), '') AS removed_spans,
  sha256(coalesce(string_agg(CASE WHEN NOT (long AND later) THEN unit END, '' ORDER BY n), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_line_dedup": LINE_DEDUP_SQL, "op9_url_filter": url_filter.judge_sql(),
        "op12_conversation_repair": conversations.repair_sql(), "op13_merkle_manifest": merkle.manifest_sql(),
    }
