"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm import bpe, chat, exact, langid, mixing, quality, rules, simhash, substrings, warc
from lakemill.llm.common import fresh_folder

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    mask = F.array_join(F.transform("spans", lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), ",")
    return views.select("conv_id", "participant", "n_turns", "n_own", "rendered", mask.alias("mask"), "n_masked_in")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = _documents(spark, sf_dir), langid.fold("doc_id", 3)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold != 1)
    rows = quality.score(docs, quality.learn(docs, labels))
    return rows.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc.read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.score(_documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeats(_documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(_documents(spark, sf_dir), keep=["doc_id"])
    return rows.select("row.doc_id", "size", "source_size", "target", "taken", "rounds", "part")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = _documents(spark, sf_dir), langid.fold("doc_id", 4)
    rows = langid.predict(docs, langid.learn(docs.where(fold != 2)))
    return rows.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.report(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_bpe, op2_chat, op3_quality, op4_warc, op5_simhash, op6_rules, op7_repeats, op8_mix, op9_language, op10_exact)}

ORACLE: dict[str, str] = {
    "op2_chat": r"""
        WITH t AS (
          SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|im_', '<|im-') AS text,
                 replace(replace(replace(role, '<|im_', '<|im-'), chr(10), ' '), chr(13), ' ') AS shown FROM conversations),
        v AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role IS DISTINCT FROM 'system'),
        p AS (
          SELECT t.conv_id, participant, turn, t.role, t.text, t.role IS NOT DISTINCT FROM participant AS own,
                 '<|im_start|>' || CASE WHEN t.role IS NOT DISTINCT FROM participant THEN 'assistant' WHEN t.role = 'system' THEN 'system' WHEN t.role IS NULL THEN 'user' ELSE 'user name=' || t.shown END || chr(10) AS head,
                 t.text || '<|im_end|>' || chr(10) AS body
          FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
        s AS (
          SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos FROM p)
        SELECT conv_id, participant, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
               string_agg(head || body, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS rendered,
               coalesce(string_agg(CAST(pos AS BIGINT) || '+' || length(body), ',' ORDER BY pos) FILTER (own), '') AS mask,
               CAST(coalesce(sum(length(body)) FILTER (own), 0) AS BIGINT) AS n_masked_in
        FROM s GROUP BY conv_id, participant""",
    "op4_warc": r"""
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages)
        SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> head THEN head END AS refers_to
        FROM p""",
    "op10_exact": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)""",
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
