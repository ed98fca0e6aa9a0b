"""The thin queries over the operators of this subpackage, and SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_prefix, decontaminate, exact_dedup, harmonic_pack, line_chunks, lpt_shards, pii, simhash, token_matrix, toxicity
from ._shared import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.measure(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_matrix.token_matrix(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_shards.assign_shards(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.line_report(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_pack.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{told}'), (-1L, 1L, 'assistant', '{told}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_prefix.conversation_digests(chat_prefix.format_examples(turns))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_decontamination,
        op3_simhash,
        op4_token_matrix,
        op5_toxicity,
        op6_personal_data,
        op7_sharding,
        op8_line_dedup,
        op9_packing,
        op10_chat_format,
    )
}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
                  row_number() OVER () AS r FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, r) AS n FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, n = 1 AS kept, text_sha256 FROM g
""",
    "op2_decontamination": r"""
WITH b AS (SELECT row_number() OVER () AS r, CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
q AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM p, (SELECT DISTINCT n FROM bw) WHERE i + n - 1 <= len(w)),
h AS (SELECT r, i, q.n, item FROM q JOIN bw ON q.win = bw.win AND q.n = bw.n),
s AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT r, i, unnest(range(0, n)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN s USING (r) LEFT JOIN t USING (r)
""",
    "op8_line_dedup": line_chunks.REPORT_SQL,
    "op10_chat_format": chat_prefix.DIGEST_SQL,
}
