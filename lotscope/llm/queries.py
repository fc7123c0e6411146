"""The operators as queries over the sample tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lotscope.llm import (
    chat, decontaminate, divergence, filter_audit, language_model, line_dedup, mixing, packing, pii, quality,
    simhash, token_count, winnowing,
)
from lotscope.llm.common import table

#: How the byte-level vocabulary cuts texts before it merges (fixed value).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(name: str) -> str:
    """Where the file of a public tokenizer lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _on_documents(build, *others: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return build(*(table(spark, folder, name) for name in ("documents", *others)))

    return query


def _chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.op3_chat_tokens(table(spark, folder, "conversations"), vocabulary("byte_bpe_50k.tiktoken"), BYTE_PATTERN)


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.op10_token_counts(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.op11_packing(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_winnowing": _on_documents(winnowing.op1_winnowing),
        "op2_quality_rff": _on_documents(quality.op2_quality_rff, "labels"),
        "op3_chat_tokens": _chat,
        "op4_line_winnowing": _on_documents(line_dedup.op4_line_winnowing),
        "op5_wu_manber": _on_documents(decontaminate.op5_wu_manber, "benchmark"),
        "op6_simhash_golay": _on_documents(simhash.op6_simhash_golay),
        "op7_bloom_lm": _on_documents(language_model.op7_bloom_lm),
        "op8_hash_mixing": _on_documents(mixing.op8_hash_mixing),
        "op9_pii_offsets": _on_documents(pii.op9_pii_offsets),
        "op10_token_counts": _tokens,
        "op11_packing": _packed,
        "op12_filter_audit": _on_documents(filter_audit.op12_filter_audit, "labels"),
        "op13_source_divergence": _on_documents(divergence.op13_source_divergence),
    }


#: Escaped texts are one longer for each backslash and each mark in them.
OP3_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), measured AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '\\|<turn>|<text>|</turn>'))
        + length(role) + len(regexp_extract_all(role, '\\|<turn>|<text>|</turn>'))
        + length('<turn><text></turn>') AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM measured GROUP BY conv_id
"""

OP5_SQL = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), wanted AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), patterns AS (
    SELECT DISTINCT item_id, size, array_to_string(words[i : i + size - 1], ' ') AS pattern
    FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i
          FROM (SELECT *, least(10, len(words)) AS size FROM wanted) WHERE size > 0)
), sizes AS (SELECT DISTINCT size FROM patterns),
spots AS (
    SELECT doc_id, size, i, array_to_string(words[i : i + size - 1], ' ') AS pattern
    FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM texts, sizes)
), hits AS (
    SELECT DISTINCT doc_id, item_id, size, i FROM spots JOIN patterns USING (size, pattern)
), marked AS (
    SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM hits) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT t.doc_id, CAST(coalesce(len(words), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN marked m ON t.doc_id = m.doc_id LEFT JOIN items i ON t.doc_id = i.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_tokens": OP3_SQL, "op5_wu_manber": OP5_SQL, "op8_hash_mixing": mixing.OP8_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL, "op13_source_divergence": divergence.OP13_SQL,
    }
