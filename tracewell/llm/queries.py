"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import chat, jaccard, langid, merkle, mixing, packing, pii, token_files, topk, toxicity
from tracewell.llm.shared import documents
from tracewell.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def _on(operator: Callable, *tables: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return operator(spark, *(documents(spark, sf_dir, t) for t in tables))

    return query


def queries() -> dict[str, Query]:
    return {
        "op1_pii": _on(pii.op1, "documents"),
        "op2_fingerprints": _on(merkle.op2, "documents"),
        "op3_chat_formatting": _on(chat.op3, "conversations"),
        "op4_mixing": _on(mixing.op4, "documents"),
        "op5_toxicity": _on(toxicity.op5, "documents", "labels"),
        "op6_packing": _on(packing.op6, "documents"),
        "op7_language_id": _on(langid.op7, "documents"),
        "op8_jaccard_join": _on(jaccard.op8, "documents"),
        "op9_top_k": _on(topk.op9, "embeddings"),
        "op10_token_files": _on(token_files.op10, "documents"),
    }


#: Exact top-k: integer vectors, every query row against all rows.
TOP_K = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
"""

#: Formatting: digests from the rows themselves; the formatted length from what escaping adds.
CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *,
    length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + coalesce(list_sum([length(x) FOR x IN regexp_extract_all(text, '#{3,}')]), 0) AS escaped
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + escaped + length('### ' || ':' || chr(10) || chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": CHAT, "op9_top_k": TOP_K}
