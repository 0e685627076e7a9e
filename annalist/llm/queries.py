"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import op3_chat_format
from .language_id import op2_language_id
from .media import op5_media_columns
from .mixing import op9_mix_sources
from .packing import op4_best_fit_packing
from .secret_scan import op6_secret_scan
from .simhash import op10_simhash_dedup
from .suffix_dedup import op8_suffix_dedup
from .token_store import op7_token_store
from .topk_search import op1_topk_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_topk_search, op2_language_id, op3_chat_format, op4_best_fit_packing, op5_media_columns, op6_secret_scan, op7_token_store, op8_suffix_dedup, op9_mix_sources, op10_simhash_dedup)}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
             a AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
                   FROM a q JOIN v c ON c.vec_id <> q.vec_id)
        SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 5
    """,
}
