"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loam.llm import bpe, decontam, imatch, importance, langid, neardup_vectors, ngram_join, packing, periodic, sharding, tokenfile, toxicity, urlrep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        tokenfile.op1_token_parquet,
        langid.op2_subword_langid,
        imatch.op3_imatch,
        neardup_vectors.op4_sorted_projections,
        ngram_join.op5_partition_join,
        bpe.op6_batched_bpe,
        sharding.op7_hypergeometric_sharding,
        urlrep.op8_url_reputation,
        packing.op9_pattern_packing,
        toxicity.op10_toxicity_knn,
        decontam.op11_winnowing,
        importance.op12_importance_resampling,
        periodic.op13_periodic_runs,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_reputation": urlrep.oracle(), "op11_winnowing": decontam.oracle(), "op12_importance_resampling": importance.oracle()}
