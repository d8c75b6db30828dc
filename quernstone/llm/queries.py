"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quernstone.llm import ann, bpe, exact_dedup, fim, language_id, minhash, packing, resample, sharding, simhash, token_store, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        language_id.op1_language_id,
        minhash.op2_minhash_dedup,
        bpe.op3_bpe,
        exact_dedup.op4_exact_dedup,
        sharding.op5_rendezvous_sharding,
        toxicity.op6_toxicity,
        token_store.op7_token_store,
        ann.op8_learned_partitions,
        packing.op9_packing,
        url_filter.op10_url_filter,
        simhash.op11_simhash_dedup,
        fim.op12_fill_in_middle,
        resample.op13_importance_resampling,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash_dedup": minhash.ORACLE,
        "op4_exact_dedup": exact_dedup.ORACLE,
        "op5_rendezvous_sharding": sharding.oracle(),
        "op10_url_filter": url_filter.oracle(),
        "op11_simhash_dedup": simhash.oracle(),
        "op12_fill_in_middle": fim.oracle(),
        "op13_importance_resampling": resample.oracle(),
    }
