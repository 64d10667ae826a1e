"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, licenses, merkle, packing, pii, quality, ranked, runs, sharding, simhash, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_quality": quality.op2_quality,
        "op3_simhash": simhash.op3_simhash,
        "op4_bpe": bpe.op4_bpe,
        "op5_sharding": sharding.op5_sharding,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_pii": pii.op7_pii,
        "op8_packing": packing.op8_packing,
        "op9_merkle": merkle.op9_merkle,
        "op10_licenses": licenses.op10_licenses,
        "op11_runs": runs.op11_runs,
        "op12_embeddings": embeddings.op12_embeddings,
        "op13_ranked": ranked.op13_ranked,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.SQL, "op10_licenses": licenses.SQL, "op12_embeddings": embeddings.SQL, "op13_ranked": ranked.SQL}
