"""The queries of this subpackage, by name, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontaminate, hardnegatives, htmltext, joinreplay, langid, packing, pii, secrets, sharding, simhash, tokenfiles, toxicity, vecdedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_secrets": secrets.op2_secrets,
        "op3_sharding": sharding.op3_sharding,
        "op4_embeddings": vecdedup.op4_embeddings,
        "op5_pii": pii.op5_pii,
        "op6_html": htmltext.op6_html,
        "op7_packing": packing.op7_packing,
        "op8_simhash": simhash.op8_simhash,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_tokens": tokenfiles.op10_tokens,
        "op11_language": langid.op11_language,
        "op12_join": joinreplay.op12_join,
        "op13_negatives": hardnegatives.op13_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.OP1_SQL, "op4_embeddings": vecdedup.OP4_SQL, "op12_join": joinreplay.OP12_SQL, "op13_negatives": hardnegatives.OP13_SQL}
