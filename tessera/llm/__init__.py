"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, licenses, lm_score, mix, quality, resample, secrets, simhash, token_codec, tool_calls, toxicity, vector_codes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": mix.query,
        "op2_quality": quality.query,
        "op3_decontaminate": decontaminate.query,
        "op4_tool_calls": tool_calls.query,
        "op5_token_codec": token_codec.query,
        "op6_toxicity": toxicity.query,
        "op7_secrets": secrets.query,
        "op8_lm_score": lm_score.query,
        "op9_simhash": simhash.query,
        "op10_licenses": licenses.query,
        "op11_warc": warc.query,
        "op12_resample": resample.query,
        "op13_vector_codes": vector_codes.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": mix.SQL, "op2_quality": quality.SQL, "op4_tool_calls": tool_calls.SQL, "op10_licenses": licenses.SQL, "op11_warc": warc.SQL, "op12_resample": resample.SQL, "op13_vector_codes": vector_codes.SQL}
