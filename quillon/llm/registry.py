"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import backoff_lm, exact_dedup, host_rules, language_id, minhash, mixing, packing, suffix_dedup, token_orc, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_packing": packing.op2_packing,
        "op3_host_rules": host_rules.op3_host_rules,
        "op4_mixing": mixing.op4_mixing,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_warc": warc.op6_warc,
        "op7_backoff_lm": backoff_lm.op7_backoff_lm,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_token_orc": token_orc.op9_token_orc,
        "op10_minhash": minhash.op10_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_host_rules": host_rules.OP3_SQL,
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "op6_warc": warc.OP6_SQL,
    }
