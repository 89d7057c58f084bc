"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, packing, quality_rules, resampling, sentencepiece_nbest, sharding, simhash, suffix_dedup, topk_search, url_filter


def queries() -> dict:
    return {
        "op1_sentencepiece": sentencepiece_nbest.op1_sentencepiece,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_importance_resampling": resampling.op3_importance_resampling,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_chat_format": chat_format.op5_chat_format,
        "op6_simhash": simhash.op6_simhash,
        "op7_packing": packing.op7_packing,
        "op8_sharding": sharding.op8_sharding,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_topk_search": topk_search.op10_topk_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality_rules.ORACLE, "op5_chat_format": chat_format.ORACLE, "op8_sharding": sharding.ORACLE, "op9_url_filter": url_filter.ORACLE, "op10_topk_search": topk_search.ORACLE}
