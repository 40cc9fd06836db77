"""Registry of this subpackage's queries and their SQL, read by ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from farelens.llm import chat_log, decontamination, fill_in_middle, html_wrappers, language_id, near_dedup, packing, personal_data, quality_classifier, quality_rules, target_sampling, url_filters, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_html_extraction": html_wrappers.op2_html_extraction,
        "op3_url_filters": url_filters.op3_url_filters,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_chat_format": chat_log.op5_chat_format,
        "op6_language_id": language_id.op6_language_id,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_warc": warc.op9_warc,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "op11_personal_data": personal_data.op11_personal_data,
        "op12_target_sampling": target_sampling.op12_target_sampling,
        "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": url_filters.ORACLE_SQL,
        "op4_quality_rules": quality_rules.ORACLE_SQL,
        "op5_chat_format": chat_log.ORACLE_SQL,
        "op7_decontamination": decontamination.ORACLE_SQL,
        "op9_warc": warc.ORACLE_SQL,
        "op12_target_sampling": target_sampling.ORACLE_SQL,
        "op13_fill_in_middle": fill_in_middle.ORACLE_SQL,
    }
