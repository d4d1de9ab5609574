"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.chat import op9_chat_formatting
from tidemark.llm.decontaminate import op5_decontamination
from tidemark.llm.jaccard_join import op4_jaccard_join
from tidemark.llm.licenses import op3_license_scan
from tidemark.llm.packing import op2_best_fit_packing
from tidemark.llm.pii import op10_pii
from tidemark.llm.pseudo_likelihood import op1_lm_scoring
from tidemark.llm.quality_model import op6_quality_classifier
from tidemark.llm.quality_rules import op8_quality_rules
from tidemark.llm.warc import op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_license_scan": op3_license_scan,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_decontamination": op5_decontamination,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_warc": op7_warc,
    "op8_quality_rules": op8_quality_rules,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {}
