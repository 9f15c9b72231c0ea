"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexisearch.llm import fingerprint
from lexisearch.llm.bpe import op2_bpe
from lexisearch.llm.hmm import op7_lm_scores
from lexisearch.llm.html import op6_html_text
from lexisearch.llm.license import op8_license_scan
from lexisearch.llm.neardup import op4_near_duplicates
from lexisearch.llm.quality import op3_quality_rules
from lexisearch.llm.retrieval import op5_retrieval_packing
from lexisearch.llm.secrets import op1_secret_scan
from lexisearch.llm.tokenbin import op9_token_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_bpe": op2_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_retrieval_packing": op5_retrieval_packing,
    "op6_html_text": op6_html_text,
    "op7_lm_scores": op7_lm_scores,
    "op8_license_scan": op8_license_scan,
    "op9_token_rows": op9_token_rows,
    "op10_fingerprints": fingerprint.op10_fingerprints,
}
SQL: dict[str, str] = {
    "op10_fingerprints": fingerprint.SQL,
}
