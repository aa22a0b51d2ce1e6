"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairlift.llm.fingerprints import op9_document_fingerprints
from pairlift.llm.jaccard import op2_ngram_jaccard_join
from pairlift.llm.mixing import OP1_SQL, op1_source_mixing
from pairlift.llm.nearest import op10_nearest_neighbours
from pairlift.llm.ngram_lm import op4_lm_scoring
from pairlift.llm.packing import op8_best_fit_packing
from pairlift.llm.pages import op3_html_extraction
from pairlift.llm.quality import op7_quality_classifier
from pairlift.llm.secrets import op6_secret_scans
from pairlift.llm.substrings import op5_substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_html_extraction": op3_html_extraction,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_secret_scans": op6_secret_scans,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}

ORACLE_SQL: dict[str, str] = {
    "op1_source_mixing": OP1_SQL,
}
