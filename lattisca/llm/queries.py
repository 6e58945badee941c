"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattisca.llm.contamination import op9_benchmark_contamination
from lattisca.llm.html_text import op6_main_text
from lattisca.llm.language import op3_language
from lattisca.llm.near_dup import op4_lsh_forest
from lattisca.llm.packing import op10_pattern_packing
from lattisca.llm.quality import OP8_SQL, op8_line_frequency
from lattisca.llm.sharding import op1_hash_tree_shards
from lattisca.llm.token_files import op2_elias_fano_tokens
from lattisca.llm.toxicity import op7_toxicity
from lattisca.llm.warc import op5_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_hash_tree_shards, op2_elias_fano_tokens, op3_language, op4_lsh_forest, op5_warc, op6_main_text, op7_toxicity, op8_line_frequency, op9_benchmark_contamination, op10_pattern_packing]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_line_frequency": OP8_SQL}
