"""The subpackage's queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from footfall.llm import (alignment, decontamination, fill_in_middle, line_dedup, mixing, ngram_join, quality_rules,
                          sharding, simhash, suffix_dedup, token_output, toxicity, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_sharding": sharding.op5_sharding,
    "op6_token_output": token_output.op6_token_output,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_simhash": simhash.op10_simhash,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_ngram_join": ngram_join.op12_ngram_join,
    "op13_alignment": alignment.op13_alignment,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op1_url_filter": url_filter.SQL,
    "op2_line_dedup": line_dedup.SQL,
    "op3_mixing": mixing.SQL,
    "op9_decontamination": decontamination.SQL,
    "op11_fill_in_middle": fill_in_middle.SQL,
}
