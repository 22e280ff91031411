"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_WHERE = {
    "op1_source_mixing": ("mixing", "op1"),
    "op2_token_files": ("token_files", "op2"),
    "op3_simhash_dedup": ("simhash", "op3"),
    "op4_suffix_dedup": ("substring_dedup", "op4"),
    "op5_line_dedup": ("line_dedup", "op5"),
    "op6_sentencepiece": ("sentencepiece_codec", "op6"),
    "op7_nearest_neighbours": ("ann", "op7"),
    "op8_quality_rules": ("quality", "op8"),
    "op9_language_id": ("langid", "op9"),
    "op10_toxicity": ("toxicity", "op10"),
}
_SQL: dict[str, tuple[str, str]] = {
    "op1_source_mixing": ("mixing", "SQL"),
    "op4_suffix_dedup": ("substring_dedup", "SQL"),
    "op5_line_dedup": ("line_dedup", "SQL"),
    "op8_quality_rules": ("quality", "SQL"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), function) for name, (module, function) in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__package__}.{module}"), text) for name, (module, text) in _SQL.items()}
