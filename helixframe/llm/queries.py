"""Registered queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op10_decontamination
from .dual_tree import op3_dual_tree
from .language import op8_language
from .metric_join import op13_metric_join
from .oracles import ORACLE_SQL
from .packing import op5_packing
from .prefix_trie import op12_prefix_trie
from .secrets import op9_secrets
from .simhash import op2_simhash
from .substring_dedup import op4_substring_dedup
from .suffix_dedup import op1_suffix_dedup
from .token_files import op6_token_files
from .toxicity import op7_toxicity
from .whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash": op2_simhash,
    "op3_dual_tree": op3_dual_tree,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_packing": op5_packing,
    "op6_token_files": op6_token_files,
    "op7_toxicity": op7_toxicity,
    "op8_language": op8_language,
    "op9_secrets": op9_secrets,
    "op10_decontamination": op10_decontamination,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_metric_join": op13_metric_join,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
