"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_trie, decontaminate, license_scan, url_rules
from .alignment import op12_token_alignment
from .conversation_trie import op13_conversation_trie
from .decontaminate import op4_decontamination
from .license_scan import op8_license_scan
from .near_dup import op10_jaccard_join
from .neighbours import op11_nearest_neighbours
from .packing import op3_packing
from .quality_outliers import op2_quality_outliers
from .secret_scan import op9_secret_scan
from .substring_dedup import op7_substring_dedup
from .tokens import op5_token_files
from .toxicity import op1_toxicity
from .url_rules import op6_url_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quality_outliers": op2_quality_outliers,
        "op3_packing": op3_packing,
        "op4_decontamination": op4_decontamination,
        "op5_token_files": op5_token_files,
        "op6_url_rules": op6_url_rules,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_license_scan": op8_license_scan,
        "op10_jaccard_join": op10_jaccard_join,
        "op9_secret_scan": op9_secret_scan,
        "op11_nearest_neighbours": op11_nearest_neighbours,
        "op12_token_alignment": op12_token_alignment,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": decontaminate.ORACLE_SQL,
        "op6_url_rules": url_rules.ORACLE_SQL,
        "op8_license_scan": license_scan.ORACLE_SQL,
        "op13_conversation_trie": conversation_trie.ORACLE_SQL,
    }
