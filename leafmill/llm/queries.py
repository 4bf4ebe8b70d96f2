"""Queries of the training-data operators by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_transducer import op5_byte_bpe
from . import licenses, near_dedup, sharding, tool_calls
from .dialogue import op12_conversation_repair
from .licenses import op2_license_scans
from .matroska import op1_media_columns
from .mixture import op11_mixture_packing
from .near_dedup import op8_minhash_near_dedup
from .packing import op4_best_fit_packing
from .quality import op3_quality_rules
from .runs import op13_periodic_runs
from .sharding import op6_sharding
from .token_counts import op10_token_counts
from .tool_calls import op7_chat_formatting
from .toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_license_scans": op2_license_scans,
    "op3_quality_rules": op3_quality_rules,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_sharding": op6_sharding,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_mixture_packing": op11_mixture_packing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_license_scans": licenses.oracle(),
    "op6_sharding": sharding.oracle(),
    "op7_chat_formatting": tool_calls.ORACLE,
    "op8_minhash_near_dedup": near_dedup.ORACLE,
}
