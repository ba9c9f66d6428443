"""Queries of the llm operators and their DuckDB SQL."""

from __future__ import annotations

from .decontaminate import op7_decontaminate
from .lm_scoring import op8_lm_scoring
from .merkle import op12_merkle
from .near_dedup import op9_near_dedup
from .packing import op2_packing
from .pii import op10_pii
from .quality import op6_quality
from .quality_model import op13_quality_classifier
from .resampling import op11_importance_resampling
from .shards import op5_shards
from .sql import SQL
from .token_counts import op4_token_counts
from .token_files import op1_token_files
from .url_filter import op3_url_filter

QUERIES = {f.__name__: f for f in (op1_token_files, op2_packing, op3_url_filter, op4_token_counts, op5_shards, op6_quality,
                                   op7_decontaminate, op8_lm_scoring, op9_near_dedup, op10_pii, op11_importance_resampling,
                                   op12_merkle, op13_quality_classifier)}

__all__ = ["QUERIES", "SQL"]
