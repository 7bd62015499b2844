"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .language import op2_zstd_language
from .licenses import op10_fuzzy_notices
from .line_dedup import op1_suffix_lines
from .near_dedup import op7_superminhash
from .neighbours import op4_permutation_index
from .oracles import LINES, NEAR, QUALITY
from .packing import op9_bin_completion
from .pieces import op6_merge_dropout
from .quality import op5_quality_cascade
from .sharding import op3_ring_shards
from .token_store import op8_parquet_tokens

_ALL = (op1_suffix_lines, op2_zstd_language, op3_ring_shards, op4_permutation_index, op5_quality_cascade, op6_merge_dropout, op7_superminhash, op8_parquet_tokens, op9_bin_completion, op10_fuzzy_notices)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_lines": LINES, "op5_quality_cascade": QUALITY, "op7_superminhash": NEAR}
