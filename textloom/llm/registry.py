"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from .chat import SQL as CHAT_SQL
from .chat import op7_budgeted_chat_windows
from .context_mixing import op6_context_mixing
from .decontamination import op9_qgram_decontamination
from .extraction import op13_html_blocks
from .fingerprint import op1_minhash_fingerprints
from .ngram_join import op5_ngram_jaccard_join
from .packing import op8_cutting_stock_packing
from .pii import op2_boosted_pii_spans
from .quality import op10_cotraining_quality
from .resampling import SQL as RESAMPLING_SQL
from .resampling import op11_overlap_resampling
from .spelling import SQL as SPELLING_SQL
from .spelling import op12_spelling_variants
from .toxicity import op4_toxicity_severity
from .url_filter import SQL as URL_SQL
from .url_filter import op3_host_reputation

QUERIES = {
    "op1_minhash_fingerprints": op1_minhash_fingerprints,
    "op2_boosted_pii_spans": op2_boosted_pii_spans,
    "op3_host_reputation": op3_host_reputation,
    "op4_toxicity_severity": op4_toxicity_severity,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_context_mixing": op6_context_mixing,
    "op7_budgeted_chat_windows": op7_budgeted_chat_windows,
    "op8_cutting_stock_packing": op8_cutting_stock_packing,
    "op9_qgram_decontamination": op9_qgram_decontamination,
    "op10_cotraining_quality": op10_cotraining_quality,
    "op11_overlap_resampling": op11_overlap_resampling,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_html_blocks": op13_html_blocks,
}

#: Methods that are fitted, hashed or iterative have no SQL; tests/llm compare those with brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_host_reputation": URL_SQL,
    "op7_budgeted_chat_windows": CHAT_SQL,
    "op11_overlap_resampling": RESAMPLING_SQL,
    "op12_spelling_variants": SPELLING_SQL,
}
