"""The queries of the numbered operators and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op5_bpe
from .chat_format import OP13_SQL, op13_chat_format
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .html_extract import op6_html_extract
from .jaccard_join import op4_jaccard_join
from .language_id import op8_language_id
from .packing import op9_packing
from .periodic_runs import op11_periodic_runs
from .quality import op2_quality
from .suffix_dedup import op7_suffix_dedup
from .token_counts import op3_token_counts
from .topk_search import OP1_SQL, op1_exact_topk
from .turn_repair import op12_turn_repair

QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_bpe": op5_bpe,
    "op6_html_extract": op6_html_extract,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_turn_repair": op12_turn_repair,
    "op13_chat_format": op13_chat_format,
}

ORACLES = {
    "op1_exact_topk": OP1_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op13_chat_format": OP13_SQL,
}
