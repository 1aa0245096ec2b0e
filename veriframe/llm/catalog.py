"""The subpackage's registered queries and their checking SQL."""

from veriframe.llm.queries_collection import (
    REPEATS_SQL, SEARCH_SQL, TRIE_SQL, op11_suffix_dedup, op12_conversation_trie, op13_reversed_search,
)
from veriframe.llm.queries_dedup import op3_simhash_dedup
from veriframe.llm.queries_native import CHAT_SQL, op5_decontaminate, op6_url_rules, op10_chat_format
from veriframe.llm.queries_pages import TOPK_SQL, op1_main_text, op7_vector_topk, op8_token_packing
from veriframe.llm.queries_text import op2_secret_scan, op4_language_id, op9_quality_model

QUERIES = {
    f.__name__: f
    for f in (
        op1_main_text, op2_secret_scan, op3_simhash_dedup, op4_language_id, op5_decontaminate, op6_url_rules, op7_vector_topk,
        op8_token_packing, op9_quality_model, op10_chat_format, op11_suffix_dedup, op12_conversation_trie,
        op13_reversed_search,
    )
}
ORACLES = {
    "op7_vector_topk": TOPK_SQL, "op10_chat_format": CHAT_SQL, "op11_suffix_dedup": REPEATS_SQL,
    "op12_conversation_trie": TRIE_SQL, "op13_reversed_search": SEARCH_SQL,
}
