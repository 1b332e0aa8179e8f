"""The queries of this subpackage: one for each operator, and the SQL of those it fits."""

from __future__ import annotations

from . import bpe, chats, extraction, fingerprints, mixing, passages, quality, retrieval, sharding, simhash, token_counts, toxicity, variants

QUERIES = {
    "op1_histogram_sort": sharding.op1_histogram_sort,
    "op2_chats": chats.op2_chats,
    "op3_passages": passages.op3_passages,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash": simhash.op5_simhash,
    "op6_mixing": mixing.op6_mixing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_line_cleaning": quality.op8_line_cleaning,
    "op9_sketches": fingerprints.op9_sketches,
    "op10_bpe": bpe.op10_bpe,
    "op11_search": retrieval.op11_search,
    "op12_main_text": extraction.op12_main_text,
    "op13_variants": variants.op13_variants,
}

SQL = {
    "op2_chats": chats.OP2_SQL,
    "op8_line_cleaning": quality.OP8_SQL,
    "op11_search": retrieval.OP11_SQL,
}
