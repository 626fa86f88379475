"""Queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, exact, lines, packing, simhash, substrings, topk, toxicity, urls

QUERIES = {
    f.__name__: f
    for f in (
        simhash.op1_simhash_groups,
        substrings.op2_repeated_substrings,
        packing.op3_vector_packing,
        chat.op4_chat_format,
        exact.op5_exact_dedup,
        bpe.op6_bpe_round_trip,
        topk.op7_bit_sliced_top_k,
        lines.op8_line_dedup,
        toxicity.op9_toxicity,
        urls.op10_url_filters,
    )
}

ORACLE_SQL = {
    "op5_exact_dedup": exact.OP5_SQL,
    "op7_bit_sliced_top_k": topk.OP7_SQL,
    "op8_line_dedup": lines.OP8_SQL,
    "op10_url_filters": urls.OP10_SQL,
}
