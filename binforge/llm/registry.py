"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from binforge.llm import bpe, chat, embeddings, jaccard, langid, lexical, licenses, negatives, oracles, packing, quality, substrings, topk, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_packing": packing.op2_packing,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_language_id": langid.op5_language_id,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_warc": warc.op7_warc,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_embedding_near_dedup": embeddings.op9_embedding_near_dedup,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_exact_top_k": topk.op12_exact_top_k,
    "op13_ranked_lexical_search": lexical.op13_ranked_lexical_search,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.op1_sql(),
        "op4_quality_rules": oracles.op4_sql(),
        "op6_substring_dedup": oracles.op6_sql(),
        "op8_chat_formatting": chat.OP8_SQL,
        "op9_embedding_near_dedup": oracles.op9_sql(),
        "op10_ngram_jaccard": oracles.op10_sql(),
        "op11_hard_negatives": negatives.OP11_SQL,
        "op12_exact_top_k": topk.OP12_SQL,
        "op13_ranked_lexical_search": lexical.OP13_SQL,
    }
