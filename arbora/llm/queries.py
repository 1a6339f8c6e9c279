"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from arbora.llm import conversation_trie, decontamination, jaccard, licenses, packing, quality, streaming_dedup, substrings, token_files, topk, toxicity, vector_codes, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_quality": quality.op2_quality,
    "op3_substrings": substrings.op3_substrings,
    "op4_licenses": licenses.op4_licenses,
    "op5_topk_search": topk.op5_topk_search,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_packing": packing.op7_packing,
    "op8_token_files": token_files.op8_token_files,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op9_toxicity": toxicity.op9_toxicity,
    "op11_conversation_trie": conversation_trie.op11_conversation_trie,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_streaming_dedup": streaming_dedup.op13_streaming_dedup,
}
SQL: dict[str, str] = {"op3_substrings": substrings.OP3_SQL, "op10_jaccard_join": jaccard.OP10_SQL, "op5_topk_search": topk.OP5_SQL, "op1_warc": warc.OP1_SQL, "op6_decontamination": decontamination.OP6_SQL, "op11_conversation_trie": conversation_trie.OP11_SQL, "op12_vector_codes": vector_codes.OP12_SQL, "op13_streaming_dedup": streaming_dedup.OP13_SQL}
