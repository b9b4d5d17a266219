"""The queries of this subpackage and the SQL of those that SQL can express."""

from joulewright.llm import chat_views, conversation_trie, decontamination, exact_dedup, html_text, near_dedup, packing, pii, piece_codec, spelling_variants, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_weak_supervision_pii": pii.query,
    "op2_vantage_point_simhash": near_dedup.query,
    "op3_harmonic_packing": packing.query,
    "op4_perfect_hash_dedup": exact_dedup.query,
    "op5_multiple_instance_toxicity": toxicity.query,
    "op6_radix_substring_dedup": substring_dedup.query,
    "op7_overlap_token_counts": token_counts.query,
    "op8_positional_decontamination": decontamination.query,
    "op9_perspective_rotation": chat_views.query,
    "op10_layout_text": html_text.query,
    "op11_radix_conversation_trie": conversation_trie.query,
    "op12_piece_backtracking": piece_codec.query,
    "op13_wavelet_spelling_variants": spelling_variants.query,
}
ORACLES = {
    "op4_perfect_hash_dedup": exact_dedup.ORACLE,
    "op8_positional_decontamination": decontamination.ORACLE,
    "op9_perspective_rotation": chat_views.ORACLE,
    "op11_radix_conversation_trie": conversation_trie.ORACLE,
    "op13_wavelet_spelling_variants": spelling_variants.ORACLE,
}
