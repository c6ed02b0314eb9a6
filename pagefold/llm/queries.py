"""The corpus queries and their DuckDB SQL."""

from pagefold.llm import ann, bpe, conversations, fim, linededup, nearcopies, packing, ppm, quality, rules, suffixdedup, tokenfiles, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_byte_bpe": bpe.query,
    "op3_quality_classifier": quality.query,
    "op4_line_dedup": linededup.query,
    "op5_toxicity": toxicity.query,
    "op6_hash_prefix_forest": ann.query,
    "op7_quality_rules": rules.query,
    "op8_order_minhash": nearcopies.query,
    "op9_token_files": tokenfiles.query,
    "op10_suffix_array_dedup": suffixdedup.query,
    "op11_lm_scoring": ppm.query,
    "op12_conversation_trie": conversations.query,
    "op13_fill_in_middle": fim.query,
}
ORACLE_SQL = {"op7_quality_rules": rules.SQL, "op13_fill_in_middle": fim.SQL}
