"""The registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from textrill.llm import (
    bpe_automaton,
    embedding_dedup,
    language_id,
    licences,
    mixing,
    onebit_search,
    periodic_runs,
    quality,
    shingle_dedup,
    slots,
    token_files,
    url_filter,
    whitening,
)

QUERIES = {
    "op1_hyperplane_dedup": embedding_dedup.op1_hyperplane_dedup,
    "op2_bpe_automaton": bpe_automaton.op2_bpe_automaton,
    "op3_pu_quality": quality.op3_pu_quality,
    "op4_fixed_virtual_slots": slots.op4_fixed_virtual_slots,
    "op5_minhash_bayes": shingle_dedup.op5_minhash_bayes,
    "op6_systematic_mix": mixing.op6_systematic_mix,
    "op7_licence_digests": licences.op7_licence_digests,
    "op8_onebit_search": onebit_search.op8_onebit_search,
    "op9_url_vocabulary": url_filter.op9_url_vocabulary,
    "op10_parquet_token_lists": token_files.op10_parquet_token_lists,
    "op11_kneser_ney_language": language_id.op11_kneser_ney_language,
    "op12_descending_lcp_runs": periodic_runs.op12_descending_lcp_runs,
    "op13_lanczos_whitening": whitening.op13_lanczos_whitening,
}

SQL = {
    "op6_systematic_mix": mixing.OP6_SQL,
    "op7_licence_digests": licences.OP7_SQL,
    "op9_url_vocabulary": url_filter.OP9_SQL,
}
