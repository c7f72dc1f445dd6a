"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from tablewise.llm import ann_block, bestfit_swap, embed_pigeonhole, hyper_shards, lang_rank, mix_weights, radix_trie, secret_grammar, simhash_blocks, spelling_groups, suffix_dedup, suffix_sql, url_digest, wu_manber

QUERIES = {
    "op1_ann_block": ann_block.query,
    "op2_mix_weights": mix_weights.query,
    "op3_lang_rank": lang_rank.query,
    "op4_simhash_blocks": simhash_blocks.query,
    "op5_secret_grammar": secret_grammar.query,
    "op6_bestfit_swap": bestfit_swap.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_url_digest": url_digest.query,
    "op9_embed_pigeonhole": embed_pigeonhole.query,
    "op10_hyper_shards": hyper_shards.query,
    "op11_wu_manber": wu_manber.query,
    "op12_radix_trie": radix_trie.query,
    "op13_spelling_groups": spelling_groups.query,
}
SQL = {
    "op1_ann_block": ann_block.SQL,
    "op7_suffix_dedup": suffix_sql.SQL,
    "op8_url_digest": url_digest.SQL,
    "op9_embed_pigeonhole": embed_pigeonhole.SQL,
    "op11_wu_manber": wu_manber.SQL,
    "op12_radix_trie": radix_trie.SQL,
    "op13_spelling_groups": spelling_groups.SQL,
}
