"""Queries of this subpackage's operators, with SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, language_id, packing, prefix_trie, quality, secrets_scan, simhash_dedup, token_counts, turn_repair, url_filter, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_quality_mil": quality.op2_quality_mil,
    "op3_url_reputation": url_filter.op3_url_reputation,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_simhash_dedup": simhash_dedup.op6_simhash_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_secret_scan": secrets_scan.op8_secret_scan,
    "op9_warc_bundles": warc.op9_warc_bundles,
    "op10_length_buckets": packing.op10_length_buckets,
    "op11_language_id": language_id.op11_language_id,
    "op12_turn_repair": turn_repair.op12_turn_repair,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op3_url_reputation": url_filter.OP3_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op5_chat_format": chat_format.OP5_SQL,
    "op9_warc_bundles": warc.OP9_SQL,
    "op12_turn_repair": turn_repair.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
