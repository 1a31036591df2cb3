"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from kindred.llm import bpe, chat, decontaminate, exact, html, licenses, secrets, simhash, toxicity

QUERIES = {
    "op1_secret_forest": secrets.op1_secret_forest,
    "op2_chat_prefix_targets": chat.op2_chat_prefix_targets,
    "op3_toxicity_trees": toxicity.op3_toxicity_trees,
    "op4_exact_block_naming": exact.op4_exact_block_naming,
    "op5_html_host_paths": html.op5_html_host_paths,
    "op6_bpe_forced_boundaries": bpe.op6_bpe_forced_boundaries,
    "op7_token_counts": bpe.op7_token_counts,
    "op8_license_positional": licenses.op8_license_positional,
    "op9_simhash_gray": simhash.op9_simhash_gray,
    "op10_benchmark_qgram": decontaminate.op10_benchmark_qgram,
}
SQL = {"op2_chat_prefix_targets": chat.OP2_SQL, "op4_exact_block_naming": exact.OP4_SQL, "op8_license_positional": licenses.OP8_SQL}
