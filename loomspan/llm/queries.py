"""Registry of this subpackage's queries and of their DuckDB SQL."""

from loomspan.llm import bpe, chat, decontam, divergence, hilbert, periodic, pii, quality, secret_scan, simhash, substring_dedup, token_files, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_pii_bootstrap": pii.op2_pii_bootstrap,
    "op3_secret_ledger": secret_scan.op3_secret_ledger,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_simhash_groups": simhash.op6_simhash_groups,
    "op7_hilbert_shards": hilbert.op7_hilbert_shards,
    "op8_preference_format": chat.op8_preference_format,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_token_files": token_files.op10_token_files,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

SQL = {
    "op1_quality_rules": quality.OP1_SQL,
    "op3_secret_ledger": secret_scan.OP3_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op8_preference_format": chat.OP8_SQL,
    "op9_decontamination": decontam.OP9_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
}
