"""Queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from cotejo.llm import best_fit, bpe, exact_dedup, kneser_ney, length_buckets, license_scan, ngram_join, pii, quality_rules, sharding

QUERIES = {
    "op1_length_buckets": length_buckets.op1_length_buckets,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_kneser_ney": kneser_ney.op4_kneser_ney,
    "op5_pii": pii.op5_pii,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_sharding": sharding.op7_sharding,
    "op8_bpe_automaton": bpe.op8_bpe_automaton,
    "op9_best_fit_packing": best_fit.op9_best_fit_packing,
    "op10_license_scan": license_scan.op10_license_scan,
}

ORACLE_SQL = {
    "op1_length_buckets": length_buckets.OP1_SQL,
    "op10_license_scan": license_scan.OP10_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_ngram_join": ngram_join.OP3_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op7_sharding": sharding.OP7_SQL,
}
